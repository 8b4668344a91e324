"""Why a model gave a rating: Shapley values of tree ensembles, and their text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions.features import round_cents
from filmloom.operators.model import RatingModel

# Number of factors named, the size from which one is named, and the words around them.
NAMED, NOTABLE = 5, 0.05
BECAUSE, NOTHING = "Рейтинг сформирован за счёт: ", "Нет значимых факторов"


@dataclass
class Leaf:
    """A leaf's value and, for each feature on its path, the interval it asks for and the share of rows that goes on."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def _leaves(tree, weight: float) -> list[Leaf]:
    out: list[Leaf] = []

    def walk(node, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            keys = list(path)
            out.append(Leaf(weight * node.prediction(), keys, [path[k][0] for k in keys], [path[k][1] for k in keys], [path[k][2] for k in keys]))
            return
        split, rows = node.split(), node.impurityStats().count()
        feature, threshold = split.featureIndex(), split.threshold()
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            span = (low, min(high, threshold)) if left else (max(low, threshold), high)
            walk(child, path | {feature: (*span, share * child.impurityStats().count() / rows)})

    walk(tree._java_obj.rootNode(), {})
    return out


def ensemble_leaves(model: RatingModel) -> list[Leaf]:
    """All leaves of the model's trees, weighted; their number is bounded by iterations and depth."""
    return [leaf for tree, weight in zip(model.trees.trees, model.trees.treeWeights) for leaf in _leaves(tree, weight)]


def base_value(leaves: list[Leaf]) -> float:
    """The mean prediction over the rows that the trees were fitted on."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))


def shapley(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Path-dependent Shapley values, rows by features.

    A leaf's game is a product over its path's features: a known feature is 1 or 0, an unknown one the share of rows
    that goes its way. For each feature the sum over the subsets of the others groups by size, and the sums of equal
    size are the coefficients of the product of (share + fits * t); all rows are computed at once.
    """
    n, total = len(x), np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        fits = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high in zip(leaf.features, leaf.low, leaf.high)]
        weights = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
        for i, feature in enumerate(leaf.features):
            terms = [np.ones(n)]
            for j in range(d):
                if j != i:
                    terms = [(leaf.share[j] * terms[k] if k < len(terms) else 0.0) + (fits[j] * terms[k - 1] if k else 0.0) for k in range(len(terms) + 1)]
            total[:, feature] += leaf.value * (fits[i] - leaf.share[i]) * sum(w * t for w, t in zip(weights, terms))
    return total


def contributions(model: RatingModel, rows: DataFrame, key: str) -> DataFrame:
    """(key, prediction, rating, base, contributions): base and contributions add up to the unclamped prediction.

    Rows are explained in Arrow batches where they are; the trees travel with the code.
    """
    leaves = ensemble_leaves(model)
    base = base_value(leaves)
    scored = model.score(rows).select(F.col(key).alias("key"), "prediction", "rating", vector_to_array("features").alias("x"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = shapley(np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), -1), leaves) if len(batch) else []
            yield batch[["key", "prediction", "rating"]].assign(base=base, contributions=[v.tolist() for v in values])

    kind = scored.schema["key"].dataType.simpleString()
    return scored.mapInPandas(explain, f"key {kind}, prediction double, rating double, base double, contributions array<double>").withColumnRenamed("key", key)


def explanation(names: list[str], values: Column) -> Column:
    """The most notable contributions as text: the NAMED largest by size, ties in feature order, those beyond NOTABLE.

    Null values have no part; a null list gives null.
    """
    named = F.zip_with(F.lit(names), values, lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    ranked = F.transform(named, lambda s, i: F.struct((-F.abs(s["v"])).alias("size"), i.alias("i"), s["n"].alias("n"), s["v"].alias("v")))
    top = F.slice(F.array_sort(F.filter(ranked, lambda s: s["v"].isNotNull())), 1, NAMED)
    words = F.transform(F.filter(top, lambda s: F.abs(s["v"]) > NOTABLE), lambda s: F.concat(s["n"], F.lit(": "), F.when(s["v"] > 0, "+").otherwise(""), F.format_string("%.2f", round_cents(s["v"]))))
    return F.when(F.size(words) > 0, F.concat(F.lit(BECAUSE), F.array_join(words, "; "))).when(values.isNotNull(), NOTHING)
