import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom.functions.features import CATEGORICAL
from filmloom.operators.explain import NOTHING, base_value, contributions, ensemble_leaves, explanation, shapley
from filmloom.operators.model import NUMERIC, RatingModel, held_out, regression_metrics, train


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        x = [float(rng.randrange(5)) for _ in NUMERIC]
        genre = rng.choice(["Drama", "Action"])
        rows.append((f"t{i}", 2.0 + x[0] + 0.5 * x[3] * (genre == "Drama") + rng.random(), *x, genre, f"d{rng.randrange(30)}", "Unknown"))
    names = ", ".join(f"{n} double" for n in NUMERIC) + ", " + ", ".join(f"{n} string" for n in CATEGORICAL)
    return spark.createDataFrame(rows, f"tconst string, averageRating double, {names}")


@pytest.fixture(scope="module")
def model(frame):
    return train(frame, iterations=8, depth=3)


def test_training(model, frame):
    fitted, metadata = model
    assert metadata["feature_names"] == NUMERIC + CATEGORICAL and metadata["cat_features_idx"] == [16, 17, 18]
    assert metadata["total_rows"] == 600 and 60 < metadata["test_rows"] < 180 and metadata["test_r2"] > 0.6
    ratings = [r["rating"] for r in fitted.score(frame).select("rating").collect()]
    assert len(ratings) == 600 and all(0 <= r <= 10 and r == round(r, 2) for r in ratings)


def test_no_rows(frame):
    assert train(frame.limit(0)) == (None, {})


def test_split_is_stable(frame):
    ids = [{r[0] for r in frame.repartition(n).where(held_out(F.col("tconst"), 0.2)).select("tconst").collect()} for n in (1, 5)]
    assert ids[0] == ids[1]


def test_keeping(model, frame, spark, tmp_path):
    fitted, _ = model
    fitted.save(f"{tmp_path}/m")
    again = RatingModel.load(spark, f"{tmp_path}/m")
    pick = lambda m: [tuple(r) for r in m.score(frame).select("tconst", "rating").orderBy("tconst").collect()]
    assert pick(again) == pick(fitted) and again.metadata == fitted.metadata
    with pytest.raises(FileNotFoundError):
        RatingModel.load(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        fitted.score(frame.drop("startYear"))


def test_importance(model, spark):
    rows = model[0].importance(spark).collect()
    assert len(rows) == 19 and rows[0]["feature"] == "startYear" and abs(sum(r["importance"] for r in rows) - 1) < 1e-9
    assert model[0].importance(spark, 10).count() == 10


def test_contributions_add_up(model, frame):
    rows = contributions(model[0], frame, "tconst").collect()
    assert len(rows) == 600
    for r in rows:
        assert abs(r["base"] + sum(r["contributions"]) - r["prediction"]) < 1e-6
    assert contributions(model[0], frame.limit(0), "tconst").count() == 0


def test_shapley_by_definition(model):
    """Against the average over all orders of the features of the conditional expectation of one tree."""
    from itertools import permutations

    leaves = ensemble_leaves(model[0])[:8]
    used = sorted({f for leaf in leaves for f in leaf.features})
    x = np.random.default_rng(0).integers(0, 5, (4, 19)).astype(float)

    def game(row, known):
        total = 0.0
        for leaf in leaves:
            p = leaf.value
            for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                p *= (low < row[f] <= high) if f in known else share
            total += p
        return total

    got = shapley(x, leaves)
    for row, values in zip(x, got):
        want = dict.fromkeys(used, 0.0)
        orders = list(permutations(used))
        for order in orders:
            for k, f in enumerate(order):
                want[f] += (game(row, set(order[: k + 1])) - game(row, set(order[:k]))) / len(orders)
        assert np.allclose([values[f] for f in used], [want[f] for f in used])
    assert abs(base_value(leaves) - game(x[0], set())) < 1e-9


def test_measures(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 1.0), (None, 1.0), (1.0, None)], "y double, p double")
    row = regression_metrics(df, "y", "p").first()
    assert row["n"] == 3 and abs(row["mae"] - 1) < 1e-9 and abs(row["rmse"] - (5 / 3) ** 0.5) < 1e-9 and abs(row["r2"] - (1 - 5 / 2)) < 1e-9
    assert tuple(regression_metrics(df.limit(0), "y", "p").first()) == (0, None, None, None)
    assert regression_metrics(df.limit(1), "y", "p").first()["r2"] is None


@pytest.mark.parametrize(
    "values,want",
    [([0.05, 0.051, None, 0.0, 0.0, 0.0], "b: +0.05"), ([0.0] * 6, NOTHING), ([-1.0, 1.0, 0.2, 0.3, 0.4, 0.5], "a: -1.00; b: +1.00; f: +0.50; e: +0.40; d: +0.30"), ([0.625] + [0.0] * 5, "a: +0.62"), (None, None)],
)
def test_explanation(spark, values, want):
    text = spark.createDataFrame([(values,)], "v array<double>").select(explanation(list("abcdef"), F.col("v"))).first()[0]
    assert text == want or text.endswith(": " + want)
