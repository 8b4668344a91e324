"""Registered queries over titles and their people: splits and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.functions.keys import clean_key, clean_key_sql
from filmloom.llm.splits import assign_splits, groups_of
from filmloom.llm.together import CHUNK_ITEMS, pairs_together
from filmloom.scratch import cut
from filmloom.sources.tables import table


def _directed(spark: SparkSession, folder: str) -> DataFrame:
    credits = table(spark, folder, "title_principals").where(F.lower(F.trim("category")) == "director")
    return credits.select(clean_key("tconst").alias("item"), clean_key("nconst").alias("owner"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups_of(_directed(spark, folder)).where("items > 1").select(F.col("item").alias("tconst"), F.col("group").alias("group_tconst"))


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every title of title_basics, or with a director, with its group and split."""
    grouped = groups_of(_directed(spark, folder))
    titles = table(spark, folder, "title_basics").select(clean_key("tconst").alias("item")).where("item is not null").distinct()
    single = titles.join(grouped, "item", "left_anti").select("item", F.col("item").alias("group"), F.lit(1).cast("bigint").alias("items"))
    targets = table(spark, folder, "split_targets").select("split_name", "target_share").collect()
    assigned = assign_splits(grouped.unionByName(single), [tuple(r) for r in targets])
    return assigned.select(F.col("item").alias("tconst"), F.col("group").alias("group_tconst"), "split_name")


def p3_split_report(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of each split and their share beside the target."""
    counts = p3_splits(spark, folder).groupBy("split_name").agg(F.count(F.lit(1)).alias("titles"))
    counts = counts.join(table(spark, folder, "split_targets").select("split_name", "target_share"), "split_name", "right").withColumn("titles", F.coalesce("titles", F.lit(0)))
    total = F.greatest(F.lit(1), F.sum("titles").over(Window.partitionBy()))  # one row per split
    return counts.select("split_name", "target_share", "titles", (F.col("titles") / total).alias("actual_share"))


#: What the titles of a split may lack or exceed, as a share of all titles.
SHARE_TOLERANCE = 0.01


def p3_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether, for each split, no title's group is cut, titles that share a director are in one group, and the number
    of titles is close to the target."""
    splits = cut(p3_splits(spark, folder))
    cut_groups = splits.groupBy("group_tconst").agg(F.count_distinct("split_name").alias("n")).where("n > 1").count()
    directed = _directed(spark, folder).where("item is not null and owner is not null")
    apart = directed.join(splits.select(F.col("tconst").alias("item"), "group_tconst"), "item", "left").groupBy("owner")
    apart = apart.agg(F.min("group_tconst").alias("a"), F.max("group_tconst").alias("b"), F.count_if(F.col("group_tconst").isNull()).alias("lost")).where("a <> b or lost > 0").count()
    targets = table(spark, folder, "split_targets").select("split_name", "target_share")
    counts = targets.join(splits.groupBy("split_name").agg(F.count(F.lit(1)).alias("titles")), "split_name", "left")
    total = splits.count()
    near = F.abs(F.coalesce("titles", F.lit(0)) - F.col("target_share") * total) <= F.greatest(F.lit(1.0), F.lit(SHARE_TOLERANCE * total))
    return counts.select("split_name", F.lit(cut_groups == 0).alias("groups_whole"), F.lit(apart == 0).alias("directors_together"), near.alias("share_near"))


#: Least number of common titles, and least ratio to the number expected by chance.
LEAST_TOGETHER, LEAST_LIFT = 8, 10.0


def _pairs(spark: SparkSession, folder: str, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    credits = table(spark, folder, "title_principals").select(clean_key("tconst").alias("basket"), clean_key("nconst").alias("item"))
    return pairs_together(credits, LEAST_TOGETHER, LEAST_LIFT, chunk_items)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select(F.col("a").alias("nconst_a"), F.col("b").alias("nconst_b"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs with their counts and scores: lift, and pointwise mutual information in bits."""
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return _pairs(spark, folder).select(F.col("a").alias("nconst_a"), F.col("b").alias("nconst_b"), "n_ab", "n_a", "n_b", F.round(lift, 4).alias("lift"), F.round(F.log2(lift), 4).alias("pmi"))


#: Items of a chunk that cuts the larger titles of these tables into several.
SMALL_CHUNK = 32


def p4_chunked(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of `p4_found` with their counts, counted with small chunks: titles of a few dozen people are cut already."""
    return _pairs(spark, folder, SMALL_CHUNK).select(F.col("a").alias("nconst_a"), F.col("b").alias("nconst_b"), "n_ab", "n_a", "n_b")


P3_FOUND_SQL = f"""
WITH RECURSIVE e AS (
  SELECT DISTINCT {clean_key_sql("tconst")} AS t, {clean_key_sql("nconst")} AS d FROM title_principals
  WHERE lower(trim(category)) = 'director' AND {clean_key_sql("tconst")} IS NOT NULL AND {clean_key_sql("nconst")} IS NOT NULL),
links AS (SELECT DISTINCT a.t AS x, b.t AS y FROM e a JOIN (SELECT d, min(t) AS t FROM e GROUP BY d) b USING (d)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT x AS tconst, min(y) AS group_tconst FROM reach GROUP BY x HAVING count(*) > 1
"""
_P4_SQL = f"""
WITH h AS (
  SELECT DISTINCT {clean_key_sql("tconst")} AS t, {clean_key_sql("nconst")} AS p FROM title_principals
  WHERE {clean_key_sql("tconst")} IS NOT NULL AND {clean_key_sql("nconst")} IS NOT NULL),
c AS (SELECT p, count(*) AS n FROM h GROUP BY p), total AS (SELECT count(DISTINCT t) AS n FROM h),
pairs AS (SELECT a.p AS a, b.p AS b, count(*) AS n_ab FROM h a JOIN h b ON a.t = b.t AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= {LEAST_TOGETHER}),
scored AS (SELECT a, b, n_ab, x.n AS n_a, y.n AS n_b, total.n AS n FROM pairs JOIN c x ON x.p = a JOIN c y ON y.p = b, total
  WHERE n_ab * total.n >= {LEAST_LIFT:.0f} * x.n * y.n)
"""
P4_FOUND_SQL = _P4_SQL + "SELECT a AS nconst_a, b AS nconst_b FROM scored"
P4_PAIRS_SQL = _P4_SQL + "SELECT a AS nconst_a, b AS nconst_b, n_ab, n_a, n_b, round(n_ab * n / (n_a::DOUBLE * n_b), 4) AS lift, round(log2(n_ab * n / (n_a::DOUBLE * n_b)), 4) AS pmi FROM scored"

QUERIES = {"p3_found": p3_found, "p3_splits": p3_splits, "p3_split_report": p3_split_report, "p3_check": p3_check, "p4_found": p4_found, "p4_pairs": p4_pairs, "p4_chunked": p4_chunked}
ORACLES = {"p3_check": "SELECT split_name, true AS groups_whole, true AS directors_together, true AS share_near FROM split_targets", "p3_found": P3_FOUND_SQL, "p4_found": P4_FOUND_SQL, "p4_pairs": P4_PAIRS_SQL, "p4_chunked": _P4_SQL + "SELECT a AS nconst_a, b AS nconst_b, n_ab, n_a, n_b FROM scored"}
