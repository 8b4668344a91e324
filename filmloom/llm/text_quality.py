"""Registered queries over documents: leaked passages, mixtures, wrong encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.llm.encodings import WrongEncodings
from filmloom.llm.leaks import LEAK_WORDS, leaks, removal_spans
from filmloom.llm.mixture import Target, mix, mix_report
from filmloom.llm.tokens import token_count
from filmloom.scratch import cut
from filmloom.sources.tables import table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """What to cut from each document, with the items that leaked into it."""
    spans = removal_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return spans.select("doc_id", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"), "span_start", "span_end")


def _windows_sql(name: str, key: str) -> str:
    return rf"""(SELECT DISTINCT {key}, list_aggregate(w[i:i + {LEAK_WORDS - 1}], 'string_agg', ' ') AS phrase FROM (
  SELECT {key}, w, unnest(range(1, len(w) - {LEAK_WORDS - 2})) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {name}) WHERE len(w) >= {LEAK_WORDS}))"""


P8_FOUND_SQL = f"""SELECT DISTINCT d.doc_id, e.item_id FROM {_windows_sql("documents", "doc_id")} d JOIN {_windows_sql("eval_items", "item_id")} e USING (phrase)"""


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return WrongEncodings(table(spark, folder, "documents")).found().select(F.col("doc").alias("doc_id"))


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The cases with their restored text; `complete` tells whether nothing of it is lost."""
    return WrongEncodings(table(spark, folder, "documents")).restored().select(F.col("doc").alias("doc_id"), "restored", "complete")


def source_name(column: str) -> Column:
    """A source in comparable form: outer white space goes, hyphens, underscores and blanks are the same, lower case."""
    name = F.translate(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), "- ", "__")
    return F.when(name != "", name)


def _targets(spark: SparkSession, folder: str) -> list[Target]:
    """Targets of sources by comparable name; rows of one source add their shares and allow their largest repeats."""
    rows = table(spark, folder, "mix_targets").select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    rows = rows.groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("repeats"))
    return sorted((Target(r["source"], r["share"], r["repeats"]) for r in rows.collect()), key=lambda t: t.source)


def _mixed(spark: SparkSession, folder: str, targets: list[Target]) -> DataFrame:
    asked = table(spark, folder, "documents").select("doc_id", source_name("source").alias("source"), "text").where(F.col("source").isin([t.source for t in targets]))
    texts = asked.select("doc_id", "source", F.sha2("text", 256).alias("record"), token_count()("text").alias("tokens"))
    return mix(texts, targets)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Which record each source contributes, how often, and its tokens."""
    return _mixed(spark, folder, _targets(spark, folder))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = _targets(spark, folder)
    report = mix_report(_mixed(spark, folder, targets), targets)
    return report.select("source", "target_share", "actual_share", "max_repeats", "most_uses", "tokens", "uses", "records")


#: What a source's tokens may lack or exceed, as a share of all tokens, and in records where these are few.
SHARE_TOLERANCE, RECORDS = 0.01, 5


def p9_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each target source has its share, scaled to the sources with documents, uses no record too often, names
    every record once, and only its own ones."""
    targets = _targets(spark, folder)
    mixed = cut(_mixed(spark, folder, targets))
    own = table(spark, folder, "documents").select("doc_id", source_name("source").alias("source")).where("doc_id is not null")
    strange = mixed.join(own, ["doc_id", "source"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("strange"))
    names = mixed.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("named"), F.count(F.lit(1)).alias("docs"))
    rows = mix_report(mixed, targets).join(strange, "source", "left").join(names, "source", "left")
    largest, total = (x or 0 for x in mixed.agg(F.max("tokens"), F.sum(F.col("tokens") * F.col("uses"))).first())
    live = F.sum(F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0)).over(Window.partitionBy())  # one row per target
    wanted = F.when(F.col("tokens") > 0, F.col("target_share") / live).otherwise(0) * total
    near = F.abs(F.col("tokens") - wanted) <= F.lit(max(SHARE_TOLERANCE * total, RECORDS * largest))
    return rows.select("source", near.alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"), (F.coalesce("named", F.lit(1)) == 1).alias("named_once"), F.col("strange").isNull().alias("own_records"))


P9_CHECK_SQL = r"""SELECT DISTINCT translate(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '- ', '__') AS source, true AS share_met, true AS repeats_kept, true AS named_once, true AS own_records
FROM mix_targets WHERE trim(source) <> ''"""

# Words with their places in characters, windows of item words among them, and runs of windows that overlap or touch.
P8_SPANS_SQL = rf"""
WITH pieces AS (
  SELECT doc_id, unnest(t) AS piece, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS t FROM documents)),
placed AS (SELECT doc_id, piece, k, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM pieces),
words AS (SELECT doc_id, lower(piece) AS w, e - length(piece) AS s, e, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM placed WHERE regexp_matches(piece, '[\p{{L}}\p{{N}}]')),
windows AS (SELECT doc_id, i, s, string_agg(w, ' ') OVER ahead AS phrase, max(e) OVER ahead AS e, count(*) OVER ahead AS n FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {LEAK_WORDS - 1} FOLLOWING)),
hits AS (SELECT doc_id, i, s, windows.e, item_id FROM windows JOIN {_windows_sql("eval_items", "item_id")} USING (phrase) WHERE n = {LEAK_WORDS}),
places AS (SELECT DISTINCT doc_id, i, s, e FROM hits),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LEAK_WORDS} THEN 0 ELSE 1 END AS opens FROM places),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
owners AS (SELECT doc_id, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, items, CAST(min(s) AS BIGINT) AS span_start, CAST(max(e) AS BIGINT) AS span_end FROM grouped JOIN owners USING (doc_id) GROUP BY doc_id, items, span"""

QUERIES = {"p8_found": p8_found, "p8_spans": p8_spans, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_check": p9_check, "p10_found": p10_found, "p10_restored": p10_restored}
ORACLES = {"p8_found": P8_FOUND_SQL, "p8_spans": P8_SPANS_SQL, "p9_check": P9_CHECK_SQL}
