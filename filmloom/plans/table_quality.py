"""Registered queries of the general operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions.keys import clean_key, clean_key_sql
from filmloom.operators.deliveries import parse_deliveries, plain_text
from filmloom.operators.orphans import count_deltas, current_orphans, merge_counts, orphan_references
from filmloom.operators.packed import explode_packed
from filmloom.operators.skew import LoadPlan, fragment_replicate_join, per_key_counts, plan_loads
from filmloom.operators.snapshots import snapshot_changes
from filmloom.scratch import cut
from filmloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rating = F.round("averageRating", 1) + F.lit(0.0)  # no negative zero
    changes = snapshot_changes(
        table(spark, folder, "title_ratings"), F.col("snapshot_date"), clean_key("tconst"), [rating, F.col("numVotes")], F.col("delivered_at")
    )
    return changes.select(F.date_format("snapshot", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("tconst"), "change_kind")


P1_FOUND_SQL = f"""
WITH latest AS (
  SELECT snapshot_date AS d, {clean_key_sql("tconst")} AS tconst, round(averageRating, 1) AS r, numVotes AS v
  FROM title_ratings WHERE snapshot_date IS NOT NULL AND {clean_key_sql("tconst")} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_date, {clean_key_sql("tconst")} ORDER BY delivered_at DESC NULLS LAST) = 1),
dates AS (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM latest)),
later AS (SELECT * FROM latest JOIN dates USING (d) WHERE p IS NOT NULL),
earlier AS (SELECT dates.d, tconst, r, v FROM latest JOIN dates ON latest.d = dates.p)
SELECT strftime(coalesce(a.d, b.d), '%Y-%m-%d') AS snapshot_date, coalesce(a.tconst, b.tconst) AS tconst,
  CASE WHEN b.tconst IS NULL THEN 'added' WHEN a.tconst IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM later a FULL JOIN earlier b ON a.d = b.d AND a.tconst = b.tconst
WHERE b.tconst IS NULL OR a.tconst IS NULL OR a.r IS DISTINCT FROM b.r OR a.v IS DISTINCT FROM b.v
"""


#: Tables that refer, by key and time, and the tables they refer to.
REFERENCES = (("title_principals", "nconst", "recorded_at", "name_basics"), ("title_ratings", "tconst", "snapshot_date", "title_basics"))


def _lifetimes(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    return table(spark, folder, name).select(
        clean_key(key).alias("key"), F.col("added_at").cast("timestamp_ntz").alias("start"), F.col("deleted_at").cast("timestamp_ntz").alias("end")
    )


def _refs(spark: SparkSession, folder: str, name: str, key: str, time: str) -> DataFrame:
    return table(spark, folder, name).select(clean_key(key).alias("key"), F.col(time).cast("timestamp_ntz").alias("t"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        orphan_references(_refs(spark, folder, source, key, time), _lifetimes(spark, folder, target, key)).select(F.lit(source).alias("source_table"), "ref_month", F.col("key").alias("ref_key"))
        for source, key, time, target in REFERENCES
    ]
    return parts[0].union(parts[1])


def p2_current(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that are referred to and have no row left, with their references: the report of the signed counts.

    The counts up to the last month of references are a stored table; what has happened since is merged into it.
    """
    parts = []
    for source, key, time, target in REFERENCES:
        refs, rows = _refs(spark, folder, source, key, time).where("t is not null"), _lifetimes(spark, folder, target, key)
        month = refs.agg(F.date_trunc("month", F.max("t")).cast("timestamp_ntz")).first()[0]
        past = count_deltas(refs, rows, until=month)
        counts = merge_counts(past.limit(0), past)
        if month is not None:
            counts = merge_counts(cut(counts.where("refs <> 0 or existing <> 0")), count_deltas(refs, rows, since=month))
        parts.append(current_orphans(counts).select(F.lit(source).alias("source_table"), F.col("key").alias("ref_key"), F.col("refs").alias("n_refs")))
    return parts[0].union(parts[1])


def _p2_current_sql(source: str, key: str, time: str, target: str) -> str:
    return f"""
SELECT '{source}' AS source_table, k AS ref_key, count(*) AS n_refs FROM (SELECT {clean_key_sql(key)} AS k FROM {source} WHERE {time} IS NOT NULL)
WHERE k IS NOT NULL AND k NOT IN (SELECT {clean_key_sql(key)} FROM {target} WHERE {clean_key_sql(key)} IS NOT NULL AND added_at IS NOT NULL AND deleted_at IS NULL) GROUP BY k"""


P2_CURRENT_SQL = "\nUNION ALL".join(_p2_current_sql(*r) for r in REFERENCES)


def _p2_sql(source: str, key: str, time: str, target: str) -> str:
    return f"""
SELECT DISTINCT '{source}' AS source_table, strftime(r.t, '%Y-%m') AS ref_month, r.k AS ref_key
FROM (SELECT DISTINCT {clean_key_sql(key)} AS k, CAST({time} AS TIMESTAMP) AS t FROM {source}) r
LEFT JOIN (SELECT DISTINCT {clean_key_sql(key)} AS k, added_at, deleted_at FROM {target}) d
  ON r.k = d.k AND d.added_at <= r.t AND (d.deleted_at IS NULL OR d.deleted_at > r.t)
WHERE r.k IS NOT NULL AND r.t IS NOT NULL AND d.k IS NULL"""


P2_FOUND_SQL = "\nUNION ALL".join(_p2_sql(*r) for r in REFERENCES)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "title_basics").select(clean_key("tconst").alias("tconst"), "genres").where("tconst is not null")
    values = explode_packed(titles, "tconst", "genres")
    return values.select(F.col("key").alias("tconst"), "pos", F.col("value").alias("genre")).distinct()


P6_FOUND_SQL = rf"""
WITH fields AS (
  SELECT DISTINCT {clean_key_sql("tconst")} AS tconst, genres FROM title_basics
  WHERE {clean_key_sql("tconst")} IS NOT NULL AND trim(genres) <> '\N'),
places AS (
  SELECT tconst, string_split(regexp_replace(genres || ',', '((?:[^",;/|·，]|"[^"]*")*)[,;/|·，]', '\1' || chr(31), 'g'), chr(31))[:-2] AS v FROM fields),
parts AS (SELECT tconst, unnest(range(1, len(v) + 1)) AS pos, trim(unnest(v)) AS t FROM places)
SELECT DISTINCT tconst, pos,
  CASE WHEN t LIKE '"%"' AND length(t) > 1 AND NOT contains(replace(t[2:-2], '""', ''), '"') THEN replace(t[2:-2], '""', '"') ELSE t END AS genre
FROM parts WHERE t NOT IN ('', '""')
"""

#: Fields and bounds of a title_basics delivery line.
RAW_FIELDS = 6
RAW_CHECKS = [("startyear", 3, 1850, 2100), ("runtimeminutes", 4, 1, 1000)]


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse_deliveries(table(spark, folder, "title_basics_raw"), "raw_id", "line", RAW_FIELDS, RAW_CHECKS)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).where("reason is not null").select(F.col("row_id").alias("raw_id"), "reason")


def p7_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The failing lines with the edits that would mend their structure."""
    return _parsed(spark, folder).where("reason is not null").select(F.col("row_id").alias("raw_id"), "reason", "edits")


def p7_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The failing lines with the numbers of quotes and delimiters that the cheapest parse inserts or deletes."""
    return _parsed(spark, folder).where("reason is not null").select(F.col("row_id").alias("raw_id"), "reason", "quote_edits", "delimiter_edits")


def p7_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The sound lines as typed title_basics rows; genres keep their packed form, which has quotes of its own."""
    field = F.col("fields")
    number = lambda i: F.when(F.trim(field[i]) != "\\N", F.trim(field[i])).try_cast("bigint")
    return _parsed(spark, folder).where("reason is null").select(
        F.col("row_id").alias("raw_id"),
        plain_text(field[0]).alias("tconst"),
        plain_text(field[1]).alias("titleType"),
        plain_text(field[2]).alias("primaryTitle"),
        number(3).alias("startYear"),
        number(4).alias("runtimeMinutes"),
        F.when(field[5] != "\\N", field[5]).alias("genres"),
    )


_P7_PARTS_SQL = r"""
WITH cut AS (
  SELECT raw_id, coalesce(line, '') AS l, length(coalesce(line, '')) - length(replace(coalesce(line, ''), '"', '')) AS quotes FROM title_basics_raw),
split AS (
  SELECT raw_id, quotes, string_split(regexp_replace(l || chr(9), '((?:[^"\t]|"[^"]*")*)\t', '\1' || chr(31), 'g'), chr(31))[:-2] AS f FROM cut),
judged AS (
  SELECT raw_id, f, CASE WHEN quotes % 2 = 1 THEN 'quoting' WHEN len(f) <> 6 THEN 'columns'
    WHEN NOT (trim(f[4]) = '\N' OR (regexp_full_match(trim(f[4]), '[0-9]+') AND coalesce(TRY_CAST(trim(f[4]) AS HUGEINT) BETWEEN 1850 AND 2100, false))) THEN 'startyear'
    WHEN NOT (trim(f[5]) = '\N' OR (regexp_full_match(trim(f[5]), '[0-9]+') AND coalesce(TRY_CAST(trim(f[5]) AS HUGEINT) BETWEEN 1 AND 1000, false))) THEN 'runtimeminutes'
  END AS reason FROM split)
"""
P7_FOUND_SQL = _P7_PARTS_SQL + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL"


# With an odd number of quotes one is put in or left out at some place, from which on what was inside is outside.
P7_EDIT_COUNTS_SQL = _P7_PARTS_SQL + r""",
tokens AS (SELECT raw_id, unnest(t) AS c, generate_subscripts(t, 1) AS k FROM (SELECT raw_id, regexp_extract_all(l, '["	]') AS t FROM cut WHERE quotes % 2 = 1)),
sides AS (SELECT raw_id, k, c, sum(CASE WHEN c = '"' THEN 1 ELSE 0 END) OVER (PARTITION BY raw_id ORDER BY k) % 2 AS inside FROM tokens),
tabs AS (SELECT raw_id, k, inside FROM sides WHERE c = chr(9)),
turned AS (
  SELECT raw_id, sum(1 - inside) OVER up_to + sum(inside) OVER (PARTITION BY raw_id) - sum(inside) OVER up_to AS outside FROM tabs WINDOW up_to AS (PARTITION BY raw_id ORDER BY k)
  UNION ALL SELECT raw_id, sum(inside) FROM tabs GROUP BY raw_id),
best AS (SELECT raw_id, min(abs(outside - 5)) AS d FROM turned GROUP BY raw_id)
SELECT raw_id, reason, CAST(quotes % 2 AS BIGINT) AS quote_edits, CAST(CASE WHEN quotes % 2 = 1 THEN coalesce(d, 5) ELSE abs(len(f) - 6) END AS BIGINT) AS delimiter_edits
FROM judged JOIN cut USING (raw_id) LEFT JOIN best USING (raw_id) WHERE reason IS NOT NULL"""


def _plain_sql(x: str) -> str:
    return rf"""CASE WHEN {x} <> '\N' THEN CASE WHEN regexp_full_match({x}, '"([^"]|"")*"') THEN replace({x}[2:-2], '""', '"') ELSE {x} END END"""


P7_LOADED_SQL = (
    _P7_PARTS_SQL
    + rf"""SELECT raw_id, {_plain_sql("f[1]")} AS tconst, {_plain_sql("f[2]")} AS titleType, {_plain_sql("f[3]")} AS primaryTitle,
  TRY_CAST(nullif(trim(f[4]), '\N') AS BIGINT) AS startYear, TRY_CAST(nullif(trim(f[5]), '\N') AS BIGINT) AS runtimeMinutes, nullif(f[6], '\N') AS genres
FROM judged WHERE reason IS NULL"""
)


#: Key columns of title_principals by their number in load plans.
KEY_COLUMNS = ("nconst", "tconst")
#: A heavy key holds at least one row in so many.
ONE_IN = 100


def _credit_keys(spark: SparkSession, folder: str) -> tuple[DataFrame, LoadPlan]:
    """Each credit once per key column, its other key as the partner, and the plan of their loads."""
    credits = table(spark, folder, "title_principals").select(
        clean_key("nconst").alias("nconst"), clean_key("tconst").alias("tconst"), F.lower(F.trim("category")).alias("category")
    )
    side = lambda i: F.struct(F.lit(i).alias("kind"), F.col(KEY_COLUMNS[i]).alias("key"), F.col(KEY_COLUMNS[1 - i]).alias("partner"))
    keyed = credits.select(F.explode(F.array(side(0), side(1))).alias("k"), "category").select("k.*", "category")
    return keyed, plan_loads(keyed.select("kind", "key", "partner"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    keyed, plan = _credit_keys(spark, folder)
    heavy = per_key_counts(keyed, plan).where(F.col("n_rows") * ONE_IN >= plan.rows)
    return heavy.select(F.element_at(F.lit(list(KEY_COLUMNS)), F.col("kind") + 1).alias("key_column"), F.col("key").alias("key_value"))


def p5_key_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct partners (a person's titles, a title's people) and distinct categories of every key."""
    keyed, plan = _credit_keys(spark, folder)
    return per_key_counts(keyed, plan).select(
        F.element_at(F.lit(list(KEY_COLUMNS)), F.col("kind") + 1).alias("key_column"), F.col("key").alias("key_value"), "n_rows", "n_partners", "n_categories"
    )


def p5_named_credits(spark: SparkSession, folder: str) -> DataFrame:
    """Credits per person and title with the person's name: the alphabetically first where spellings differ."""
    rows = table(spark, folder, "title_principals").select(F.lit(0).alias("kind"), clean_key("nconst").alias("key"), clean_key("tconst").alias("tconst"), "ordering")
    plan = plan_loads(rows.select("kind", "key"))
    names = table(spark, folder, "name_basics").groupBy(clean_key("nconst").alias("key")).agg(F.min("primaryName").alias("primaryName")).select(F.lit(0).alias("kind"), "*")
    joined = fragment_replicate_join(rows, names, plan, F.xxhash64("tconst", "ordering"))
    return joined.select("tconst", "ordering", F.col("key").alias("nconst"), "primaryName")


_CREDITS_SQL = f"WITH c AS (SELECT {clean_key_sql('nconst')} AS nconst, {clean_key_sql('tconst')} AS tconst, lower(trim(category)) AS category FROM title_principals)"
P5_KEY_COUNTS_SQL = f"""{_CREDITS_SQL}
SELECT 'nconst' AS key_column, nconst AS key_value, count(*) AS n_rows, count(DISTINCT tconst) AS n_partners, count(DISTINCT category) AS n_categories
FROM c WHERE nconst IS NOT NULL GROUP BY nconst
UNION ALL SELECT 'tconst', tconst, count(*), count(DISTINCT nconst), count(DISTINCT category) FROM c WHERE tconst IS NOT NULL GROUP BY tconst
"""
P5_FOUND_SQL = f"""{_CREDITS_SQL}
SELECT 'nconst' AS key_column, nconst AS key_value FROM c WHERE nconst IS NOT NULL GROUP BY nconst HAVING count(*) * {ONE_IN} >= (SELECT count(*) FROM c)
UNION ALL SELECT 'tconst', tconst FROM c WHERE tconst IS NOT NULL GROUP BY tconst HAVING count(*) * {ONE_IN} >= (SELECT count(*) FROM c)
"""
P5_NAMED_CREDITS_SQL = f"""
SELECT {clean_key_sql("p.tconst")} AS tconst, p.ordering, {clean_key_sql("p.nconst")} AS nconst, n.primaryName
FROM title_principals p LEFT JOIN (SELECT {clean_key_sql("nconst")} AS k, min(primaryName) AS primaryName FROM name_basics GROUP BY 1) n ON n.k = {clean_key_sql("p.nconst")}
"""

QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_current": p2_current,
    "p5_found": p5_found,
    "p5_key_counts": p5_key_counts,
    "p5_named_credits": p5_named_credits,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_loaded": p7_loaded,
    "p7_edits": p7_edits,
    "p7_edit_counts": p7_edit_counts,
}
ORACLES = {
    "p1_found": P1_FOUND_SQL,
    "p2_found": P2_FOUND_SQL,
    "p2_current": P2_CURRENT_SQL,
    "p5_found": P5_FOUND_SQL,
    "p5_key_counts": P5_KEY_COUNTS_SQL,
    "p5_named_credits": P5_NAMED_CREDITS_SQL,
    "p6_found": P6_FOUND_SQL,
    "p7_found": P7_FOUND_SQL,
    "p7_loaded": P7_LOADED_SQL,
    "p7_edit_counts": P7_EDIT_COUNTS_SQL,
}
