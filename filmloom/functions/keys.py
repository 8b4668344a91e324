"""Identifier normalisation shared by every query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_key(column: Column | str) -> Column:
    r"""Key in comparable form: blanks trimmed, lower case; null, empty and `\N` give null."""
    key = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when((key != "") & (key != "\\n"), key)


def clean_key_sql(column: str) -> str:
    """The same as SQL text for the oracle."""
    return rf"CASE WHEN lower(trim({column})) NOT IN ('', '\n') THEN lower(trim({column})) END"
