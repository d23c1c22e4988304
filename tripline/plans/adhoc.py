"""Guarded ad-hoc queries (FLT-07)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Words a read-only query must not contain, and the most rows it may return
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "merge", "grant", "revoke", "call", "set", "refresh", "msck", "load")
MOST_ROWS = 1000


def safe_select(spark: SparkSession, sql: str, limit: int) -> DataFrame:
    """FLT-07: a single SELECT without changing words, at most ``limit`` (1 .. 1000) rows.

    Spark parses the text; nothing but a query gets a plan with columns.
    """
    text = sql.strip()
    if not text.lower().startswith("select"):
        raise ValueError("only SELECT statements are allowed")
    if ";" in re.sub(r"'(?:[^'\\]|\\.)*'", "''", text):
        raise ValueError("only one statement is allowed")
    bare = re.sub(r"'(?:[^'\\]|\\.)*'", "''", text)  # words inside string literals change nothing
    bad = re.search(r"\b(" + "|".join(FORBIDDEN) + r")\b", bare, re.IGNORECASE)
    if bad:
        raise ValueError(f"{bad.group(1)!r} is not allowed")
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be 1 .. {MOST_ROWS}")
    return spark.sql(text).limit(limit)
