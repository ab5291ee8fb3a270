"""The safety scan over a table of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.safety import lowered, violation_codes, violations


def _prepared(texts: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    return texts.select(*keys, F.col(column).alias("_text")).withColumn("_lowered", F.expr(lowered("_text")))


def scan_texts(texts: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``(*keys, pattern_no, code, matched)``: the first match of every pattern that occurs in a text."""
    found = _prepared(texts, column, keys)
    return found.selectExpr(*keys, f"inline({violations('_text', '_lowered')})")


def scan_codes(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, code)``: one row per text and distinct reason code."""
    found = _prepared(texts, column, keys)
    return found.selectExpr(*keys, f"explode({violation_codes('_text', '_lowered')}) AS code")
