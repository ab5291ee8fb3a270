"""Metrics that are kept up to date: every change of a ticket is its old row taken away and its new row added.

Counts and sums are one row of signed aggregates. What a signed sum cannot give
back, extremes and medians, comes from the multiset of values, kept as counts
per value. Merging two states adds them up, in any order; a value whose count
reaches zero is gone. A write-back costs the rows it changed, not the table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions.numeric import micros_between
from ticketloom.functions.sql import q
from ticketloom.operators import views
from ticketloom.operators.medians import exact_medians
from ticketloom.operators.views import MetricView

#: Whole thousandths: the stored confidence has three decimals.
CONFIDENCE = "confidence"


@dataclass(frozen=True)
class State:
    """counters: one row, ``<view>_<aggregate>``. values: ``(measure, value, n)``, n never zero."""

    counters: DataFrame
    values: DataFrame


def signed(aggregate: str) -> str | None:
    """An additive aggregate over rows that carry a ``sign``; None for extremes, which are not additive."""
    if aggregate == "count(1)":
        return "coalesce(sum(sign), 0)"
    name, inner = re.fullmatch(r"(\w+)\((.*)\)", aggregate, re.DOTALL).groups()
    if name == "count":
        return f"coalesce(sum(IF(({inner}) IS NULL, 0, sign)), 0)"
    if name == "count_if":
        return f"coalesce(sum(IF({inner}, sign, 0)), 0)"
    if name == "sum":
        return f"coalesce(sum(({inner}) * sign), 0)"
    if name in ("min", "max"):
        return None
    raise ValueError(f"no signed form of {aggregate}")


def _additive(shapes: dict[str, MetricView]) -> dict[str, str]:
    forms = {f"{view}_{name}": signed(a) for view, v in shapes.items() for name, a in v.aggregates.items()}
    return {n: f for n, f in forms.items() if f is not None}


def _measures(shapes: dict[str, MetricView]) -> dict[str, str]:
    """What is kept as counts per value, as SQL text."""
    ends = {name: micros_between("created_at", end) for name, (end, _) in views.median_columns(shapes).items()}
    return {CONFIDENCE: "CAST(classification_confidence * 1000 AS BIGINT)"} | ends


def needed(columns: Sequence[str], shapes: dict[str, MetricView] | None = None) -> list[str]:
    """Those of the columns that a state is made from."""
    shapes = shapes or views.all_views()
    words = set(re.findall(r"\w+", " ".join([*_additive(shapes).values(), *_measures(shapes).values()])))
    return [c for c in columns if c in words]


def state_of(rows: DataFrame, shapes: dict[str, MetricView] | None = None) -> State:
    """The state of tickets, or the difference that changes make: rows with a ``sign`` of 1 or -1 (none: all 1)."""
    shapes = shapes or views.all_views()
    if "sign" not in rows.columns:
        rows = rows.withColumn("sign", F.lit(1))
    counters = rows.agg(*[F.expr(f).alias(n) for n, f in _additive(shapes).items()])
    entries = ", ".join(f"named_struct('measure', {q(m)}, 'value', {v})" for m, v in _measures(shapes).items())
    values = rows.selectExpr("sign", f"inline(array({entries}))").where("value IS NOT NULL")
    values = values.groupBy("measure", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    return State(counters, values)


def merged(a: State, b: State) -> State:
    """Both states added up."""
    names = a.counters.columns
    counters = a.counters.unionByName(b.counters).agg(*[F.sum(n).cast(a.counters.schema[n].dataType).alias(n) for n in names])
    values = a.values.unionByName(b.values).groupBy("measure", "value").agg(F.sum("n").alias("n")).where("n <> 0")
    return State(counters, values)


def save(state: State, path: str) -> State:
    """The state as two tables under a new path; what reads it later does not go back to the tickets."""
    for name, frame in (("counters", state.counters), ("values", state.values)):
        frame.write.mode("errorifexists").parquet(f"{path}/{name}")
    return load(state.counters.sparkSession, path)


def load(spark: SparkSession, path: str) -> State:
    return State(spark.read.parquet(f"{path}/counters"), spark.read.parquet(f"{path}/values"))


def metrics(state: State, shapes: dict[str, MetricView] | None = None) -> DataFrame:
    """The metric views, as ``views.evaluate_views`` gives them for the tickets of the state."""
    shapes = shapes or views.all_views()
    row = state.counters
    confidence = state.values.where(F.col("measure") == CONFIDENCE)
    ends = confidence.agg(F.min("value").alias("least"), F.max("value").alias("most"))
    extremes = {"min": "least", "max": "most"}
    for view, v in shapes.items():
        for name, a in v.aggregates.items():
            if a[:3] in extremes:
                end = ends.select((F.col(extremes[a[:3]]).cast("decimal(18,0)") / 1000).cast("decimal(4,3)")).scalar()
                row = row.withColumn(f"{view}_{name}", end)
    medians = views.median_columns(shapes)
    if medians:
        own = {m: f"IF(measure = {q(m)}, value, NULL)" for m in medians}
        row = views.with_medians(row, exact_medians(state.values, own, weight="n"), medians)
    # A sum over no values is none, as in the views.
    return views.shown(row, shapes)
