"""Approximate medians over any slice of days, from mergeable quantile sketches; beside the exact ones.

One sketch per day, key and duration is a few kilobytes however many tickets
the day has. Sketches merge, so a slice of any days and keys reads them and not
the tickets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.measures import MEDIANS, created_date

SKETCH_SIZE = 800


def rank_error(size: int = SKETCH_SIZE) -> float:
    """How far off the rank of one quantile may be, as a share of all values; holds with a chance of 99 in 100."""
    return 2.296 / size**0.9723


def sketched(rows: DataFrame, values: Mapping[str, str], by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """``(*by, rows, <name>_sketch)``: one sketch per group and bigint value; sketches of a task merge before the shuffle.

    NULL values are left out; a group without values has a NULL sketch.
    """
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for name, value in values.items():
        known = F.expr(f"CAST({value} AS BIGINT)")
        made = F.kll_sketch_agg_bigint(known, F.lit(size))
        aggregates.append(F.when(F.count(known) > 0, made).alias(f"{name}_sketch"))
    return rows.groupBy(*by).agg(*aggregates)


def daily_sketches(fact: DataFrame, by: Sequence[str] = ("channel",), size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of the two durations (hundredths) per creation day and key; to be written and added to day by day."""
    return sketched(created_date(fact), {name: f"{column} * 100" for name, column in MEDIANS}, ["created_date", *by], size)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of coarser groups, e.g. of all days of a channel."""
    names = [c for c in sketches.columns if c.endswith("_sketch")]
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *[F.when(F.count(n) > 0, F.kll_merge_agg_bigint(n)).alias(n) for n in names],
    )


def quantiles(sketches: DataFrame, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, rows, <name>_<share>)`` of each sketch column; NULL where there are no values."""
    names = [c.removesuffix("_sketch") for c in sketches.columns if c.endswith("_sketch")]
    return sketches.select(
        *by, "rows",
        *[
            F.when(F.col(f"{n}_sketch").isNotNull(), F.kll_sketch_get_quantile_bigint(f"{n}_sketch", F.lit(share))).alias(f"{n}_{label}")
            for n in names for label, share in shares.items()
        ],
    )


def median_measures(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ticket count and approximate medians per slice, with the columns of ``measures.median_measures``."""
    found = quantiles(merged(sketches, by), {"p50": 0.5}, by)
    return found.select(*by, F.col("rows").alias("total_tickets"), *[(F.col(f"{n}_p50") / 100).alias(n) for n, _ in MEDIANS])
