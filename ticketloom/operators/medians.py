"""Exact interpolated quantiles without gathering the values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.sql import any_of, as_list, q

# Bit positions at which a value is cut: each level narrows the search to the
# bins that hold the wanted ranks. With MICROS a histogram has at most 2**20
# bins per group for values below 2**52 (142 years); with HUNDREDTHS at most
# 2**16 for values below 2**32 (81 years in hundredths of a minute, or prices
# below 42 million in cents). Larger values stay exact, with more bins.
MICROS = (32, 12, 0)
HUNDREDTHS = (16, 0)

Share = tuple[int, int]


def _ranks(share: Share) -> tuple[str, str]:
    """Zero-based ranks of the two values that the share lies between."""
    num, den = share
    return f"(({num} * (_total - 1)) div {den})", f"(({num} * (_total - 1) + {den - 1}) div {den})"


def ranked_values(
    df: DataFrame,
    values: Mapping[str, str],
    shares: Sequence[Share],
    by: Sequence[str] = (),
    *,
    levels: Sequence[int] = MICROS,
    weight: str = "1",
) -> DataFrame:
    """``(*by, measure, n, low_0, high_0, low_1, high_1, ...)`` of bigint values, NULLs ignored.

    ``values`` names the measures; all are found in the same passes. For each
    share (a fraction such as ``(9, 10)``) the result holds the two values that
    an interpolated quantile lies between. A built-in percentile keeps every
    distinct value of a group in one task; here each level is a histogram with
    map-side counting, and only the bins around the wanted ranks go on.
    With ``by`` the rows are counted once per group and value, map-side first,
    and all levels read the shuffle of these counts; so however hot a group is,
    a bin holds one row a distinct value. Without ``by`` the picked bins, at
    most two per measure and share, are broadcast and nothing is shuffled but
    histograms. ``weight`` is how often a row counts, as SQL text: for rows that
    are counts of values already.
    """
    keys = [*by, "measure"]
    entries = ", ".join(f"named_struct('measure', {q(n)}, '_v', CAST({e} AS BIGINT))" for n, e in values.items())
    weighted = weight != "1"
    rows = df.selectExpr(*by, *([f"{weight} AS _w"] if weighted else []), f"inline(array({entries}))").where("_v IS NOT NULL")
    once = F.expr("sum(_w)" if weighted else "count(1)")
    if by:
        rows, once = rows.groupBy(*keys, "_v").agg(once.alias("_rows")), F.sum("_rows")
    wanted = [_ranks(s) for s in shares]
    holds = any_of(f"(_base <= {high} AND _base + _n > {low})" for low, high in wanted)
    picked, above = None, None
    for level in levels:
        if picked is None:
            counts = rows.groupBy(*keys, F.expr(f"shiftright(_v, {level})").alias("_bin")).agg(once.alias("_n"))
            whole = Window.partitionBy(*keys)
            counts = counts.withColumns({"_total": F.sum("_n").over(whole), "_base": F.expr("0L")})
            scope = keys
        else:
            inside = picked if by else F.broadcast(picked)
            left = rows.selectExpr("*", f"shiftright(_v, {above}) AS _outer")
            right = inside.selectExpr(*[f"{k} AS _of_{k}" for k in keys], "_outer AS _hit", "_base", "_total")
            same = " AND ".join(f"{k} <=> _of_{k}" for k in keys)
            counts = (
                left.join(right, F.expr(f"_outer = _hit AND {same}"))
                .groupBy(*keys, "_outer", "_base", "_total", F.expr(f"shiftright(_v, {level})").alias("_bin"))
                .agg(once.alias("_n"))
            )
            scope = [*keys, "_outer"]
        running = Window.partitionBy(*scope).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
        picked = counts.where(holds).selectExpr(*keys, "_bin AS _outer", "_base", "_n", "_total")
        above = level

    def at(rank: str) -> str:
        return f"max(CASE WHEN _base <= {rank} AND _base + _n > {rank} THEN _outer END)"

    found = {"n": "max(_total)"}
    for i, (low, high) in enumerate(wanted):
        found |= {f"low_{i}": at(low), f"high_{i}": at(high)}
    return picked.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in found.items()])


def exact_medians(
    df: DataFrame,
    values: Mapping[str, str],
    by: Sequence[str] = (),
    *,
    levels: Sequence[int] = MICROS,
    weight: str = "1",
) -> DataFrame:
    """``(*by, *names)``: per measure the sum of the two middle values, to be halved at the caller's precision.

    Without ``by`` one row, also for no values at all.
    """
    found = ranked_values(df, values, [(1, 2)], by, levels=levels, weight=weight)
    return found.groupBy(*by).agg(
        *[F.expr(f"max(CASE WHEN measure = {q(n)} THEN low_0 + high_0 END)").alias(n) for n in values]
    )


def exact_quantiles(df: DataFrame, value: str, shares: Mapping[str, Share], *, levels: Sequence[int] = MICROS) -> DataFrame:
    """``(n, *names)``: interpolated quantiles of all rows as doubles, in units of the value. No values: 0 and NULLs."""
    found = ranked_values(df, {"value": value}, list(shares.values()), levels=levels)
    columns = {}
    for i, (name, (num, den)) in enumerate(shares.items()):
        part = f"CAST(({num} * (n - 1)) % {den} AS DOUBLE) / {den}D"
        columns[name] = f"low_{i} + (high_{i} - low_{i}) * ({part})"
    bounds = {c: F.max(c).alias(c) for c in found.columns if c not in ("measure", "n")}
    one = found.agg(F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"), *bounds.values())
    return one.selectExpr("n", *as_list(columns))
