"""Connected components of a link table, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import forget, stored


def _toward_minimum(links: DataFrame, *, larger: bool) -> DataFrame:
    """One star step on rows (u, v).

    larger: every neighbour above u is tied to the least of u and its
    neighbours. Otherwise u and its neighbours below are tied to the least one.
    Minima are aggregated before they meet the rows; no neighbour list is built.
    """
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pairs = both if larger else both.where("v < u")
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = pairs.join(least, "u")
    if larger:
        moved = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """``(node, component)`` of every node that has a link; component is the least node reachable.

    links has two bigint columns; self links, repeats and either direction are
    fine. Alternating star steps need a number of rounds that grows with the
    logarithm of the nodes; each round's links are a stored table. The driver
    reads one row of counts a round.
    """
    a, b = links.columns
    links = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v")
    now, before = stored(links.distinct(), purpose), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, last = state, now
        now = stored(_toward_minimum(_toward_minimum(now, larger=True), larger=False), purpose)
        forget(last)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
