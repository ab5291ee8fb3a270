"""N:1 lookups, orphan detection and the owner gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, parents: DataFrame, key: str, row_id: str | None = None) -> DataFrame:
    """Left join of facts to the one parent row named by a nullable key.

    A shuffled join sends every NULL key to one partition, so a third of all
    rows may land in one task. With ``row_id`` the join key of such rows is
    a hash of the row's own id instead: they spread over all partitions, and
    the ``IS NOT NULL`` term in the join condition keeps them unmatched. Hot
    non-NULL keys sit on the facts side, which adaptive execution splits.
    Whether the parents are broadcast is Spark's size-checked choice.
    """
    if row_id is None:
        return facts.join(parents, key, "left")
    spread = F.coalesce(facts[key].cast("bigint"), F.xxhash64(facts[row_id]))
    left = facts.withColumn("_spread", spread)
    right = parents.withColumnRenamed(key, "_parent_key")
    joined = left.join(right, (F.col("_spread") == F.col("_parent_key")) & F.col(key).isNotNull(), "left")
    return joined.drop("_spread", "_parent_key")


def orphans(children: DataFrame, parents: DataFrame, key: str, null_is_orphan: bool = True, row_id: str | None = None) -> DataFrame:
    """Child rows whose key is not among the parents; NULL keys only on request.

    With ``row_id`` rows without a key spread by a hash of their own id, as in
    ``lookup_join``, and match nothing. Only the columns of ``children`` that the
    caller selected travel.
    """
    if not null_is_orphan:
        return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")
    if row_id is None:
        return children.join(parents.select(key), key, "left_anti").select(*children.columns)
    left = children.withColumn("_spread", F.coalesce(children[key].cast("bigint"), F.xxhash64(children[row_id])))
    right = parents.select(F.col(key).alias("_parent_key"))
    return left.join(right, (F.col("_spread") == F.col("_parent_key")) & F.col(key).isNotNull(), "left_anti").drop("_spread")


def childless(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parent rows with no child; the children's keys are made distinct before the join."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


@dataclass(frozen=True)
class Gated:
    """Rows that may be written, and the others."""

    accepted: DataFrame
    quarantine: DataFrame


def split_by_owner(tickets: DataFrame, orders: DataFrame) -> Gated:
    """The gate in front of every write: a ticket's order, if it names one, belongs to the ticket's customer.

    A semi and an anti join on both keys: an order that is there twice adds no
    row, orders are neither aggregated nor made distinct, and adaptive execution
    can split a hot order on the tickets' side. Tickets without an order pass
    and take part in no join. A ticket with an order but no customer owns none.
    """
    owners = orders.select(F.col("order_id").alias("_order"), F.col("customer_id").alias("_owner"))
    own = (F.col("order_id") == F.col("_order")) & (F.col("customer_id") == F.col("_owner"))
    linked = tickets.where(F.col("order_id").isNotNull())
    free = tickets.where(F.col("order_id").isNull())
    return Gated(free.unionByName(linked.join(owners, own, "left_semi")), linked.join(owners, own, "left_anti"))


def owner_gate(tickets: DataFrame, orders: DataFrame) -> DataFrame:
    """All tickets with ``accepted``: whether the gate lets them through."""
    gated = split_by_owner(tickets, orders)
    return gated.accepted.withColumn("accepted", F.lit(True)).unionByName(gated.quarantine.withColumn("accepted", F.lit(False)))


def quarantine_reasons(quarantine: DataFrame, orders: DataFrame) -> DataFrame:
    """Quarantined tickets with ``reason``: ``order_of_other_customer``, or ``no_such_order``."""
    known = orders.select("order_id")
    foreign = quarantine.join(known, "order_id", "left_semi").withColumn("reason", F.lit("order_of_other_customer"))
    return foreign.unionByName(quarantine.join(known, "order_id", "left_anti").withColumn("reason", F.lit("no_such_order")))


def product_names(items: DataFrame, products: DataFrame) -> DataFrame:
    """``(order_id, product_names)``: the order's distinct names, sorted, joined by ', '.

    Repeated lines collapse before the product join, so a product on a third
    of all lines travels once per order, not once per line.
    """
    pairs = items.select("order_id", "product_id").distinct()
    names = pairs.join(products.select("product_id", "product_name"), "product_id").select("order_id", "product_name")
    return names.distinct().groupBy("order_id").agg(
        F.expr("listagg(product_name, ', ') WITHIN GROUP (ORDER BY product_name)").alias("product_names")
    )
