"""Incremental routing: the checkpoint replaces polling for undecided tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ticketloom.operators.routing import DECISION_COLUMNS, route_tickets
from ticketloom.sources.picks import rules_context
from ticketloom.vocab import DEFAULTS, Thresholds


def route_stream(
    tickets: DataFrame, customers: DataFrame, orders: DataFrame, limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Routing of a stream of tickets against static customers and orders.

    Stateless: a projection over stream-static joins. Each ticket is decided
    once, with the customer and order rows as they are in its micro-batch.
    """
    return route_tickets(rules_context(tickets, customers, orders), limits)


def start_routing(
    tickets: DataFrame, customers: DataFrame, orders: DataFrame, output: str, checkpoint: str, limits: Thresholds = DEFAULTS
) -> StreamingQuery:
    """Appends decisions to Parquet, exactly once; takes what is there and stops."""
    decided = route_stream(tickets, customers, orders, limits).select("ticket_id", *DECISION_COLUMNS)
    writer = decided.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(output)
