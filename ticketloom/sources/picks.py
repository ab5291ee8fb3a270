"""Incremental picks and result scans over the tickets table.

A pick takes the pending rows of a stage, by id. ``limit=None`` takes all of
them, unsorted: a global sort would buy nothing for a set-at-a-time run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.joins import lookup_join, product_names


def _pending(tickets: DataFrame, marker: str, only_pending: bool, limit: int | None) -> DataFrame:
    rows = tickets.where(F.col(marker).isNull()) if only_pending else tickets
    return rows if limit is None else rows.orderBy("ticket_id").limit(limit)


def unclassified(tickets: DataFrame, limit: int | None = None, only_unclassified: bool = True) -> DataFrame:
    return _pending(tickets, "ai_predicted_category", only_unclassified, limit).select(
        "ticket_id", "message_text", F.col("category").alias("ground_truth_category")
    )


def _with_parents(
    tickets: DataFrame, customers: DataFrame, orders: DataFrame, order_columns: list, marker: str,
    only_pending: bool, limit: int | None,
) -> DataFrame:
    """Pending tickets with customer segment and order columns.

    The limit counts tickets that have a customer, so with a limit the inner
    join comes first; the order lookup then sees only the picked rows.
    """
    rows = tickets.where(F.col(marker).isNull()) if only_pending else tickets
    owned = rows.join(customers.select("customer_id", "customer_segment"), "customer_id")
    if limit is not None:
        owned = owned.orderBy("ticket_id").limit(limit)
    return lookup_join(owned, orders.select("order_id", *order_columns), "order_id", "ticket_id")


def rules_context(
    tickets: DataFrame, customers: DataFrame, orders: DataFrame, limit: int | None = None, only_undecided: bool = True
) -> DataFrame:
    """What the rules may see; neither the historical nor a predicted priority is among it."""
    narrow = tickets.select(
        "ticket_id", "customer_id", "order_id", "ai_predicted_category", "classification_confidence",
        "sentiment_score", "decision_path",
    )
    value = F.col("total_amount").cast("double").alias("order_value")
    rows = _with_parents(narrow, customers, orders, [value], "decision_path", only_undecided, limit)
    return rows.select(
        "ticket_id", "ai_predicted_category", "classification_confidence", "sentiment_score", "order_id",
        "order_value", "customer_segment",
    )


def response_context(
    tickets: DataFrame,
    customers: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    limit: int | None = None,
    only_unprocessed: bool = True,
) -> DataFrame:
    """What the response layer may see; no name, email, phone, customer id, payment or amount."""
    narrow = tickets.select(
        "ticket_id", "customer_id", "order_id", "message_text", "ai_predicted_category",
        "classification_confidence", "sentiment_score", "decision_path", "final_priority", "response_status",
    )
    columns = [
        F.col("order_status"),
        F.col("expected_delivery_date").cast("string").alias("expected_delivery_date"),
        F.col("actual_delivery_date").cast("string").alias("actual_delivery_date"),
    ]
    rows = _with_parents(narrow, customers, orders, columns, "response_status", only_unprocessed, limit)
    # Names of the picked tickets' orders only.
    items = items.join(rows.select("order_id").where(F.col("order_id").isNotNull()).distinct(), "order_id", "left_semi")
    rows = lookup_join(rows, product_names(items, products), "order_id", "ticket_id")
    return rows.select(
        "ticket_id", "message_text", "ai_predicted_category", "classification_confidence", "sentiment_score",
        "decision_path", "final_priority", "order_id", "order_status", "expected_delivery_date",
        "actual_delivery_date", "customer_segment", "product_names",
    )


def evaluation_rows(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("ai_predicted_category").isNotNull()).select(
        "ticket_id", F.col("category").alias("ground_truth_category"), "ai_predicted_category", "classification_confidence"
    )


def routing_results(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("decision_path").isNotNull()).select(
        "ticket_id", "ai_predicted_category", "classification_confidence", "sentiment_score", "final_priority",
        "decision_path",
    )


def response_results(tickets: DataFrame) -> DataFrame:
    """Stored responses; the draft text itself stays behind."""
    return tickets.where(F.col("response_status").isNotNull()).select(
        "ticket_id", "ai_predicted_category", "decision_path", "final_priority", "response_status", "response_type",
        F.col("response_draft").isNotNull().alias("has_draft"),
    )
