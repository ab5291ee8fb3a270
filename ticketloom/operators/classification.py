"""Validation of structured classifier output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions.jsonfields import field, json_object, lenient_boolean, lenient_double, lenient_long
from ticketloom.functions.sql import fill, listed, settled, true


def classification_prompt(message: str) -> str:
    # --- Fixed values: prompt wording ---
    return fill('Customer support message:\n"""\n{message}\n"""', message=message)


def _bounded(value: str, low: float, high: float) -> str:
    """In range; NULL and NaN are not."""
    return true(f"{value} BETWEEN {low} AND {high}")


FIELDS = ["category", "priority", "sentiment_score", "confidence", "order_id", "mentions_customer_info"]


def validate_classifications(outputs: DataFrame) -> DataFrame:
    """Raw outputs ``(ticket_id, tool_input_json, error_type, ...)`` with ``success`` and typed fields.

    ``error_type`` becomes: the caller's own code; ``malformed_response`` for
    anything but a JSON object; ``invalid_category``, ``invalid_priority`` or
    ``invalid_response_schema``, in this order of precedence. A missing
    category counts as an invalid one. Failed rows carry no fields. Number
    fields accept quoted numbers and booleans, the order id also ``3.0``.
    """
    text = "CASE WHEN _{0}.kind = 'STRING' THEN _{0}.text END"
    typed = {
        "_category_value": text.format("category"),
        "_priority_value": text.format("priority"),
        "_sentiment_value": lenient_double("_sentiment_score"),
        "_confidence_value": lenient_double("_confidence"),
        "_order_value": lenient_long("_order_id"),
        "_mentions_value": lenient_boolean("_mentions_customer_info"),
    }
    fits = (
        f"{_bounded('_sentiment_value', -1, 1)} AND {_bounded('_confidence_value', 0, 1)} "
        "AND (_order_id.kind IS NULL OR _order_id.kind = 'VOID' OR _order_value IS NOT NULL) "
        "AND (_mentions_customer_info.kind IS NULL OR _mentions_value IS NOT NULL)"
    )
    error = (
        "CASE WHEN error_type IS NOT NULL THEN error_type WHEN _document IS NULL THEN 'malformed_response' "
        f"WHEN NOT {true(f'_category_value IN {listed(vocab.CATEGORIES)}')} THEN 'invalid_category' "
        f"WHEN NOT {true(f'_priority_value IN {listed(vocab.PRIORITIES)}')} THEN 'invalid_priority' "
        f"WHEN NOT ({fits}) THEN 'invalid_response_schema' END"
    )
    ok = "CASE WHEN error_type IS NULL THEN {} END"
    result = {
        "success": "error_type IS NULL",
        "category": ok.format("_category_value"),
        "priority": ok.format("_priority_value"),
        "sentiment_score": ok.format("_sentiment_value"),
        "confidence": ok.format("_confidence_value"),
        "order_id": ok.format("_order_value"),
        "mentions_customer_info": ok.format("coalesce(_mentions_value, false)"),
    }
    for tokens in ("input_tokens", "output_tokens"):
        result[tokens] = f"coalesce({tokens}, 0L)" if tokens in outputs.columns else "0L"
    steps = [
        {"_document": json_object("tool_input_json")},
        {f"_{name}": field("_document", name) for name in FIELDS},
    ]
    rows = outputs
    for step in steps:
        rows = rows.withColumns({n: F.expr(e) for n, e in step.items()})
    rows = rows.selectExpr("*", settled(typed)).selectExpr("*", settled({"_error": error})).withColumn("error_type", F.col("_error"))
    rows = rows.withColumns({n: F.expr(e) for n, e in result.items()})
    return rows.drop("_document", "_error", *[f"_{name}" for name in FIELDS], *typed)


def classification_updates(validated: DataFrame, run_at: Column) -> DataFrame:
    """Update rows for the write-back; failed predictions never reach it."""
    return validated.where("success").select(
        "ticket_id",
        F.col("category").alias("ai_predicted_category"),
        F.col("confidence").cast("decimal(4,3)").alias("classification_confidence"),
        F.col("sentiment_score").cast("decimal(3,2)").alias("sentiment_score"),
        run_at.alias("decision_at"),
    )
