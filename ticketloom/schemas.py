"""Explicit schemas of the five tables, with the declared constraints as data."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


CUSTOMERS = _schema(
    ("customer_id", T.LongType(), False),
    ("first_name", T.StringType(), False),
    ("last_name", T.StringType(), False),
    ("email", T.StringType(), False),
    ("phone", T.StringType(), True),
    ("signup_date", T.DateType(), False),
    ("customer_segment", T.StringType(), False),
    ("country", T.StringType(), False),
    ("is_active", T.BooleanType(), False),
)
PRODUCTS = _schema(
    ("product_id", T.LongType(), False),
    ("product_name", T.StringType(), False),
    ("category", T.StringType(), False),
    ("sku", T.StringType(), False),
    ("price", MONEY, False),
    ("stock_quantity", T.IntegerType(), False),
    ("is_active", T.BooleanType(), False),
)
ORDERS = _schema(
    ("order_id", T.LongType(), False),
    ("customer_id", T.LongType(), False),
    ("order_date", T.TimestampNTZType(), False),
    ("order_status", T.StringType(), False),
    ("total_amount", MONEY, False),
    ("payment_method", T.StringType(), False),
    ("expected_delivery_date", T.DateType(), False),
    ("actual_delivery_date", T.DateType(), True),
)
ORDER_ITEMS = _schema(
    ("order_item_id", T.LongType(), False),
    ("order_id", T.LongType(), False),
    ("product_id", T.LongType(), False),
    ("quantity", T.IntegerType(), False),
    ("unit_price", MONEY, False),
    ("line_total", MONEY, False),
)
# The 18 loaded columns; the six below are added by routing and responses.
TICKETS_LOADED = _schema(
    ("ticket_id", T.LongType(), False),
    ("customer_id", T.LongType(), False),
    ("order_id", T.LongType(), True),
    ("channel", T.StringType(), False),
    ("message_text", T.StringType(), False),
    ("category", T.StringType(), False),
    ("ai_predicted_category", T.StringType(), True),
    ("classification_confidence", T.DecimalType(4, 3), True),
    ("priority", T.StringType(), False),
    ("status", T.StringType(), False),
    ("decision_path", T.StringType(), True),
    ("resolution_type", T.StringType(), True),
    ("sentiment_score", T.DecimalType(3, 2), True),
    ("created_at", T.TimestampNTZType(), False),
    ("decision_at", T.TimestampNTZType(), True),
    ("first_response_at", T.TimestampNTZType(), True),
    ("resolved_at", T.TimestampNTZType(), True),
    ("updated_at", T.TimestampNTZType(), False),
)
TICKETS = T.StructType(
    TICKETS_LOADED.fields
    + _schema(
        ("final_priority", T.StringType(), True),
        ("rule_decision_at", T.TimestampNTZType(), True),
        ("response_status", T.StringType(), True),
        ("response_type", T.StringType(), True),
        ("response_draft", T.StringType(), True),
        ("response_generated_at", T.TimestampNTZType(), True),
    ).fields
)
TABLES = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "tickets": TICKETS_LOADED,
}
KEYS = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
    "tickets": "ticket_id",
}

# --- Fixed values: declared text lengths ---------------------------------------------
TEXT_LENGTHS = {
    "customers": {"first_name": 50, "last_name": 50, "email": 100, "phone": 20, "customer_segment": 20, "country": 50},
    "products": {"product_name": 150, "category": 50, "sku": 30},
    "orders": {"order_status": 20, "payment_method": 20},
    "order_items": {},
    "tickets": {
        "channel": 20,
        "category": 30,
        "ai_predicted_category": 30,
        "priority": 10,
        "status": 20,
        "decision_path": 15,
        "resolution_type": 15,
        "final_priority": 10,
        "response_status": 20,
        "response_type": 20,
    },
}


def required(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]
