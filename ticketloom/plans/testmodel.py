"""Ticket model derived from the star-schema test tables.

The column expressions are plain SQL that reads the same in Spark and in the
checking engine; both build the model from this one text. Ids pick the values,
so the model is deterministic, and it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.operators.joins import lookup_join
from ticketloom.operators.responses import decide_responses
from ticketloom.operators.routing import route_tickets
from ticketloom.session import shared_folder


def _pick(selector: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {selector} {cases} END"


# --- Fixed values: the derived columns ----------------------------------------------
CUSTOMERS = {
    "customer_id": "c_custkey",
    "first_name": "concat('First', CAST(c_custkey % 97 AS VARCHAR(10)))",
    "last_name": "c_name",
    "email": "concat('c', CAST(c_custkey AS VARCHAR(20)), '@example.com')",
    "phone": "CASE WHEN c_custkey % 5 <> 0 THEN concat('+1-555-', CAST(c_custkey % 10000 AS VARCHAR(10))) END",
    "signup_date": "CAST('2020-01-01' AS DATE) + CAST(c_custkey % 1400 AS INT)",
    "customer_segment": "CASE WHEN c_custkey % 20 < 3 THEN 'VIP' WHEN c_custkey % 20 < 9 THEN 'New' ELSE 'Returning' END",
    "country": "n_name",
    "is_active": "c_custkey % 20 <> 19",
}
PRODUCTS = {
    "product_id": "p_partkey",
    "product_name": "p_name",
    "category": (
        "CASE WHEN p_type LIKE 'ECONOMY%' THEN 'Electronics Accessories' WHEN p_type LIKE 'STANDARD%' THEN 'Home & Kitchen' "
        "WHEN p_type LIKE 'MEDIUM%' THEN 'Sports & Outdoors' WHEN p_type LIKE 'SMALL%' THEN 'Beauty & Personal Care' "
        "WHEN p_type LIKE 'LARGE%' THEN 'Office & Stationery' ELSE 'Toys & Games' END"
    ),
    "sku": "concat('SKU-', CAST(p_partkey AS VARCHAR(20)))",
    "price": "CAST(p_retailprice AS DECIMAL(10,2))",
    "stock_quantity": "p_size",
    "is_active": "p_partkey % 13 <> 0",
}
ORDERS = {
    "order_id": "o_orderkey",
    "customer_id": "o_custkey",
    "order_date": "o_orderdate",
    "order_status": (
        "CASE WHEN o_orderstatus = 'F' THEN 'Delivered' WHEN o_orderstatus = 'O' THEN 'Shipped' "
        "WHEN o_orderkey % 2 = 0 THEN 'Delayed' ELSE 'Processing' END"
    ),
    "total_amount": "CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(10,2))",
    "payment_method": _pick("o_orderkey % 4", ["Credit Card", "Debit Card", "PayPal", "Gift Card"]),
    "expected_delivery_date": "CAST(o_orderdate AS DATE) + CAST(5 + o_orderkey % 6 AS INT)",
    "actual_delivery_date": "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(3 + o_orderkey % 11 AS INT) END",
}
ORDER_ITEMS = {
    "order_item_id": "l_orderkey * 10 + l_linenumber",
    "order_id": "l_orderkey",
    "product_id": "l_partkey",
    "quantity": "CAST(l_quantity AS INT)",
    "unit_price": "CAST(l_extendedprice AS DECIMAL(10,2))",
    "line_total": (
        "CAST(CAST(l_quantity AS INT) * CAST(l_extendedprice AS DECIMAL(10,2)) "
        "+ CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS DECIMAL(14,2))"
    ),
}
TICKETS = {
    "ticket_id": "event_id",
    "customer_id": "coalesce(o_custkey, user_id)",
    "order_id": "o_orderkey",
    "channel": _pick("event_id % 5", vocab.CHANNELS),
    "message_text": "concat('My ', event_type, ' ticket about ', props, ' is still open.')",
    "category": _pick("(event_id * 7) % 10", vocab.CATEGORIES),
    "ai_predicted_category": (
        f"CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN {_pick('(event_id * 7 + 3) % 10', vocab.CATEGORIES)} "
        f"ELSE {_pick('(event_id * 7) % 10', vocab.CATEGORIES)} END"
    ),
    "classification_confidence": (
        "CASE WHEN event_id % 7 = 0 OR event_id % 97 = 0 THEN NULL ELSE "
        "CAST(CAST((event_id * 37) % 1001 AS DECIMAL(10,0)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(4,3)) END"
    ),
    "priority": _pick("event_id % 4", vocab.PRIORITIES),
    "status": (
        "CASE WHEN event_id % 4 = 0 THEN 'Escalated' WHEN event_id % 3 = 0 THEN 'Resolved' "
        "WHEN event_id % 3 = 1 THEN 'Closed' ELSE 'Reopened' END"
    ),
    "decision_path": "CAST(NULL AS VARCHAR(15))",
    "resolution_type": "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 9 = 1 THEN 'Automated' ELSE 'Human' END",
    "sentiment_score": (
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE "
        "CAST(CAST((event_id * 53) % 201 - 100 AS DECIMAL(10,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(3,2)) END"
    ),
    "created_at": "ts",
    "decision_at": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + (event_id % 240 + 1) * INTERVAL 1 MINUTE END",
    "first_response_at": "CASE WHEN event_id % 16 = 0 THEN NULL ELSE ts + (event_id % 1440 + 1) * INTERVAL 1 MINUTE END",
    "resolved_at": (
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + (event_id % 1440 + 1) * INTERVAL 1 MINUTE "
        "+ (event_id * 31 % 86400) * INTERVAL 1 SECOND END"
    ),
    "updated_at": "ts",
}
TICKET_ORDER_LINK = "event_id % 10 >= 3"

# Which tickets the later stages have already handled, and when.
DECIDED = "ticket_id % 20 <> 19"
RULE_DECISION_AT = "created_at + (ticket_id % 5000) * INTERVAL 1 MINUTE"
PROCESSED = "ticket_id % 20 < 18 OR (ticket_id % 20 = 19 AND ticket_id % 3 = 0)"
RESPONSE_AT = "created_at + (ticket_id % 9000) * INTERVAL 1 MINUTE"

DRAFTS = [
    "We are looking into where your parcel is and will write again tomorrow.",
    "The refund for order parts was approved this morning.",
    "Please tell us which item arrived broken so that we can check the next steps.",
    "Since Monday we have already issued the refund.",
    "The second charge was voided by the bank desk.",
    "Store credit of ten euros has been given for the delay.",
    "Your account was quietly reset. Your shipment has been resent.",
    "I am an AI and the language model wrote this with machine learning.",
    "We have corrected the entry in our books.",
]
DRAFT_TEXT = _pick("ticket_id % 9", DRAFTS)
GENERATIONS = {
    "ticket_id": "ticket_id",
    "error_type": "CASE WHEN ticket_id % 23 = 0 THEN 'timeout' END",
    "tool_input_json": (
        "CASE WHEN ticket_id % 23 = 0 THEN NULL "
        "WHEN ticket_id % 19 = 0 THEN '{\"draft_text\":\"no flag\"}' "
        "WHEN ticket_id % 17 = 0 AND ticket_id % 2 = 0 THEN '{\"can_generate\":false,\"missing_information\":[\"order number\",\"email\"]}' "
        "WHEN ticket_id % 17 = 0 THEN '{\"can_generate\":false}' "
        "WHEN ticket_id % 13 = 0 THEN '{\"can_generate\":true,\"draft_text\":\"   \"}' "
        "WHEN ticket_id % 29 = 0 THEN '[true]' "
        f"ELSE concat('{{\"can_generate\":true,\"draft_text\":\"', {DRAFT_TEXT}, '\"}}') END"
    ),
}
# Classifier outputs: mostly the ticket's own prediction, with one defect in some of them.
_GOOD = (
    "concat('{\"category\":\"', category, '\",\"priority\":\"', priority, '\",\"sentiment_score\":', "
    "CAST(CAST(ticket_id % 3 - 1 AS INT) AS VARCHAR(4)), ',\"confidence\":0.9,\"order_id\":', "
    "coalesce(CAST(order_id AS VARCHAR(20)), 'null'), ',\"mentions_customer_info\":false}')"
)


def _json(fields: str) -> str:
    return "'{" + fields + "}'"


CLASSIFIER_OUTPUTS = {
    "ticket_id": "ticket_id",
    "error_type": "CASE WHEN ticket_id % 53 = 0 THEN 'rate_limit' WHEN ticket_id % 59 = 0 THEN 'timeout' END",
    "tool_input_json": (
        "CASE WHEN ticket_id % 53 = 0 OR ticket_id % 59 = 0 THEN NULL "
        + "".join(
            f"WHEN ticket_id % {k} = 0 THEN {text} "
            for k, text in [
                (29, _json('"category":"Spam","priority":"Urgent!","sentiment_score":0,"confidence":0.5')),
                (31, _json('"category":"Other","priority":"Critical","sentiment_score":9,"confidence":0.5')),
                (37, _json('"category":"Other","priority":"Low","sentiment_score":0.1')),
                (41, _json('"category":"Other","priority":"Low","sentiment_score":5.0,"confidence":0.5')),
                (43, _json('"priority":"Low","sentiment_score":0.1,"confidence":0.5')),
                (47, _json('"category":"Complaint","priority":"High","sentiment_score":"-0.25","confidence":"0.75","order_id":3.0')),
                (61, "'[1]'"),
                (67, "'not json'"),
                (71, "'  '"),
                (73, _json('"category":"Other","priority":"Low","sentiment_score":0.1,"confidence":0.5,"mentions_customer_info":null')),
                (79, _json('"category":"Other","priority":"Low","sentiment_score":true,"confidence":1,"order_id":3.5')),
            ]
        )
        + f"ELSE {_GOOD} END"
    ),
    "input_tokens": "CASE WHEN ticket_id % 83 = 0 THEN NULL ELSE 200 + ticket_id % 50 END",
    "output_tokens": "20 + ticket_id % 7",
}
# Classifier outputs in which keys are there twice: the last one counts.
_TWICE = [
    '{"category":"Spam","category":"Other","priority":"Low","sentiment_score":0.1,"confidence":0.5}',
    '{"category":"Other","priority":"Low","priority":"High","sentiment_score":5,"sentiment_score":-0.5,"confidence":0.25}',
    '{"category":"Other","category":"Spam","priority":"Low","sentiment_score":0.1,"confidence":0.5}',
    '{"category":"Other","priority":"Low","sentiment_score":0.1,"confidence":0.5,"confidence":null}',
    '{"order_id":3,"category":"Other","priority":"Low","sentiment_score":0.1,"confidence":0.5,"order_id":12}',
    '{"note":1,"note":{"a":[1,2]},"category":"Complaint","priority":"Urgent","sentiment_score":0,"confidence":1}',
    '{"category":"Other","category":"Other","priority":"Low"',
    '{"category":"Other","category":"Other","priority":"Low","sentiment_score":0.1,"confidence":0.5} {"x":1}',
]
REPEATED_KEYS = {"ticket_id": "ticket_id", "error_type": "CAST(NULL AS VARCHAR(9))", "tool_input_json": _pick("ticket_id % 8", _TWICE)}
# Routing contexts with defects in some of them.
BROKEN_CONTEXTS = {
    "ticket_id": "CASE WHEN ticket_id % 601 = 0 THEN NULL ELSE ticket_id END",
    "ai_predicted_category": "CASE WHEN ticket_id % 101 = 0 THEN 'Spam' ELSE ai_predicted_category END",
    "classification_confidence": "CASE WHEN ticket_id % 103 = 0 THEN CAST(5 AS DOUBLE) ELSE CAST(classification_confidence AS DOUBLE) END",
    "sentiment_score": "CASE WHEN ticket_id % 107 = 0 THEN CAST(-1.5 AS DOUBLE) WHEN ticket_id % 109 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(sentiment_score AS DOUBLE) END",
    "order_id": "order_id",
    "order_value": "CASE WHEN ticket_id % 113 = 0 THEN CAST(-1 AS DOUBLE) ELSE order_value END",
    "customer_segment": "CASE WHEN ticket_id % 127 = 0 THEN 'Gold' ELSE customer_segment END",
}
# Response contexts with defects in some of them.
BROKEN_ANSWERS = {
    "ticket_id": "CASE WHEN ticket_id % 601 = 0 THEN NULL ELSE ticket_id END",
    "message_text": "CASE WHEN ticket_id % 97 = 0 THEN NULL ELSE message_text END",
    "ai_predicted_category": "CASE WHEN ticket_id % 101 = 0 THEN 'Spam' ELSE ai_predicted_category END",
    "classification_confidence": "CAST(CASE WHEN ticket_id % 103 = 0 THEN 1.5 ELSE classification_confidence END AS DECIMAL(4,3))",
    "sentiment_score": "CAST(CASE WHEN ticket_id % 107 = 0 THEN -1.5 ELSE sentiment_score END AS DECIMAL(3,2))",
    "decision_path": "CASE WHEN ticket_id % 113 = 0 THEN 'Maybe' ELSE decision_path END",
}
# Most orders add up: totals are the sums of the lines, but for a few.
ADDED_UP = "CAST(CASE WHEN order_id % 97 = 0 THEN line_sum + 1 WHEN order_id % 89 = 0 THEN line_sum - 0.01 ELSE coalesce(line_sum, total_amount) END AS DECIMAL(14,2))"
# Tables with violations: (column, expression) replaced in a copy of the sound table.
BROKEN = {
    "customers": {
        "customer_id": "CASE WHEN customer_id % 211 = 1 THEN customer_id - 1 ELSE customer_id END",
        "first_name": "CASE WHEN customer_id % 97 = 0 THEN NULL ELSE first_name END",
        "email": "CASE WHEN customer_id % 89 = 1 THEN concat('c', CAST(customer_id - 1 AS VARCHAR(20)), '@example.com') ELSE email END",
        "customer_segment": "CASE WHEN customer_id % 83 = 0 THEN 'Gold' ELSE customer_segment END",
        "country": "CASE WHEN customer_id % 79 = 0 THEN concat(country, ' 1234567890123456789012345678901234567890123456789') ELSE country END",
    },
    "products": {
        "product_id": "CASE WHEN product_id % 53 = 1 THEN product_id - 1 ELSE product_id END",
        "sku": "CASE WHEN product_id % 31 = 1 THEN concat('SKU-', CAST(product_id - 1 AS VARCHAR(20))) ELSE sku END",
        "category": "CASE WHEN product_id % 29 = 0 THEN 'Garden' ELSE category END",
        "price": "CASE WHEN product_id % 37 = 0 THEN CAST(-1 AS DECIMAL(10,2)) ELSE price END",
        "stock_quantity": "CASE WHEN product_id % 41 = 0 THEN -5 ELSE stock_quantity END",
    },
    "orders": {
        "order_id": "CASE WHEN order_id % 499 = 1 THEN order_id - 1 ELSE order_id END",
        "customer_id": "CASE WHEN order_id % 307 = 0 THEN -customer_id - 1 ELSE customer_id END",
        "order_status": "CASE WHEN order_id % 311 = 0 THEN 'Lost' ELSE order_status END",
        "payment_method": "CASE WHEN order_id % 313 = 0 THEN 'Cash' WHEN order_id % 317 = 0 THEN NULL ELSE payment_method END",
        "total_amount": "CASE WHEN order_id % 331 = 0 THEN CAST(-2 AS DECIMAL(10,2)) ELSE total_amount END",
        "actual_delivery_date": "CASE WHEN order_id % 337 = 0 THEN CAST(order_date AS DATE) + CAST(-1 AS INT) ELSE actual_delivery_date END",
    },
    "order_items": {
        "order_id": "CASE WHEN order_item_id % 997 = 0 THEN -order_id - 1 ELSE order_id END",
        "product_id": "CASE WHEN order_item_id % 991 = 0 THEN -product_id - 1 ELSE product_id END",
        "quantity": "CASE WHEN order_item_id % 983 = 0 THEN 0 ELSE quantity END",
        "unit_price": "CASE WHEN order_item_id % 977 = 0 THEN CAST(-3 AS DECIMAL(10,2)) ELSE unit_price END",
    },
    "tickets": {
        "ticket_id": "CASE WHEN ticket_id % 401 = 1 THEN ticket_id - 1 ELSE ticket_id END",
        "customer_id": "CASE WHEN ticket_id % 211 = 0 THEN -customer_id - 1 WHEN ticket_id % 223 = 0 THEN customer_id + 1 ELSE customer_id END",
        "order_id": "CASE WHEN ticket_id % 227 = 0 THEN -ticket_id - 1 ELSE order_id END",
        "channel": "CASE WHEN ticket_id % 229 = 0 THEN 'Fax' WHEN ticket_id % 233 = 0 THEN NULL ELSE channel END",
        "category": "CASE WHEN ticket_id % 239 = 0 THEN 'Spam' ELSE category END",
        "priority": "CASE WHEN ticket_id % 241 = 0 THEN 'Critical' ELSE priority END",
        "status": "CASE WHEN ticket_id % 251 = 0 THEN 'Lost' ELSE status END",
        "resolution_type": "CASE WHEN ticket_id % 257 = 0 THEN 'Robot' ELSE resolution_type END",
        "classification_confidence": "CASE WHEN ticket_id % 263 = 0 THEN CAST(1.5 AS DECIMAL(4,3)) ELSE classification_confidence END",
        "sentiment_score": "CASE WHEN ticket_id % 269 = 0 THEN CAST(-1.5 AS DECIMAL(3,2)) ELSE sentiment_score END",
        "resolved_at": "CASE WHEN ticket_id % 271 = 0 THEN created_at - INTERVAL 90 MINUTE WHEN ticket_id % 277 = 0 THEN created_at ELSE resolved_at END",
        "decision_at": "CASE WHEN ticket_id % 281 = 0 THEN created_at - INTERVAL 30 MINUTE ELSE decision_at END",
        "first_response_at": "CASE WHEN ticket_id % 283 = 0 THEN created_at - INTERVAL 61 SECOND ELSE first_response_at END",
    },
}
# Tickets of other customers' orders, otherwise sound; and decisions to write back to some of them, with defects.
GATED = {c: BROKEN["tickets"][c] for c in ("customer_id", "order_id")}
UPDATED = "ticket_id % 3000 < 1000 AND ticket_id % 10 < 3"
UPDATES = {
    "ticket_id": "CASE WHEN ticket_id % 290 = 2 THEN -ticket_id - 1 WHEN ticket_id % 310 = 1 THEN NULL ELSE ticket_id END",
    "final_priority": _pick("(ticket_id * 3) % 4", vocab.PRIORITIES),
    "decision_path": "CASE WHEN ticket_id % 2 = 0 THEN 'Automated' ELSE 'Human Review' END",
    "rule_decision_at": "created_at + INTERVAL 7 MINUTE",
}
# A second round of updates: some repeat the first, some contradict it.
REPEATED = "ticket_id % 3000 < 1000 AND ticket_id % 20 = 0"
REPEATS = {
    **UPDATES,
    "decision_path": "CASE WHEN ticket_id % 60 = 0 THEN 'Human Review' WHEN ticket_id % 2 = 0 THEN 'Automated' ELSE 'Human Review' END",
    "rule_decision_at": "CASE WHEN ticket_id % 140 = 0 THEN NULL ELSE created_at + INTERVAL 7 MINUTE END",
}
# Predictions and responses that are written back after the decisions.
PREDICTED = "ticket_id % 6 = 1"
PREDICTIONS = {
    "ticket_id": "ticket_id",
    "ai_predicted_category": _pick("(ticket_id * 3) % 10", vocab.CATEGORIES),
    "classification_confidence": "CAST(CASE WHEN ticket_id % 12 = 1 THEN 0.999 WHEN ticket_id % 30 = 7 THEN NULL ELSE 0.123 END AS DECIMAL(4,3))",
    "sentiment_score": "CAST(0.25 AS DECIMAL(3,2))",
    "decision_at": "created_at + INTERVAL 3 MINUTE",
}
ANSWERED = "ticket_id % 5 = 2"
ANSWERS = {
    "ticket_id": "ticket_id",
    "response_status": _pick("ticket_id % 4", vocab.RESPONSE_STATUSES),
    "response_type": _pick("ticket_id % 4", vocab.RESPONSE_TYPES[:4]),
    "response_draft": "CAST(NULL AS VARCHAR(9))",
    "response_generated_at": "created_at + (ticket_id % 777) * INTERVAL 1 MINUTE",
}
# Violations in the columns that routing and responses store.
BROKEN_STORED = {
    "final_priority": "CASE WHEN ticket_id % 307 = 0 THEN 'Critical' WHEN ticket_id % 311 = 0 THEN NULL ELSE final_priority END",
    "decision_path": "CASE WHEN ticket_id % 313 = 0 THEN 'Maybe' WHEN ticket_id % 317 = 0 THEN NULL ELSE decision_path END",
    "rule_decision_at": "CASE WHEN ticket_id % 331 = 0 THEN created_at - INTERVAL 45 SECOND ELSE rule_decision_at END",
    "response_status": "CASE WHEN ticket_id % 337 = 0 THEN 'SENT' WHEN ticket_id % 347 = 0 THEN 'DRAFT_GENERATED' WHEN ticket_id % 349 = 0 THEN 'HUMAN_REVIEW_DRAFT' ELSE response_status END",
    "response_type": "CASE WHEN ticket_id % 353 = 0 THEN 'SALES' ELSE response_type END",
    "response_draft": "CASE WHEN ticket_id % 359 = 0 THEN 'leaked' WHEN ticket_id % 367 = 0 THEN NULL ELSE response_draft END",
    "response_generated_at": "CASE WHEN ticket_id % 373 = 0 THEN created_at - INTERVAL 5 MINUTE ELSE response_generated_at END",
}


def _spark_sql(expression: str) -> str:
    """VARCHAR(n) casts mean STRING here."""
    import re

    return re.sub(r"VARCHAR\(\d+\)", "STRING", expression)


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{_spark_sql(e)} AS {n}" for n, e in columns.items()])


def replace(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The frame with some columns replaced, all expressions reading the old values."""
    return df.selectExpr(*[f"{_spark_sql(columns[c])} AS {c}" if c in columns else c for c in df.columns])


# Folders of the stored stages, by application, directory and stage.
_STORED: dict[tuple[str, str, str], str] = {}


class Model:
    """The tables over one test-data directory. All are lazy but the stored stages, which are written when first asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @property
    def customers(self) -> DataFrame:
        nation = F.broadcast(self.raw("nation"))  # 25 rows by definition
        return derive(self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), CUSTOMERS)

    @property
    def products(self) -> DataFrame:
        return derive(self.raw("part"), PRODUCTS)

    @property
    def orders(self) -> DataFrame:
        return derive(self.raw("orders"), ORDERS)

    @property
    def order_items(self) -> DataFrame:
        return derive(self.raw("lineitem"), ORDER_ITEMS)

    def tickets_from(self, events: DataFrame) -> DataFrame:
        owners = self.raw("orders").select("o_orderkey", "o_custkey")
        link = (F.col("o_orderkey") == F.col("event_id")) & F.expr(TICKET_ORDER_LINK)
        return derive(events.join(owners, link, "left"), TICKETS)

    @property
    def tickets(self) -> DataFrame:
        """Tickets with classifier predictions, before routing."""
        return self.tickets_from(self.raw("events"))

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers,
            "products": self.products,
            "orders": self.orders,
            "order_items": self.order_items,
            "tickets": self.tickets,
        }

    @property
    def broken_tables(self) -> dict[str, DataFrame]:
        return {name: replace(df, BROKEN[name]) for name, df in self.tables.items()}

    @property
    def gated_tickets(self) -> DataFrame:
        names = [c for c in vocab.ROUTING_COLUMNS + vocab.RESPONSE_COLUMNS if c != "decision_path"]
        later = {c: F.lit(None).cast("timestamp_ntz" if c.endswith("_at") else "string") for c in names}
        return replace(self.tickets, GATED).withColumns(later)

    @property
    def updates(self) -> DataFrame:
        first = derive(self.tickets.where(_spark_sql(UPDATED)), UPDATES)
        return first.unionByName(derive(self.tickets.where(_spark_sql(REPEATED)), REPEATS))

    @property
    def adding_up(self) -> dict[str, DataFrame]:
        """The tables with orders of which most have the total of their lines."""
        sums = self.order_items.groupBy(F.col("order_id").alias("_order")).agg(F.sum("line_total").alias("line_sum"))
        joined = self.orders.join(sums, F.col("order_id") == F.col("_order"), "left")
        return self.tables | {"orders": joined.withColumn("total_amount", F.expr(ADDED_UP)).drop("_order", "line_sum")}

    @property
    def predictions(self) -> DataFrame:
        return derive(self.tickets.where(_spark_sql(PREDICTED)), PREDICTIONS)

    @property
    def answers(self) -> DataFrame:
        return derive(self.tickets.where(_spark_sql(ANSWERED)), ANSWERS)

    def _joined(self) -> DataFrame:
        """Tickets with the order and customer columns that routing and responses read."""
        orders = self.orders.select("order_id", F.col("total_amount").cast("double").alias("order_value"), "order_status")
        segments = self.customers.select("customer_id", "customer_segment")
        # A third of the tickets names no order: they must not meet in one task.
        return lookup_join(self.tickets.join(segments, "customer_id"), orders, "order_id", "ticket_id")

    def routed(self) -> DataFrame:
        """Full ticket rows with their decisions side by side."""
        return route_tickets(self._joined().drop("decision_path"))

    def _stored(self, name: str, build) -> DataFrame:
        """A stage's result as a stored table, written once per application in the shared folder."""
        key = (self.spark.sparkContext.applicationId, self.directory, name)
        if key not in _STORED:
            folder = shared_folder(self.spark, name)
            build().write.parquet(folder)
            _STORED[key] = folder
        return self.spark.read.parquet(_STORED[key])

    def _decide(self) -> DataFrame:
        done = F.expr(DECIDED)
        return self.routed().select(
            *[c for c in TICKETS if c != "decision_path"],
            *[F.when(done, F.col(c)).alias(c) for c in ("final_priority", "decision_path")],
            F.when(done, F.expr(RULE_DECISION_AT)).alias("rule_decision_at"),
        )

    def decided_tickets(self) -> DataFrame:
        """Tickets as stored after routing: some are not decided yet."""
        return self._stored("decided-tickets", self._decide)

    def responded(self) -> DataFrame:
        """Stored-decision rows with the response decision side by side, drafts from the planted generations."""
        context = self.decided_tickets().withColumns(
            {c: F.expr(_spark_sql(GENERATIONS[c])) for c in ("error_type", "tool_input_json")}
        )
        return decide_responses(context, generations=context)

    def _respond(self) -> DataFrame:
        done = F.expr(PROCESSED)
        return self.responded().select(
            *TICKETS,
            "final_priority",
            "rule_decision_at",
            *[F.when(done, F.col(c)).alias(c) for c in ("response_status", "response_type", "response_draft")],
            F.when(done, F.expr(RESPONSE_AT)).alias("response_generated_at"),
        )

    def stored_tickets(self) -> DataFrame:
        """Tickets as stored after all stages: some are not processed yet."""
        return self._stored("stored-tickets", self._respond)

    def broken_stored_tickets(self) -> DataFrame:
        return replace(self.stored_tickets(), BROKEN_STORED)
