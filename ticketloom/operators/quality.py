"""Data-quality suites: every violation is a row ``(check_name, key, detail)``; empty means healthy.

The names of the checks are fixed values: they are part of the result.

All row checks of one table run in one scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import schemas, vocab
from ticketloom.functions.labels import or_label
from ticketloom.functions.numeric import money
from ticketloom.functions.sql import any_of, listed, q, true
from ticketloom.operators import keychecks, views
from ticketloom.operators.joins import childless, orphans

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class RowCheck:
    """A condition that holds on a bad row, as SQL text; NULL counts as sound."""

    name: str
    bad: str
    detail: str = "NULL"


def failed_check(c: RowCheck) -> str:
    """``(check_name, detail)`` of a row that fails the check, else NULL, as SQL text."""
    return f"CASE WHEN {c.bad} THEN named_struct('check_name', {q(c.name)}, 'detail', CAST({c.detail} AS STRING)) END"


def row_checks(df: DataFrame, key: str, checks: Sequence[RowCheck]) -> DataFrame:
    """All checks of one table in one scan, an entry per failed check.

    A one-row generator computes the failed checks of a row once; the explode
    behind it reads them. A filter on the conditions would be merged with the
    projections below it and copy their expressions for every check.
    """
    entries = ", ".join(failed_check(c) for c in checks)
    failed = f"inline(array(named_struct('hits', filter(array({entries}), hit -> hit IS NOT NULL))))"
    hits = df.selectExpr(f"CAST({key} AS STRING) AS key", failed).selectExpr("key", "explode(hits) AS hit")
    return hits.select("hit.check_name", "key", "hit.detail")


def finding(df: DataFrame, name: str, key: Column, detail: Column | None = None) -> DataFrame:
    shown = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(F.lit(name).alias("check_name"), key.cast("string").alias("key"), shown.alias("detail"))


def _all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicates(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count as detail."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    return finding(counted, name, key, F.col("_n"))


def outside_vocabulary(name: str, column: str, allowed: Sequence[str]) -> RowCheck:
    return RowCheck(name, f"{column} NOT IN {listed(allowed)}", column)


def before(name: str, later: str, earlier: str) -> RowCheck:
    return RowCheck(name, f"{later} < {earlier}", later)


# --- tables suite -------------------------------------------------------------------


def primary_keys(tables: Tables) -> DataFrame:
    return _all([duplicates(tables[t], f"{t}_pk_dupes", [k]) for t, k in schemas.KEYS.items()])


def dangling_rows(tables: Tables, child: str, parent: str, key: str, null_is_orphan: bool) -> DataFrame:
    """Id and key of the child rows without their parent; nothing else of the table is read."""
    own = schemas.KEYS[child]
    return orphans(tables[child].select(own, key), tables[parent].select(key), key, null_is_orphan, row_id=own)


def foreign_keys(tables: Tables) -> DataFrame:
    """Orphans; tickets without an order are not orphans."""
    links = [
        ("orphan_orders_customer", "orders", "customers", "customer_id", True),
        ("orphan_order_items_order", "order_items", "orders", "order_id", True),
        ("orphan_order_items_product", "order_items", "products", "product_id", True),
        ("orphan_tickets_customer", "tickets", "customers", "customer_id", True),
        ("orphan_tickets_order", "tickets", "orders", "order_id", False),
    ]
    return _all(
        [
            finding(dangling_rows(tables, child, parent, key, nulls), name, F.col(schemas.KEYS[child]), F.col(key))
            for name, child, parent, key, nulls in links
        ]
    )


def required_nulls(tables: Tables) -> DataFrame:
    """One row per table that has rows with a required column missing, with their count."""
    frames = []
    for table, names in keychecks.REQUIRED_COLUMNS.items():
        missing = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
        counted = tables[table].agg(F.count_if(missing).alias("_n")).where(F.col("_n") > 0)
        frames.append(finding(counted, f"null_required_{table}", F.lit(table), F.col("_n")))
    return _all(frames)


def duplicate_values(tables: Tables) -> DataFrame:
    return _all(
        [
            duplicates(tables["customers"], "duplicate_customer_emails", ["email"]),
            duplicates(tables["products"], "duplicate_product_skus", ["sku"]),
            duplicates(tables["order_items"], "duplicate_order_item_product_within_order", ["order_id", "product_id"]),
        ]
    )


def order_totals(tables: Tables) -> DataFrame:
    """Orders whose total differs from the sum of their lines."""
    sums = tables["order_items"].groupBy("order_id").agg(F.expr(money("sum(line_total)")).alias("computed_total"))
    wrong = tables["orders"].join(sums, "order_id").where(F.col("total_amount") != F.col("computed_total"))
    detail = F.concat(F.col("total_amount").cast("string"), F.lit(" <> "), F.col("computed_total").cast("decimal(18,2)").cast("string"))
    return finding(wrong, "order_total_mismatch", F.col("order_id"), detail)


def orders_without_items(tables: Tables) -> DataFrame:
    return finding(
        childless(tables["orders"], tables["order_items"], "order_id"), "orders_with_no_items", F.col("order_id")
    )


def line_total_check(name: str = "line_total_mismatch") -> RowCheck:
    return RowCheck(name, f"line_total <> {money('quantity * unit_price')}", "line_total")


def line_totals(tables: Tables) -> DataFrame:
    return row_checks(tables["order_items"], "order_item_id", [line_total_check()])


def owner_mismatch(tables: Tables) -> DataFrame:
    """Tickets linked to another customer's order."""
    tickets = tables["tickets"].where(F.col("order_id").isNotNull()).select("ticket_id", "order_id", "customer_id")
    owners = tables["orders"].select("order_id", F.col("customer_id").alias("order_customer"))
    wrong = tickets.join(owners, "order_id").where(F.col("customer_id") != F.col("order_customer"))
    return finding(
        wrong,
        "ticket_order_customer_mismatch",
        F.col("ticket_id"),
        F.concat(F.col("customer_id").cast("string"), F.lit(" <> "), F.col("order_customer").cast("string")),
    )


def timestamp_checks() -> dict[str, list[RowCheck]]:
    return {
        "tickets": [
            before("resolved_before_created", "resolved_at", "created_at"),
            before("decision_before_created", "decision_at", "created_at"),
            before("first_response_before_created", "first_response_at", "created_at"),
            before("resolved_before_first_response", "resolved_at", "first_response_at"),
        ],
        "orders": [before("delivery_before_order_date", "actual_delivery_date", "to_date(order_date)")],
    }


def vocabulary_checks() -> dict[str, list[RowCheck]]:
    return {
        "customers": [outside_vocabulary("invalid_customer_segment", "customer_segment", vocab.SEGMENTS)],
        "products": [outside_vocabulary("invalid_product_category", "category", vocab.PRODUCT_CATEGORIES)],
        "orders": [outside_vocabulary("invalid_order_status", "order_status", vocab.ORDER_STATUSES)],
        "tickets": [
            outside_vocabulary("invalid_ticket_category", "category", vocab.CATEGORIES),
            outside_vocabulary("invalid_ticket_priority", "priority", vocab.PRIORITIES),
            outside_vocabulary("invalid_ticket_status", "status", vocab.TICKET_STATUSES),
        ],
    }


def merged_checks(*groups: dict[str, list[RowCheck]]) -> dict[str, list[RowCheck]]:
    merged: dict[str, list[RowCheck]] = {}
    for group in groups:
        for table, checks in group.items():
            merged.setdefault(table, []).extend(checks)
    return merged


def run_row_checks(tables: Tables, *groups: dict[str, list[RowCheck]]) -> DataFrame:
    """Several groups of row checks, one scan per table."""
    merged = merged_checks(*groups)
    return _all([row_checks(tables[t], schemas.KEYS[t], checks) for t, checks in merged.items()])


def tables_suite(tables: Tables, stage: str | None = None) -> DataFrame:
    """Keys, references, required values, duplicates, totals, owners, time order, vocabularies.

    With ``stage``, a new path in the shared folder, each table is read twice for
    all of them; without, lazily, by a scan and a shuffle per check.
    """
    if stage is not None:
        checks = merged_checks(timestamp_checks(), vocabulary_checks(), {"order_items": [line_total_check()]})
        return keychecks.two_read_suite(tables, stage, {t: [failed_check(c) for c in own] for t, own in checks.items()})
    return _all(
        [
            primary_keys(tables),
            foreign_keys(tables),
            required_nulls(tables),
            duplicate_values(tables),
            order_totals(tables),
            orders_without_items(tables),
            owner_mismatch(tables),
            run_row_checks(tables, timestamp_checks(), vocabulary_checks(), {"order_items": [line_total_check()]}),
        ]
    )


def tickets_without_order(tickets: DataFrame) -> DataFrame:
    """Informational: how many tickets have no order, by design."""
    return tickets.agg(F.count_if(F.col("order_id").isNull()).alias("ticket_count"))


# --- routing suite ------------------------------------------------------------------


def routing_checks() -> list[RowCheck]:
    return [
        outside_vocabulary("invalid_final_priority", "final_priority", vocab.PRIORITIES),
        outside_vocabulary("invalid_decision_path", "decision_path", vocab.DECISION_PATHS),
        before("rule_decision_before_created", "rule_decision_at", "created_at"),
        RowCheck(
            "partial_phase4_write",
            "(decision_path IS NOT NULL) <> (final_priority IS NOT NULL)",
            "coalesce(decision_path, final_priority)",
        ),
    ]


def routing_suite(tickets: DataFrame) -> DataFrame:
    return row_checks(tickets, "ticket_id", routing_checks())


# --- response suite -----------------------------------------------------------------


def response_checks() -> list[RowCheck]:
    drafted, human = "response_status = 'DRAFT_GENERATED'", "response_status = 'HUMAN_REVIEW_DRAFT'"
    closed = "response_status IN ('BLOCKED', 'NOT_ELIGIBLE')"
    return [
        outside_vocabulary("invalid_response_status", "response_status", vocab.RESPONSE_STATUSES),
        outside_vocabulary("invalid_response_type", "response_type", vocab.RESPONSE_TYPES),
        before("response_generated_before_created", "response_generated_at", "created_at"),
        RowCheck("draft_generated_missing_text", f"{drafted} AND response_draft IS NULL"),
        RowCheck("blocked_or_not_eligible_has_draft", f"{closed} AND response_draft IS NOT NULL", "response_status"),
        RowCheck("response_without_phase4_decision", "response_status IS NOT NULL AND decision_path IS NULL", "response_status"),
        RowCheck(
            "human_review_draft_without_phase4_human_review",
            f"{human} AND decision_path <> {q(vocab.HUMAN_REVIEW)}",
            "decision_path",
        ),
        RowCheck(
            "draft_generated_without_phase4_automated", f"{drafted} AND decision_path <> {q(vocab.AUTOMATED)}", "decision_path"
        ),
    ]


def response_suite(tickets: DataFrame) -> DataFrame:
    return row_checks(tickets, "ticket_id", response_checks())


def distribution(
    tickets: DataFrame, column: str, label: str, name: str | None = None, order: str | None = None
) -> DataFrame:
    """Rows per value with a label for NULL; ``order`` is None, 'label', or 'count' (largest first, ties by label)."""
    shown = name or column
    counts = tickets.groupBy(F.expr(or_label(column, label)).alias(shown)).agg(F.count(F.lit(1)).alias("n"))
    keys = {None: [], "label": [F.col(shown)], "count": [F.desc("n"), F.col(shown)]}[order]
    return counts.orderBy(*keys) if keys else counts


def placed(counts: DataFrame, order: str = "count") -> DataFrame:
    """The rows of a distribution with ``place``, from 1: by 'count' (largest first, ties by label) or by 'label'."""
    label = counts.columns[0]
    keys = {"count": [F.desc("n"), F.col(label)], "label": [F.col(label)]}[order]
    return counts.withColumn("place", F.row_number().over(Window.orderBy(*keys)))  # one row per value of a vocabulary


def stored_distributions(tickets: DataFrame) -> DataFrame:
    """The four stored-column distributions and the category one, from one scan, as ``(dimension, value, n)``."""
    labels = {
        "decision_path": vocab.NOT_DECIDED,
        "final_priority": vocab.NOT_DECIDED,
        "response_status": vocab.NOT_PROCESSED,
        "response_type": vocab.UNKNOWN_TYPE,
        "category": "(none)",
    }
    entries = ", ".join(
        f"named_struct('dimension', {q(c)}, 'value', {or_label(c, label)})" for c, label in labels.items()
    )
    return tickets.selectExpr(f"inline(array({entries}))").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def orders_per_customer(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers per number of orders, zero included; orders collapse before the join."""
    per_customer = orders.groupBy("customer_id").agg(F.count("order_id").alias("order_count"))
    counted = customers.select("customer_id").join(per_customer, "customer_id", "left")
    return counted.groupBy(F.coalesce("order_count", F.lit(0).cast("bigint")).alias("order_count")).agg(
        F.count(F.lit(1)).alias("num_customers")
    )


def top_products(items: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """The best-selling product names; lines collapse per product before the join, ties go by name."""
    units = items.groupBy("product_id").agg(F.sum("quantity").alias("_units"))
    named = units.join(products.select("product_id", "product_name"), "product_id")
    return (
        named.groupBy("product_name")
        .agg(F.sum("_units").alias("units_sold"))
        .orderBy(F.desc("units_sold"), "product_name")
        .limit(n)
    )


# --- analytics suite ----------------------------------------------------------------


def view_grain(fact: DataFrame, tickets: DataFrame) -> DataFrame:
    """Repeated ticket ids in the fact view, and a row count that differs from the table's."""
    dupes = duplicates(fact, "ticket_grain_duplicates", ["ticket_id"])
    rows = fact.agg(F.count(F.lit(1)).alias("view_rows"))
    both = rows.withColumn("ticket_rows", tickets.agg(F.count(F.lit(1))).scalar())
    shown = F.concat(F.col("view_rows").cast("string"), F.lit(" <> "), F.col("ticket_rows").cast("string"))
    wrong = both.where(F.col("view_rows") != F.col("ticket_rows"))
    return dupes.unionByName(finding(wrong, "ticket_grain_row_count_mismatch", F.lit("vw_ticket_analytics"), shown))


def grain(fact: DataFrame) -> DataFrame:
    """Row count and distinct ticket count; equal when the grain holds."""
    return fact.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("n"), F.count("ticket_id").alias("d")
    )


def consistency_checks() -> list[RowCheck]:
    """Partition and range checks over the blocks of the metric views."""
    c, r, p = "classification", "rule_decisions", "responses"

    def off(block: str, *names: str) -> str:
        return any_of(true(f"{block}.{n} NOT BETWEEN 0 AND 100") for n in names)

    checks = {
        "classification_counts_do_not_partition": f"{c}.classified_tickets + {c}.unclassified_tickets <> {c}.total_tickets",
        "rule_decisions_do_not_partition": f"{r}.automated_decisions + {r}.human_review_decisions <> {r}.tickets_with_rule_decision",
        "response_statuses_do_not_partition": f"{p}.drafts_generated + {p}.human_review_drafts + {p}.blocked_responses "
        f"+ {p}.not_eligible_responses <> {p}.response_processed",
        "response_processed_partition_broken": f"{p}.response_processed + {p}.response_not_processed <> {p}.total_tickets",
        "urgent_exceeds_human_review": f"{r}.urgent_human_review > {r}.human_review_decisions",
        "matches_exceed_classified": f"{c}.exact_category_matches > {c}.classified_tickets",
        "classification_pct_out_of_range": off(
            c, "classification_coverage_pct", "low_confidence_rate_pct", "exact_category_match_rate_pct"
        ),
        "rule_pct_out_of_range": off(r, "automated_rate_pct", "human_review_rate_pct", "urgent_human_review_rate_pct"),
        "response_pct_out_of_range": off(
            p, "response_processed_rate_pct", "draft_generation_rate_pct", "blocked_rate_pct"
        ),
    }
    return [RowCheck(name, bad) for name, bad in checks.items()]


def metric_consistency(metrics: DataFrame) -> DataFrame:
    """Partition and range checks over the one-row frame of the four metric views."""
    return row_checks(metrics, "'metrics'", consistency_checks())


def fact_checks() -> list[RowCheck]:
    """Negative durations and foreign vocabulary inside the fact view; early deliveries are fine."""
    durations = [
        "first_response_minutes", "resolution_hours", "rule_decision_hours", "response_generation_hours",
    ]
    return [
        *[RowCheck(f"negative_{d}", f"{d} < 0", d) for d in durations],
        outside_vocabulary("invalid_decision_path_in_view", "decision_path", vocab.DECISION_PATHS),
        outside_vocabulary("invalid_response_status_in_view", "response_status", vocab.RESPONSE_STATUSES),
    ]


def analytics_suite(fact: DataFrame, tickets: DataFrame, metrics: DataFrame) -> DataFrame:
    return _all(
        [view_grain(fact, tickets), metric_consistency(metrics), row_checks(fact, "ticket_id", fact_checks())]
    )


# --- declared constraints -------------------------------------------------------------


def constraint_checks(table: str, columns: Sequence[str]) -> list[RowCheck]:
    """NOT NULL, text length, vocabulary, range and consistency constraints of one table."""

    def member(name: str, column: str, allowed: Sequence[str]) -> RowCheck:
        return outside_vocabulary(f"{table}.{name}", column, allowed)

    def off(name: str, bad: str, column: str) -> RowCheck:
        return RowCheck(f"{table}.{name}", bad, column)

    checks = [RowCheck(f"{table}.{n}_not_null", f"{n} IS NULL") for n in schemas.required(table) if n in columns]
    checks += [
        RowCheck(f"{table}.{n}_length", f"length({n}) > {size}", f"length({n})")
        for n, size in schemas.TEXT_LENGTHS[table].items()
        if n in columns
    ]
    own = {
        "customers": [member("segment", "customer_segment", vocab.SEGMENTS)],
        "products": [
            member("category", "category", vocab.PRODUCT_CATEGORIES),
            off("price_nonneg", "price < 0", "price"),
            off("stock_nonneg", "stock_quantity < 0", "stock_quantity"),
        ],
        "orders": [
            member("status", "order_status", vocab.ORDER_STATUSES),
            member("payment_method", "payment_method", vocab.PAYMENT_METHODS),
            off("total_nonneg", "total_amount < 0", "total_amount"),
            before("orders.delivery_dates", "actual_delivery_date", "to_date(order_date)"),
        ],
        "order_items": [
            off("qty_pos", "quantity <= 0", "quantity"),
            off("price_nonneg", "unit_price < 0", "unit_price"),
            line_total_check("order_items.line_total"),
        ],
        "tickets": [
            member("channel", "channel", vocab.CHANNELS),
            member("category", "category", vocab.CATEGORIES),
            member("ai_predicted_category", "ai_predicted_category", vocab.CATEGORIES),
            member("priority", "priority", vocab.PRIORITIES),
            member("status", "status", vocab.TICKET_STATUSES),
            member("decision_path", "decision_path", vocab.DECISION_PATHS),
            member("resolution_type", "resolution_type", vocab.RESOLUTION_TYPES),
            off("confidence_range", "classification_confidence NOT BETWEEN 0 AND 1", "classification_confidence"),
            off("sentiment_range", "sentiment_score NOT BETWEEN -1 AND 1", "sentiment_score"),
            before("tickets.ts_decision", "decision_at", "created_at"),
            before("tickets.ts_first_response", "first_response_at", "created_at"),
            before("tickets.ts_resolved", "resolved_at", "created_at"),
        ],
    }
    checks += own[table]
    if "final_priority" in columns:
        checks += [
            member("final_priority", "final_priority", vocab.PRIORITIES),
            before("tickets.rule_decision_ts", "rule_decision_at", "created_at"),
        ]
    if "response_status" in columns:
        consistent = (
            "(response_status = 'DRAFT_GENERATED' AND response_draft IS NOT NULL) OR response_status = 'HUMAN_REVIEW_DRAFT' "
            "OR (response_status IN ('BLOCKED', 'NOT_ELIGIBLE') AND response_draft IS NULL) "
            "OR (response_status IS NULL AND response_draft IS NULL)"
        )
        checks += [
            member("response_status", "response_status", vocab.RESPONSE_STATUSES),
            member("response_type", "response_type", vocab.RESPONSE_TYPES),
            before("tickets.response_generated_ts", "response_generated_at", "created_at"),
            RowCheck("tickets.response_draft_status_consistency", f"NOT ({consistent})", "response_status"),
        ]
    return checks


def key_constraints(tables: Tables) -> DataFrame:
    """Primary key, UNIQUE, foreign key and owner constraints. As in SQL, NULL breaks none of them."""
    unique = [(t, k, "pk") for t, k in schemas.KEYS.items()]
    unique += [("customers", "email", "email_unique"), ("products", "sku", "sku_unique")]
    links = [
        ("orders", "customers", "customer_id"),
        ("order_items", "orders", "order_id"),
        ("order_items", "products", "product_id"),
        ("tickets", "customers", "customer_id"),
        ("tickets", "orders", "order_id"),
    ]
    repeated = [duplicates(tables[t].where(F.col(c).isNotNull()), f"{t}.{name}", [c]) for t, c, name in unique]
    dangling = [
        finding(
            dangling_rows(tables, child, parent, key, null_is_orphan=False),
            f"{child}.{key}_fk", F.col(schemas.KEYS[child]), F.col(key),
        )
        for child, parent, key in links
    ]
    foreign_owner = owner_mismatch(tables).withColumn("check_name", F.lit("tickets.order_owner"))
    return _all([*repeated, *dangling, foreign_owner])


def constraints_suite(tables: Tables) -> DataFrame:
    """The declared constraints that one row can break, one scan per table; ``key_constraints`` has those between rows."""
    frames = [
        row_checks(df, schemas.KEYS[t], constraint_checks(t, df.columns)) for t, df in tables.items()
    ]
    return _all(frames)


def run_checks(tables: Tables, suite: str, stage: str | None = None) -> DataFrame:
    """Violations of one suite by name: tables, routing, responses, analytics, constraints. For ``stage`` see ``tables_suite``."""

    def analytics() -> DataFrame:
        fact = views.ticket_fact(tables["tickets"], tables["customers"], tables["orders"])
        return analytics_suite(fact, tables["tickets"], views.all_metrics(tables["tickets"]))

    suites = {
        "tables": lambda: tables_suite(tables, stage),
        "routing": lambda: routing_suite(tables["tickets"]),
        "responses": lambda: response_suite(tables["tickets"]),
        "analytics": analytics,
        "constraints": lambda: constraints_suite(tables).unionByName(key_constraints(tables)),
    }
    return suites[suite]()
