"""The ticket fact view and the four one-row metric views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom import vocab
from ticketloom.functions.labels import priority_score, recommended_action
from ticketloom.functions.numeric import (
    MICROS_PER_HOUR,
    MICROS_PER_MINUTE,
    duration,
    exact_sum,
    half_up_ratio,
    micros_between,
    pct,
)
from ticketloom.functions.sql import as_list, q
from ticketloom.operators.joins import lookup_join
from ticketloom.operators.medians import exact_medians
from ticketloom.vocab import DEFAULTS, Thresholds

VIEW_NAMES = [
    "vw_ticket_analytics",
    "vw_classification_metrics",
    "vw_rule_decision_metrics",
    "vw_response_metrics",
    "vw_operational_metrics",
]

# (column, start, end, unit) of the derived durations.
DURATIONS = [
    ("first_response_minutes", "created_at", "first_response_at", MICROS_PER_MINUTE),
    ("resolution_hours", "created_at", "resolved_at", MICROS_PER_HOUR),
    ("rule_decision_hours", "created_at", "rule_decision_at", MICROS_PER_HOUR),
    ("response_generation_hours", "created_at", "response_generated_at", MICROS_PER_HOUR),
]


TICKET_PART = {
    "ticket_id": "ticket_id",
    "created_at": "created_at",
    "first_response_at": "first_response_at",
    "resolved_at": "resolved_at",
    "channel": "channel",
    "ground_truth_category": "category",
    "ai_predicted_category": "ai_predicted_category",
    "classification_confidence": "classification_confidence",
    "original_priority": "priority",
    "final_priority": "final_priority",
    "status": "status",
    "decision_path": "decision_path",
    "resolution_type": "resolution_type",
    "sentiment_score": "sentiment_score",
    "decision_at": "decision_at",
    "rule_decision_at": "rule_decision_at",
    "response_status": "response_status",
    "response_type": "response_type",
    "response_generated_at": "response_generated_at",
}
CUSTOMER_PART = {"customer_segment": "customer_segment", "country": "country", "customer_is_active": "is_active"}
ORDER_PART = {
    "order_status": "order_status",
    "order_total_amount": "total_amount",
    "payment_method": "payment_method",
    "order_date": "order_date",
    "expected_delivery_date": "expected_delivery_date",
    "actual_delivery_date": "actual_delivery_date",
}


def ticket_fact(tickets: DataFrame, customers: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """One row per ticket with its customer and order: 36 columns.

    Tickets without a customer drop out; order lines are not joined, so the
    grain holds. Derived columns are lazy: a query pays only for what it reads.
    Spark cannot know that the left join to orders keeps every row as it is,
    so a report that reads no order column passes no orders: the fact then
    lacks the seven order columns, and the shuffle by order is saved.
    """
    people = customers.selectExpr("customer_id", *as_list(CUSTOMER_PART))
    joined = tickets.join(people, "customer_id")
    columns = TICKET_PART | {n: n for n in CUSTOMER_PART} | {"order_id": "order_id"}
    if orders is not None:
        joined = lookup_join(joined, orders.selectExpr("order_id", *as_list(ORDER_PART)), "order_id", "ticket_id")
        columns |= {n: n for n in ORDER_PART}
        columns["delivery_delay_days"] = "datediff(actual_delivery_date, expected_delivery_date)"
    columns |= {name: duration(micros_between(start, end), unit) for name, start, end, unit in DURATIONS}
    columns["final_priority_score"] = priority_score("final_priority")
    columns["recommended_action"] = recommended_action("decision_path", "final_priority")
    return joined.selectExpr(*as_list(columns))


Reader = Callable[[str], str]


@dataclass(frozen=True)
class MetricView:
    """A one-row view: named aggregates, and its columns over their results, as SQL text.

    The two parts are apart so that several views can share one scan.
    """

    aggregates: dict[str, str]
    columns: Callable[[Reader], dict[str, str]]
    medians: dict[str, tuple[str, int]] = field(default_factory=dict)


def classification_view(limits: Thresholds = DEFAULTS) -> MetricView:
    confidence = "classification_confidence"
    return MetricView(
        {
            "total": "count(1)",
            "classified": "count(ai_predicted_category)",
            "confident": f"count({confidence})",
            "low": f"count_if({confidence} < {limits.low_confidence})",
            "mills": exact_sum(f"{confidence} * 1000"),
            "least": f"min({confidence})",
            "most": f"max({confidence})",
            "matches": "count_if(ai_predicted_category = category)",
        },
        lambda c: {
            "total_tickets": c("total"),
            "classified_tickets": c("classified"),
            "unclassified_tickets": f"{c('total')} - {c('classified')}",
            "classification_coverage_pct": pct(c("classified"), c("total")),
            "confidence_available": c("confident"),
            "low_confidence_tickets": c("low"),
            "low_confidence_rate_pct": pct(c("low"), c("confident")),
            "average_confidence": half_up_ratio(c("mills"), f"({c('confident')} * 1000)", 4),
            "minimum_confidence": f"round({c('least')}, 4)",
            "maximum_confidence": f"round({c('most')}, 4)",
            "exact_category_matches": c("matches"),
            "exact_category_match_rate_pct": pct(c("matches"), c("classified")),
        },
    )


def rule_decision_view() -> MetricView:
    human = f"decision_path = {q(vocab.HUMAN_REVIEW)}"
    score = priority_score("final_priority")
    return MetricView(
        {
            "total": "count(1)",
            "decided": "count(decision_path)",
            "automated": f"count_if(decision_path = {q(vocab.AUTOMATED)})",
            "human": f"count_if({human})",
            "urgent": f"count_if({human} AND final_priority IN ('High', 'Urgent'))",
            "prioritised": "count(final_priority)",
            "score_sum": f"sum({score})",
            "scored": f"count({score})",
        },
        lambda c: {
            "total_tickets": c("total"),
            "tickets_with_rule_decision": c("decided"),
            "automated_decisions": c("automated"),
            "human_review_decisions": c("human"),
            "automated_rate_pct": pct(c("automated"), c("decided")),
            "human_review_rate_pct": pct(c("human"), c("decided")),
            "urgent_human_review": c("urgent"),
            "urgent_human_review_rate_pct": pct(c("urgent"), c("decided")),
            "final_priority_set": c("prioritised"),
            "average_priority_score": half_up_ratio(c("score_sum"), c("scored"), 3),
        },
    )


# Count and rate columns of the four statuses.
STATUS_COLUMNS = {
    "DRAFT_GENERATED": ("drafts_generated", "draft_generation_rate_pct"),
    "HUMAN_REVIEW_DRAFT": ("human_review_drafts", "human_review_response_rate_pct"),
    "BLOCKED": ("blocked_responses", "blocked_rate_pct"),
    "NOT_ELIGIBLE": ("not_eligible_responses", "not_eligible_rate_pct"),
}


def response_view() -> MetricView:
    return MetricView(
        {"total": "count(1)", "processed": "count(response_status)"}
        | {value: f"count_if(response_status = {q(value)})" for value in STATUS_COLUMNS},
        lambda c: {
            "total_tickets": c("total"),
            "response_processed": c("processed"),
            "response_not_processed": f"{c('total')} - {c('processed')}",
        }
        | {n: c(value) for value, (n, _) in STATUS_COLUMNS.items()}
        | {"response_processed_rate_pct": pct(c("processed"), c("total"))}
        | {rate: pct(c(value), c("processed")) for value, (_, rate) in STATUS_COLUMNS.items()},
    )


# (end column, count name, average name, median name, unit)
LATENCIES = [
    ("first_response_at", "tickets_with_first_response", "avg_first_response_minutes",
     "median_first_response_minutes", MICROS_PER_MINUTE),
    ("resolved_at", "resolved_tickets", "avg_resolution_hours", "median_resolution_hours", MICROS_PER_HOUR),
    ("rule_decision_at", "tickets_with_rule_decision", "avg_rule_decision_hours", None, MICROS_PER_HOUR),
    ("response_generated_at", "responses_generated", "avg_response_generation_hours", None, MICROS_PER_HOUR),
]


def operational_view() -> MetricView:
    aggregates = {"total": "count(1)"}
    for end, *_ in LATENCIES:
        aggregates[f"n_{end}"] = f"count({end})"
        aggregates[f"sum_{end}"] = exact_sum(micros_between("created_at", end))

    def columns(c: Reader) -> dict[str, str]:
        out = {"total_tickets": c("total")}
        for end, n, average, median, unit in LATENCIES:
            out[n] = c(f"n_{end}")
            out[average] = half_up_ratio(c(f"sum_{end}"), f"(CAST({c(f'n_{end}')} AS DECIMAL(18,0)) * {unit})", 2)
            if median:
                out[median] = c(median)
        return out

    return MetricView(aggregates, columns, {m: (end, unit) for end, _, _, m, unit in LATENCIES if m})


def evaluate_views(tickets: DataFrame, views: dict[str, MetricView]) -> DataFrame:
    """One row with a struct per view; all plain aggregates come from one scan.

    Exact medians take their own passes over two timestamp columns.
    """
    row = tickets.agg(
        *[F.expr(a).alias(f"{view}_{name}") for view, v in views.items() for name, a in v.aggregates.items()]
    )
    medians = median_columns(views)
    if medians:
        middles = exact_medians(tickets, {n: micros_between("created_at", end) for n, (end, _) in medians.items()})
        row = with_medians(row, middles, medians)
    return shown(row, views)


def median_columns(views: dict[str, MetricView]) -> dict[str, tuple[str, int]]:
    """End column and unit of every median, by the name it has in the row of aggregates."""
    return {f"{view}_{name}": spec for view, v in views.items() for name, spec in v.medians.items()}


def with_medians(row: DataFrame, middles: DataFrame, medians: dict[str, tuple[str, int]]) -> DataFrame:
    """The row with the medians, from the sums of the two middle values."""
    halves = as_list({n: half_up_ratio(n, str(2 * unit), 2) for n, (_, unit) in medians.items()})
    return row.withColumn("_m", middles.selectExpr(*halves).select(F.struct("*")).scalar()).select("*", "_m.*")


def shown(row: DataFrame, views: dict[str, MetricView]) -> DataFrame:
    """The row of aggregates as one struct per view."""
    structs = []
    for view, v in views.items():
        fields = ", ".join(f"{q(n)}, {e}" for n, e in v.columns(lambda name: f"{view}_{name}").items())
        structs.append(f"named_struct({fields}) AS {view}")
    return row.selectExpr(*structs)


def _one(tickets: DataFrame, view: MetricView) -> DataFrame:
    return evaluate_views(tickets, {"v": view}).select("v.*")


def classification_metrics(tickets: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    return _one(tickets, classification_view(limits))


def rule_decision_metrics(tickets: DataFrame) -> DataFrame:
    return _one(tickets, rule_decision_view())


def response_metrics(tickets: DataFrame) -> DataFrame:
    return _one(tickets, response_view())


def operational_metrics(tickets: DataFrame) -> DataFrame:
    """Counts, averages and exact medians of the latencies."""
    return _one(tickets, operational_view())


def all_views(limits: Thresholds = DEFAULTS) -> dict[str, MetricView]:
    return {
        "classification": classification_view(limits),
        "rule_decisions": rule_decision_view(),
        "responses": response_view(),
        "operational": operational_view(),
    }


def all_metrics(tickets: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """The four metric views as four struct columns of one row."""
    return evaluate_views(tickets, all_views(limits))


def backlog(tickets: DataFrame) -> DataFrame:
    return tickets.agg(
        F.count(F.lit(1)).alias("total_tickets"), F.count("ai_predicted_category").alias("classified_tickets")
    ).withColumn("unclassified_tickets", F.col("total_tickets") - F.col("classified_tickets"))


def stage_counters(tickets: DataFrame) -> DataFrame:
    return tickets.agg(
        F.count("ai_predicted_category").alias("classified"),
        F.count("decision_path").alias("decided"),
        F.count("response_status").alias("processed"),
    )


def register_views(spark: SparkSession, tickets: DataFrame, customers: DataFrame, orders: DataFrame) -> None:
    """The five views as temporary views, computed at query time."""
    ticket_fact(tickets, customers, orders).createOrReplaceTempView("vw_ticket_analytics")
    classification_metrics(tickets).createOrReplaceTempView("vw_classification_metrics")
    rule_decision_metrics(tickets).createOrReplaceTempView("vw_rule_decision_metrics")
    response_metrics(tickets).createOrReplaceTempView("vw_response_metrics")
    operational_metrics(tickets).createOrReplaceTempView("vw_operational_metrics")


def missing_views(spark: SparkSession, expected: list[str] = VIEW_NAMES) -> list[str]:
    """Expected view names that the catalog does not hold."""
    return [name for name in expected if not spark.catalog.tableExists(name)]


#: The writer's own format would cut times to milliseconds.
CSV = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "escape": '"'}


def write_csv(frame: DataFrame, path: str) -> None:
    """A view as CSV with header; files are written in parallel, times keep their microseconds."""
    frame.write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_csv`` wrote, with the types of the view."""
    return spark.read.options(**CSV).schema(schema).csv(path)


def export_views(spark: SparkSession, directory: str) -> None:
    """CSV with header, one directory per view."""
    for name in VIEW_NAMES:
        write_csv(spark.table(name), f"{directory}/{name}")


def import_views(spark: SparkSession, casts: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The five views, columns retyped on request (``{column: type}``)."""
    return {
        name: spark.table(name).withColumns(
            {c: F.col(c).cast(t) for c, t in (casts or {}).items() if c in spark.table(name).columns}
        )
        for name in VIEW_NAMES
    }
