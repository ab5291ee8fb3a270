"""KPIs and planned charts over the ticket fact."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions.labels import confidence_bucket
from ticketloom.functions.numeric import MICROS_PER_HOUR, exact_sum, half_up_ratio, micros_between, pct
from ticketloom.functions.sql import q
from ticketloom.operators.medians import HUNDREDTHS, exact_medians, exact_quantiles
from ticketloom.vocab import DEFAULTS, Thresholds

MONTH = "trunc(to_date(created_at), 'month')"
HIT = "ai_predicted_category = ground_truth_category"
AUTOMATED = f"decision_path = {q(vocab.AUTOMATED)}"


def summarise(fact: DataFrame, by: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """Group by named expressions, aggregate named expressions."""
    keys = [F.expr(e).alias(n) for n, e in by.items()]
    return fact.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in columns.items()])


def volume(fact: DataFrame, period: str = "month") -> DataFrame:
    """Tickets per period by category, priority and channel."""
    start = f"to_date(date_trunc({q(period)}, created_at))"
    names = ["ground_truth_category", "original_priority", "channel"]
    return summarise(fact, {"period": start} | {n: n for n in names}, {"tickets": "count(1)"})


def labelled_accuracy(fact: DataFrame) -> DataFrame:
    both = "ai_predicted_category IS NOT NULL AND ground_truth_category IS NOT NULL"
    return summarise(
        fact,
        {},
        {
            "labelled": f"count_if({both})",
            "correct": f"count_if({HIT})",
            "accuracy_pct": pct(f"count_if({HIT})", f"count_if({both})"),
        },
    )


def path_rates(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return summarise(
        fact,
        {k: k for k in by},
        {
            "decided": "count(decision_path)",
            "automation_rate_pct": pct(f"count_if({AUTOMATED})", "count(decision_path)"),
            "human_review_rate_pct": pct(f"count_if(decision_path = {q(vocab.HUMAN_REVIEW)})", "count(decision_path)"),
        },
    )


def mean_hours(fact: DataFrame, start: str, end: str, by: Sequence[str], name: str) -> DataFrame:
    """Count and exact mean of a duration in hours per group."""
    micros = micros_between(start, end)
    hours = half_up_ratio(exact_sum(micros), f"(CAST(count({micros}) AS DECIMAL(18,0)) * {MICROS_PER_HOUR})", 2)
    return summarise(fact, {k: k for k in by}, {"n": f"count({micros})", name: hours})


def processing_time(fact: DataFrame) -> DataFrame:
    return mean_hours(fact, "created_at", "decision_at", [], "avg_processing_hours")


def resolution_by_type(fact: DataFrame) -> DataFrame:
    resolved = fact.where("resolved_at IS NOT NULL")
    return mean_hours(resolved, "created_at", "resolved_at", ["resolution_type"], "avg_resolution_hours")


def sentiment(fact: DataFrame) -> DataFrame:
    """Mean sentiment overall, by predicted category and by month, as ``(dimension, key, n, avg_sentiment)``."""
    entries = (
        "inline(array(named_struct('dimension', 'overall', 'key', 'all'), "
        f"named_struct('dimension', 'category', 'key', coalesce(ai_predicted_category, {q(vocab.UNCLASSIFIED)})), "
        "named_struct('dimension', 'month', 'key', date_format(created_at, 'yyyy-MM'))))"
    )
    scored = fact.where("sentiment_score IS NOT NULL").selectExpr("sentiment_score", entries)
    mean = half_up_ratio(exact_sum("sentiment_score * 100"), "(count(1) * 100)", 4)
    return summarise(scored, {"dimension": "dimension", "key": "key"}, {"n": "count(1)", "avg_sentiment": mean})


def cost_savings(fact: DataFrame, cost_per_ticket: Decimal | None = None) -> DataFrame:
    """Automated tickets times the cost of one by hand; NULL without that cost."""
    cost = "CAST(NULL AS DECIMAL(10,2))" if cost_per_ticket is None else f"CAST({q(str(cost_per_ticket))} AS DECIMAL(10,2))"
    saved = f"round(CAST(count_if({AUTOMATED}) AS DECIMAL(18,0)) * {cost}, 2)"
    return summarise(fact, {}, {"automated_tickets": f"count_if({AUTOMATED})", "estimated_savings": saved})


def service_quality(fact: DataFrame, sla_hours: int) -> DataFrame:
    """Reopened rate, share resolved within the SLA, share of automated tickets that ended with a human."""
    resolved = "count(resolved_at)"
    in_time = f"{micros_between('created_at', 'resolved_at')} <= {sla_hours * MICROS_PER_HOUR}"
    automated = f"resolved_at IS NOT NULL AND {AUTOMATED}"
    return summarise(
        fact,
        {},
        {
            "resolved": resolved,
            "reopened_rate_pct": pct("count_if(resolved_at IS NOT NULL AND status = 'Reopened')", resolved),
            "sla_compliance_pct": pct(f"count_if({in_time})", resolved),
            "false_automation_rate_pct": pct(
                f"count_if({automated} AND resolution_type IN ('Human', 'Hybrid'))", f"count_if({automated})"
            ),
        },
    )


def order_value_percentiles(orders: DataFrame) -> DataFrame:
    """p50, p75, p90, p95 and maximum of the order totals, exact to the interpolated cent."""
    shares = {"p50": (1, 2), "p75": (3, 4), "p90": (9, 10), "p95": (19, 20)}
    found = exact_quantiles(orders, "total_amount * 100", shares, levels=HUNDREDTHS)
    most = orders.agg(F.max("total_amount").cast("double")).scalar()
    return found.select(F.col("n").alias("orders"), *[(F.col(p) / 100).alias(p) for p in shares], most.alias("max_value"))


def confidence_calibration(fact: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Accuracy per confidence decile and side of the threshold."""
    rows = fact.where("ai_predicted_category IS NOT NULL AND classification_confidence IS NOT NULL")
    return summarise(
        rows,
        {
            "decile": "CAST(least(floor(classification_confidence * 10), 9) AS BIGINT)",
            "side": confidence_bucket("classification_confidence", limits.low_confidence),
        },
        {"n": "count(1)", "correct": f"count_if({HIT})", "accuracy_pct": pct(f"count_if({HIT})", "count(1)")},
    )


def cross_count(fact: DataFrame, *columns: str) -> DataFrame:
    """Tickets per combination of values, e.g. path by priority or status by path."""
    return summarise(fact, {c: c for c in columns}, {"tickets": "count(1)"})


def urgent_tickets(fact: DataFrame) -> DataFrame:
    """Tickets that await an urgent human review, all of them, unsorted."""
    return fact.where("recommended_action = 'HUMAN_REVIEW_URGENT'").select(
        "ticket_id", "created_at", "channel", "ai_predicted_category", "final_priority", "sentiment_score"
    )


def monthly_medians(fact: DataFrame) -> DataFrame:
    """Exact median first response and resolution per creation month."""
    monthly = fact.withColumn("month", F.expr(MONTH))
    result = summarise(monthly, {"month": "month"}, {"tickets": "count(1)"})
    names = {f"median_{c}": f"{c} * 100" for c in ("first_response_minutes", "resolution_hours")}
    middles = exact_medians(monthly, names, ["month"], levels=HUNDREDTHS)
    halves = middles.selectExpr("month", *[f"{n} / 200D AS {n}" for n in names])
    return result.join(halves, "month", "left")


def mean_duration(fact: DataFrame, column: str, by: str) -> DataFrame:
    """Exact mean of a 2-decimal duration column per value, e.g. first response by channel."""
    mean = half_up_ratio(exact_sum(f"{column} * 100"), "(count(1) * 100)", 2)
    return summarise(fact.where(f"{column} IS NOT NULL"), {by: by}, {"n": "count(1)", f"avg_{column}": mean})


def value_against_resolution(fact: DataFrame, width: int = 50) -> DataFrame:
    """Order total in bands against resolution hours."""
    rows = fact.where("order_total_amount IS NOT NULL AND resolution_hours IS NOT NULL")
    mean = half_up_ratio(exact_sum("resolution_hours * 100"), "(count(1) * 100)", 2)
    return summarise(
        rows,
        {"value_band": f"CAST(floor(order_total_amount / {width}) * {width} AS BIGINT)"},
        {"n": "count(1)", "avg_resolution_hours": mean},
    )
