"""Grouped dashboard measures over the ticket fact, chart queries and the date dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions.numeric import fraction, half_up_ratio
from ticketloom.functions.sql import as_list, q
from ticketloom.operators.medians import HUNDREDTHS, exact_medians
from ticketloom.vocab import DEFAULTS, Thresholds

# Base counts and the columns each one pins: a pinned column's own filter is
# replaced by the measure's, so the count ignores a grouping on that column.
PINNED = {
    "classified_tickets": {"ai_predicted_category"},
    "confidence_available_tickets": {"classification_confidence"},
    "low_confidence_tickets": {"classification_confidence"},
    "exact_category_matches": set(),
    "tickets_with_rule_decision": {"decision_path"},
    "automated_decisions": {"decision_path"},
    "human_review_decisions": {"decision_path"},
    "high_urgent_human_review_tickets": {"decision_path", "final_priority"},
    "urgent_only_human_review_count": {"decision_path", "final_priority"},
    "response_processed": {"response_status"},
    "drafts_generated": {"response_status"},
    "human_review_drafts": {"response_status"},
    "blocked_responses": {"response_status"},
    "not_eligible_responses": {"response_status"},
}
# (rate, numerator, denominator, empty slice gives 0 on the dashboard)
RATES = [
    ("classification_coverage", "classified_tickets", "total_tickets", True),
    ("human_review_rate", "human_review_decisions", "tickets_with_rule_decision", True),
    ("automated_rate", "automated_decisions", "tickets_with_rule_decision", True),
    ("high_urgent_human_review_rate", "high_urgent_human_review_tickets", "tickets_with_rule_decision", True),
    ("resolution_timestamp_rate", "tickets_with_resolution_timestamp", "total_tickets", False),
    ("low_confidence_rate", "low_confidence_tickets", "confidence_available_tickets", False),
    ("exact_category_match_rate", "exact_category_matches", "classified_tickets", False),
    ("response_processed_rate", "response_processed", "total_tickets", False),
    ("draft_generation_rate", "drafts_generated", "response_processed", False),
    ("human_review_response_rate", "human_review_drafts", "response_processed", False),
    ("blocked_rate", "blocked_responses", "response_processed", False),
    ("not_eligible_rate", "not_eligible_responses", "response_processed", False),
]
# (measure, fact column): means of exact decimals and of the priority score.
AVERAGES = [
    ("avg_classification_confidence", "classification_confidence"),
    ("average_priority_score", "final_priority_score"),
    ("avg_first_response_minutes", "first_response_minutes"),
    ("avg_resolution_hours", "resolution_hours"),
    ("avg_rule_decision_hours", "rule_decision_hours"),
    ("avg_response_generation_hours", "response_generation_hours"),
]
MEDIANS = [
    ("median_first_response_minutes", "first_response_minutes"),
    ("median_resolution_hours", "resolution_hours"),
]


def _counts(limits: Thresholds) -> dict[str, str]:
    human = f"decision_path = {q(vocab.HUMAN_REVIEW)}"
    status = "count_if(response_status = '{}')"
    return {
        "total_tickets": "count(1)",
        "classified_tickets": "count(ai_predicted_category)",
        "confidence_available_tickets": "count(classification_confidence)",
        "low_confidence_tickets": f"count_if(classification_confidence < {limits.low_confidence})",
        "exact_category_matches": "count_if(ai_predicted_category = ground_truth_category)",
        "tickets_with_first_response": "count(first_response_at)",
        "tickets_with_resolution_timestamp": "count(resolved_at)",
        "tickets_with_rule_decision": "count(decision_path)",
        "automated_decisions": f"count_if(decision_path = {q(vocab.AUTOMATED)})",
        "human_review_decisions": f"count_if({human})",
        "high_urgent_human_review_tickets": f"count_if({human} AND final_priority IN ('High', 'Urgent'))",
        "urgent_only_human_review_count": f"count_if({human} AND final_priority = 'Urgent')",
        "response_processed": "count(response_status)",
        "drafts_generated": status.format("DRAFT_GENERATED"),
        "human_review_drafts": status.format("HUMAN_REVIEW_DRAFT"),
        "blocked_responses": status.format("BLOCKED"),
        "not_eligible_responses": status.format("NOT_ELIGIBLE"),
    }


def _sums() -> dict[str, str]:
    """Sum and count of what is averaged."""
    out = {}
    for name, column in AVERAGES:
        out[f"_{name}_sum"] = f"sum({column})"
        out[f"_{name}_n"] = f"count({column})"
    return out


def _aggregates(limits: Thresholds) -> list[Column]:
    return [F.expr(e).alias(n) for n, e in (_counts(limits) | _sums()).items()]


def _finish(grouped: DataFrame, by: Sequence[str], empty: str) -> DataFrame:
    out = {name: name for name in _counts(DEFAULTS)}
    out["unclassified_tickets"] = "total_tickets - classified_tickets"
    out["response_not_processed"] = "total_tickets - response_processed"
    for rate, num, den, zero in RATES:
        value = fraction(num, den)
        out[rate] = f"coalesce({value}, 0D)" if zero and empty == "zero" else value
    for name, _ in AVERAGES:
        out[name] = fraction(f"_{name}_sum", f"_{name}_n")
    return grouped.selectExpr(*by, *as_list(out))


def measures(
    fact: DataFrame, by: Sequence[str] = (), *, empty: str = "null", limits: Thresholds = DEFAULTS
) -> DataFrame:
    """Every count, rate and average measure per slice, from one aggregate.

    ``by`` holds the slicer columns. A count that pins a column ignores the
    grouping on it: it is summed over the slices that differ in that column
    only. Such a sum is a second aggregate of the already grouped rows. With
    ``empty='zero'`` the four dashboard rates show 0 on an empty slice.
    """
    by = list(by)
    grouped = fact.groupBy(*by).agg(*_aggregates(limits))
    pinned_sets: dict[tuple[str, ...], list[str]] = {}
    for name, pins in PINNED.items():
        hit = tuple(k for k in by if k in pins)
        if hit:
            pinned_sets.setdefault(hit, []).append(name)
    for hit, names in pinned_sets.items():
        scope = Window.partitionBy(*[k for k in by if k not in hit])
        grouped = grouped.withColumns({n: F.sum(n).over(scope) for n in names})
    return _finish(grouped, by, empty)


def measures_for_sets(
    fact: DataFrame, sets: Sequence[Sequence[str]], *, empty: str = "null", limits: Thresholds = DEFAULTS
) -> DataFrame:
    """The measures under several slicer sets at once, by GROUPING SETS.

    ``grouping_id`` tells a subtotal's NULL key from a NULL value. No set may
    hold a pinned column; use ``measures`` for those.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    clash = {k for k in keys for pins in PINNED.values() if k in pins}
    if clash:
        raise ValueError(f"measures pin these columns: {sorted(clash)}")
    grouped = fact.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.grouping_id(*keys).alias("grouping_id"), *_aggregates(limits)
    )
    return _finish(grouped, [*keys, "grouping_id"], empty)


def median_measures(fact: DataFrame, by: Sequence[str] = (), *, approx: bool = False) -> DataFrame:
    """Ticket count and exact medians of the 2-decimal durations per slice; NULL where none.

    ``approx`` takes the medians from quantile sketches, in one pass; see ``sketches``.
    """
    by = list(by)
    if approx:
        from ticketloom.operators import sketches

        made = sketches.sketched(fact, {name: f"{column} * 100" for name, column in MEDIANS}, by)
        return sketches.median_measures(made, by)
    values = {name: f"{column} * 100" for name, column in MEDIANS}
    middles = exact_medians(fact, values, by, levels=HUNDREDTHS)
    halves = middles.selectExpr(*[f"{k} AS _of_{k}" for k in by], *[f"{n} / 200D AS {n}" for n in values])
    slices = fact.groupBy(*by).agg(F.count(F.lit(1)).alias("total_tickets"))
    if not by:
        return slices.withColumn("_m", halves.select(F.struct("*")).scalar()).select("total_tickets", "_m.*")
    same = " AND ".join(f"{k} <=> _of_{k}" for k in by)
    return slices.join(halves, F.expr(same), "left").drop(*[f"_of_{k}" for k in by])


def median_measures_for_sets(fact: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """``median_measures`` under several slicer sets at once, with ``grouping_id`` as in ``measures_for_sets``.

    Facts are read once: each row goes on once a set, with NULL for the keys
    outside it, and is counted per slice and value before anything is shuffled.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))

    def entry(chosen: Sequence[str]) -> str:
        absent = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in chosen)
        parts = [f"{q(k)}, {k if k in chosen else f'CAST(NULL AS {fact.schema[k].dataType.simpleString()})'}" for k in keys]
        return f"named_struct({', '.join([*parts, f"'grouping_id', {absent}L"])})"

    durations = [column for _, column in MEDIANS]
    spread = fact.selectExpr(*durations, f"inline(array({', '.join(entry(s) for s in sets)}))")
    return median_measures(spread, [*keys, "grouping_id"])


def texts(measured: DataFrame) -> DataFrame:
    """Adds the three text measures: match label, coverage warning, routing note."""
    match = half_up_ratio("(exact_category_matches * 100)", "classified_tickets", 2)
    # --- Fixed values: label wording and the small-sample bound ---
    columns = {
        "exact_category_match_label": "CASE WHEN exact_category_match_rate IS NULL THEN 'Not available' "
        f"ELSE concat(CAST({match} AS STRING), '% on ', format_number(classified_tickets, 0), ' classified sample(s)') END",
        "ai_coverage_warning": "CASE WHEN classified_tickets < 30 THEN concat('AI sample size is very small: ', "
        "format_number(classified_tickets, 0), ' of ', format_number(total_tickets, 0), "
        "' tickets. Not enough to claim validated accuracy.') END",
        "routing_context_note": "concat('Human-review routing is a rule-engine outcome: a ticket with no AI "
        "classification is always routed to human review. ', format_number(unclassified_tickets, 0), ' of ', "
        "format_number(total_tickets, 0), ' tickets have no AI classification.')",
    }
    return measured.withColumns({n: F.expr(e) for n, e in columns.items()})


def slicer(
    fact: DataFrame, date_from: str | None = None, date_to: str | None = None, channels: Sequence[str] | None = None
) -> DataFrame:
    """Date range (both ends included) and channel filter; both reach the scan."""
    if date_from is not None:
        fact = fact.where(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        fact = fact.where(F.col("created_at") < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp_ntz"))
    if channels is not None:
        fact = fact.where(F.col("channel").isin(list(channels)))
    return fact


def chart(fact: DataFrame, column: str, keep_blank: bool = True) -> DataFrame:
    """Tickets per value of one column."""
    rows = fact if keep_blank else fact.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("tickets"))


def created_date(fact: DataFrame) -> DataFrame:
    return fact.withColumn("created_date", F.to_date("created_at"))


def date_range(fact: DataFrame) -> DataFrame:
    return fact.agg(F.to_date(F.min("created_at")).alias("first_date"), F.to_date(F.max("created_at")).alias("last_date"))


def date_dimension(fact: DataFrame) -> DataFrame:
    """One row per calendar day from the first to the last creation date."""
    return calendar(date_range(fact))


def calendar(span: DataFrame) -> DataFrame:
    """The days of one row ``first_date, last_date`` with their parts."""
    days = span.select(F.explode(F.sequence("first_date", "last_date")).alias("date"))
    d = F.col("date")
    return days.select(
        "date",
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMM").alias("month_name"),
        F.day(d).alias("day"),
        (F.dayofweek(d) - 1).alias("day_of_week"),
        F.date_format(d, "E").alias("day_name"),
        (F.weekday(d) >= 5).alias("is_weekend"),
    )


def daily_volume(fact: DataFrame) -> DataFrame:
    """Tickets per calendar day, days without tickets included."""
    per_day = fact.groupBy(F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("tickets"))
    span = per_day.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))  # the shuffle of the counts serves both
    return calendar(span).join(per_day, "date", "left").withColumn("tickets", F.coalesce("tickets", F.lit(0)))
