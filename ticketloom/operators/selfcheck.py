"""Metric self-check: every rate derived again from its counts, medians from the fact rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.labels import not_available
from ticketloom.functions.numeric import half_up_ratio, pct
from ticketloom.functions.sql import as_list, q
from ticketloom.operators.medians import HUNDREDTHS, exact_medians
from ticketloom.operators.quality import consistency_checks, grain, row_checks
from ticketloom.operators.views import STATUS_COLUMNS

# --- Fixed values: tolerances ---
PCT_TOLERANCE = Decimal("0.01")
MEDIAN_TOLERANCE = Decimal("0.02")
SUM_TOLERANCE = Decimal("0.05")


BLOCKS = ["classification AS c", "rule_decisions AS r", "responses AS p", "operational AS o"]


def agree(a: str, b: str, tolerance: Decimal) -> str:
    """Within the tolerance; two NULLs agree, NULL and a number do not."""
    return f"coalesce(abs({a} - {b}) <= {tolerance}, {a} IS NULL AND {b} IS NULL)"


def fact_summary(fact: DataFrame) -> DataFrame:
    """One row from the fact view: rows, distinct tickets, duration counts and medians of the 2-decimal values."""
    counts = fact.agg(
        F.count("first_response_minutes").alias("n_first_response"), F.count("resolution_hours").alias("n_resolved")
    )
    values = {"median_first_response": "first_response_minutes * 100", "median_resolution": "resolution_hours * 100"}
    middles = exact_medians(fact, values, levels=HUNDREDTHS)
    halves = as_list({n: half_up_ratio(n, "200", 3) for n in values})
    extra = {
        "_grain": grain(fact).select(F.struct("n", "d")).scalar(),
        "_m": middles.selectExpr(*halves).select(F.struct("*")).scalar(),
    }
    return counts.withColumns(extra).select("_grain.*", "n_first_response", "n_resolved", "_m.*")


def metric_checks(percentages: list[str]) -> list[tuple[str, str, str]]:
    """``(check, condition of failure, detail)`` over the columns c, r, p, o (the views) and s (the fact summary)."""

    def rate(name: str, stated: str, num: str, den: str) -> tuple[str, str, str]:
        return name, f"NOT {agree(stated, pct(num, den), PCT_TOLERANCE)}", q(f"{name} disagrees with its counts")

    decided, processed = "r.tickets_with_rule_decision", "p.response_processed"
    status_sum = "(" + " + ".join(f"p.{n}" for n, _ in STATUS_COLUMNS.values()) + ")"
    checks = [
        ("ticket_grain", "s.n <> s.d", "concat(s.n, ' fact rows, ', s.d, ' distinct tickets')"),
        ("ticket_grain_vs_total", "s.n <> c.total_tickets", "concat(s.n, ' fact rows, total_tickets ', c.total_tickets)"),
        ("classification_counts", "c.classified_tickets + c.unclassified_tickets <> c.total_tickets",
         "'classified + unclassified <> total_tickets'"),
        rate("classification_coverage_pct", "c.classification_coverage_pct", "c.classified_tickets", "c.total_tickets"),
        rate("low_confidence_rate_pct", "c.low_confidence_rate_pct", "c.low_confidence_tickets", "c.confidence_available"),
        rate("exact_category_match_rate_pct", "c.exact_category_match_rate_pct", "c.exact_category_matches", "c.classified_tickets"),
        ("exact_category_matches", "c.exact_category_matches > c.classified_tickets", "'more matches than classified tickets'"),
        ("rule_decision_counts", f"r.automated_decisions + r.human_review_decisions <> {decided}",
         "'automated + human review <> decided'"),
        rate("automated_rate_pct", "r.automated_rate_pct", "r.automated_decisions", decided),
        rate("human_review_rate_pct", "r.human_review_rate_pct", "r.human_review_decisions", decided),
        rate("urgent_human_review_rate_pct", "r.urgent_human_review_rate_pct", "r.urgent_human_review", decided),
        ("urgent_human_review", "r.urgent_human_review > r.human_review_decisions", "'more urgent reviews than reviews'"),
        ("decision_rates_sum", f"abs(r.automated_rate_pct + r.human_review_rate_pct - 100) > {SUM_TOLERANCE}",
         "'automated_rate_pct + human_review_rate_pct <> 100'"),
        ("response_status_counts", f"{status_sum} <> {processed}",
         f"concat('statuses sum to ', {status_sum}, ', processed is ', {processed})"),
        ("response_processed_partition", f"{processed} + p.response_not_processed <> p.total_tickets",
         "'processed + not processed <> total_tickets'"),
        rate("response_processed_rate_pct", "p.response_processed_rate_pct", processed, "p.total_tickets"),
        *[rate(share, f"p.{share}", f"p.{count}", processed) for count, share in STATUS_COLUMNS.values()],
        *[
            (name, f"NOT {agree(f'o.{name}', f's.{median}', MEDIAN_TOLERANCE)}", q(f"{name} disagrees with the fact rows"))
            for name, median in (
                ("median_first_response_minutes", "median_first_response"),
                ("median_resolution_hours", "median_resolution"),
            )
        ],
        ("first_response_count", "o.tickets_with_first_response <> s.n_first_response",
         "'tickets_with_first_response disagrees with the fact rows'"),
        ("resolved_count", "o.resolved_tickets <> s.n_resolved", "'resolved_tickets disagrees with the fact rows'"),
    ]
    short = {"classification": "c", "rule_decisions": "r", "responses": "p"}
    for path in percentages:
        block, name = path.split(".")
        value = f"{short[block]}.{name}"
        checks.append((path, f"{value} < 0 OR {value} > 100", f"concat('percentage out of range: ', {value})"))
    for name in ("avg_first_response_minutes", "median_first_response_minutes", "avg_resolution_hours", "median_resolution_hours"):
        checks.append((f"operational.{name}", f"o.{name} < 0", f"concat('negative duration: ', o.{name})"))
    return checks


def check_metrics(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """``(severity, check, detail)`` for every disagreement; empty means consistent, not meaningful.

    ``metrics`` is the one-row frame of the four views, ``summary`` that of
    ``fact_summary``.
    """
    row = metrics.withColumn("s", summary.select(F.struct("*")).scalar()).selectExpr(*BLOCKS, "s")
    entries = ", ".join(
        f"CASE WHEN {bad} THEN named_struct('check', {q(name)}, 'detail', {detail}) END"
        for name, bad, detail in metric_checks(percentages(metrics))
    )
    issues = row.selectExpr(f"explode(array({entries})) AS issue").where("issue IS NOT NULL")
    return issues.select(F.lit("ERROR").alias("severity"), "issue.check", "issue.detail")


def percentages(metrics: DataFrame) -> list[str]:
    """The percentage columns as ``block.column``."""
    return [
        f"{block}.{f}"
        for block in ("classification", "rule_decisions", "responses")
        for f in metrics.schema[block].dataType.fieldNames()
        if f.endswith("_pct")
    ]


# --- Errors that break one check each: how far fields are moved, by ``block.field`` ------
MANY = 1_000_000
ERRORS: dict[str, dict[str, float]] = {
    "ticket_grain": {"s.d": -1},
    "ticket_grain_vs_total": {"s.n": 1, "s.d": 1},
    "classification_counts": {"c.unclassified_tickets": 1},
    "exact_category_matches": {"c.exact_category_matches": MANY},
    "rule_decision_counts": {"r.automated_decisions": MANY},
    "urgent_human_review": {"r.urgent_human_review": MANY},
    "decision_rates_sum": {"r.human_review_rate_pct": -0.5},
    "response_status_counts": {"p.blocked_responses": MANY},
    "response_processed_partition": {"p.response_not_processed": 1},
    "median_first_response_minutes": {"o.median_first_response_minutes": 1},
    "median_resolution_hours": {"o.median_resolution_hours": 1},
    "first_response_count": {"o.tickets_with_first_response": 1},
    "resolved_count": {"o.resolved_tickets": 1},
    "classification_counts_do_not_partition": {"c.unclassified_tickets": -1},
    "rule_decisions_do_not_partition": {"r.human_review_decisions": 1},
    "response_statuses_do_not_partition": {"p.drafts_generated": 1},
    "response_processed_partition_broken": {"p.response_processed": -1},
    "urgent_exceeds_human_review": {"r.human_review_decisions": -MANY},
    "matches_exceed_classified": {"c.classified_tickets": -MANY},
    "classification_pct_out_of_range": {"c.low_confidence_rate_pct": -200},
    "rule_pct_out_of_range": {"r.urgent_human_review_rate_pct": 200},
    "response_pct_out_of_range": {"p.blocked_rate_pct": -200},
}


def all_errors(shares: list[str]) -> dict[str, dict[str, float]]:
    """An error for every check: the ones above, each stated rate off by a half, each percentage and duration out of range."""
    short = {"classification": "c", "rule_decisions": "r", "responses": "p"}
    errors = dict(ERRORS)
    for share in shares:
        block, name = share.split(".")
        errors.setdefault(name, {f"{short[block]}.{name}": -0.5})
        errors[share] = {f"{short[block]}.{name}": 200}
    for name, _, _ in metric_checks(shares):
        if name.startswith("operational."):
            errors[name] = {name.replace("operational.", "o."): -1e9}
    return errors


def planted_errors(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """``(planted, fired)``: which checks fire on a row of metrics with one error, for an error per check and for none.

    Sound metrics have no row with ``planted`` 'none', and every check has one in
    which it is both planted and fired. One row of metrics is moved in as many
    ways as there are checks, and all checks look at all of them.
    """
    shares = percentages(metrics)
    errors = {"none": {}} | all_errors(shares)
    moved = ", ".join(f"named_struct('planted', {q(n)}, 'by', map({', '.join(f'{q(p)}, {d}D' for p, d in e.items()) or q('none') + ', 0D'}))" for n, e in errors.items())
    row = metrics.withColumn("s", summary.select(F.struct("*")).scalar()).selectExpr(*BLOCKS, "s", f"inline(array({moved}))")
    blocks = []
    for block in ("c", "r", "p", "o", "s"):
        fields = ", ".join(
            f"{q(f.name)}, CAST({block}.{f.name} + coalesce(by[{q(f'{block}.{f.name}')}], 0D) AS {f.dataType.simpleString()})"
            for f in row.schema[block].dataType.fields
        )
        blocks.append(f"named_struct({fields}) AS {block}")
    # The generator keeps the optimizer from copying the moved blocks into every check.
    packed = row.selectExpr("planted", f"inline(array(named_struct({', '.join(f'{q(b[-1])}, {b[:-5]}' for b in blocks)})))")
    fired = ", ".join(f"CASE WHEN {bad} THEN {q(name)} END" for name, bad, _ in metric_checks(shares))
    by_selfcheck = packed.selectExpr("planted", f"explode(filter(array({fired}), x -> x IS NOT NULL)) AS fired")
    named = packed.selectExpr("planted", "c AS classification", "r AS rule_decisions", "p AS responses")
    by_suite = row_checks(named, "planted", consistency_checks()).select(F.col("key").alias("planted"), F.col("check_name").alias("fired"))
    return by_selfcheck.unionByName(by_suite)


# (block, metric) pairs shown in the summary.
SUMMARY = [
    ("classification", "classified_tickets"),
    ("classification", "classification_coverage_pct"),
    ("classification", "average_confidence"),
    ("classification", "low_confidence_rate_pct"),
    ("classification", "exact_category_match_rate_pct"),
    ("rule_decisions", "tickets_with_rule_decision"),
    ("rule_decisions", "automated_rate_pct"),
    ("rule_decisions", "human_review_rate_pct"),
    ("rule_decisions", "urgent_human_review_rate_pct"),
    ("rule_decisions", "average_priority_score"),
    ("responses", "response_processed"),
    ("responses", "response_processed_rate_pct"),
    ("responses", "draft_generation_rate_pct"),
    ("responses", "blocked_rate_pct"),
    ("operational", "tickets_with_first_response"),
    ("operational", "avg_first_response_minutes"),
    ("operational", "median_first_response_minutes"),
    ("operational", "resolved_tickets"),
    ("operational", "avg_resolution_hours"),
    ("operational", "median_resolution_hours"),
]


def summarize(metrics: DataFrame) -> DataFrame:
    """``(block, metric, value, shown)``: NULL metrics are shown as NOT AVAILABLE, never as 0."""
    entries = ", ".join(
        f"named_struct('block', {q(block)}, 'metric', {q(metric)}, 'value', CAST({block}.{metric} AS DOUBLE), "
        f"'shown', {not_available(f'{block}.{metric}')})"
        for block, metric in SUMMARY
    )
    return metrics.selectExpr(f"inline(array({entries}))")
