"""Evaluation of routing, responses and the classifier; batch summaries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions.labels import confidence_bucket, or_label, recommended_action, sentiment_bucket
from ticketloom.functions.numeric import fraction
from ticketloom.functions.sql import any_of, q
from ticketloom.vocab import DEFAULTS, Thresholds

IN_MEMORY = "REAL (in-memory batch run)"
FROM_DATABASE = "REAL (derived from database)"


def _rate(condition: str) -> str:
    return fraction(f"count_if({condition})", "count(1)")


ROUTING_RATES = {
    "n_processed": "count(1)",
    "automated_rate": _rate(f"decision_path = {q(vocab.AUTOMATED)}"),
    "human_review_rate": fraction(f"count(1) - count_if(decision_path = {q(vocab.AUTOMATED)})", "count(1)"),
    "urgent_human_review_rate": _rate(f"{recommended_action('decision_path', 'final_priority')} = 'HUMAN_REVIEW_URGENT'"),
}


def _one_row(rows: DataFrame, columns: dict[str, str], provenance: str) -> DataFrame:
    return rows.agg(*[F.expr(e).alias(n) for n, e in columns.items()]).withColumn("metric_provenance", F.lit(provenance))


def rules_evaluation(decided: DataFrame, provenance: str = IN_MEMORY) -> DataFrame:
    """One row of rates over all processed tickets, NULL when there are none.

    Everything that is not Automated counts as human review.
    """
    detail = {
        "multi_rule_frequency": _rate("size(triggered_rules) > 1"),
        "conflict_frequency": _rate("conflicting_signals"),
        "fallback_frequency": _rate("is_fallback"),
    }
    return _one_row(decided, ROUTING_RATES | detail, provenance)


def rules_evaluation_stored(results: DataFrame) -> DataFrame:
    """The same from stored columns; what was not stored is NULL, not 0."""
    absent = dict.fromkeys(["multi_rule_frequency", "conflict_frequency", "fallback_frequency"], "CAST(NULL AS DOUBLE)")
    return _one_row(results, ROUTING_RATES, FROM_DATABASE).withColumns({n: F.expr(e) for n, e in absent.items()})


def _entry(dimension: str, key: str) -> str:
    return f"named_struct('dimension', {q(dimension)}, 'key', {key})"


def _context_entries(threshold: Decimal) -> list[str]:
    return [
        _entry("category", or_label("nullif(ai_predicted_category, '')", vocab.UNCLASSIFIED)),
        _entry("sentiment", sentiment_bucket("sentiment_score")),
        _entry("confidence", confidence_bucket("classification_confidence", threshold)),
    ]


def _long_counts(rows: DataFrame, entries: str) -> DataFrame:
    return rows.selectExpr(f"inline({entries})").groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def rules_breakdown(decided: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """``(dimension, key, n)`` for priority, rule, category, sentiment and confidence, in one pass.

    Fallback rows have no valid context: they count under priority and rule only.
    """
    own = f"array({_entry('priority', 'final_priority')}), transform(triggered_rules, r -> {_entry('rule', 'r')})"
    context = ", ".join(_context_entries(limits.low_confidence))
    return _long_counts(
        decided, f"CASE WHEN is_fallback THEN concat({own}) ELSE concat({own}, array({context})) END"
    )


def rules_breakdown_stored(results: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    entries = [_entry("priority", "final_priority"), *_context_entries(limits.low_confidence)]
    return _long_counts(results, f"array({', '.join(entries)})")


def rule_frequency(decided: DataFrame) -> DataFrame:
    return decided.select(F.explode("triggered_rules").alias("rule_name")).groupBy("rule_name").agg(
        F.count(F.lit(1)).alias("n")
    )


def _response_columns(attempted: str, has_draft: str) -> dict[str, str]:
    internal = "response_status = 'HUMAN_REVIEW_DRAFT'"
    tries, wins = f"count_if({attempted})", f"count_if({attempted} AND {has_draft})"
    return {
        "n_processed": "count(1)",
        "automated_response_eligible_rate": _rate("response_status = 'DRAFT_GENERATED'"),
        "human_review_response_rate": _rate(internal),
        "blocked_response_rate": _rate("response_status = 'BLOCKED'"),
        "not_eligible_rate": _rate("response_status = 'NOT_ELIGIBLE'"),
        "draft_generation_attempted": tries,
        "draft_generation_succeeded": wins,
        "draft_generation_success_rate": fraction(wins, tries),
        "internal_draft_rate": fraction(f"count_if({internal} AND {has_draft})", f"count_if({internal})"),
    }


def _mentions(markers: list[str]) -> str:
    """Whether any rationale line holds one of the markers, ignoring case."""
    found = any_of(f"contains(lower(line), {q(m)})" for m in markers)
    return f"exists(rationale, line -> {found})"


def response_evaluation(decided: DataFrame, provenance: str = IN_MEMORY) -> DataFrame:
    """One row of response rates.

    A generation counts as attempted unless the row was not eligible or its
    rationale says it was skipped for lack of a generator; a human-review row
    whose internal draft is switched off carries no such mark and so counts.
    """
    rows = decided.selectExpr(
        "response_status",
        "is_fallback",
        "coalesce(response_draft, '') <> '' AS has_draft",
        f"response_status <> 'NOT_ELIGIBLE' AND NOT {_mentions(vocab.SKIPPED_MARKERS)} AS attempted",
        f"{_mentions(vocab.MISSING_CONTEXT_MARKERS)} AS missing_context",
    )
    extra = {"missing_context_rate": _rate("missing_context"), "fallback_rate": _rate("is_fallback")}
    return _one_row(rows, _response_columns("attempted", "has_draft") | extra, provenance)


def response_evaluation_stored(results: DataFrame) -> DataFrame:
    columns = _response_columns("response_status <> 'NOT_ELIGIBLE'", "has_draft")
    absent = dict.fromkeys(["missing_context_rate", "fallback_rate"], "CAST(NULL AS DOUBLE)")
    return _one_row(results, columns, FROM_DATABASE).withColumns({n: F.expr(e) for n, e in absent.items()})


def response_breakdown(rows: DataFrame) -> DataFrame:
    """``(dimension, key, n)`` by status and type."""
    entries = [
        _entry("response_status", "response_status"),
        _entry("response_type", or_label("nullif(response_type, '')", vocab.UNKNOWN_TYPE)),
    ]
    return _long_counts(rows, f"array({', '.join(entries)})")


def pair_counts(rows: DataFrame, truth: str = "ground_truth_category", predicted: str = "ai_predicted_category") -> DataFrame:
    """``(truth, predicted, n)``: the one pass over the data; all classifier metrics follow from it."""
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _labels(pairs: DataFrame, labels: list[str]) -> DataFrame:
    return pairs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "label_no int, label string")


def per_category(pairs: DataFrame, labels: list[str] = vocab.CATEGORIES) -> DataFrame:
    """Precision, recall, F1 and support for each label; 0 where undefined, unseen labels included."""
    entries = (
        "inline(array(named_struct('label', truth, 'support', n, 'called', 0L, 'hits', if(truth = predicted, n, 0L)), "
        "named_struct('label', predicted, 'support', 0L, 'called', n, 'hits', 0L)))"
    )
    sums = pairs.selectExpr(entries).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits")
    )
    rows = _labels(pairs, labels).join(sums, "label", "left").na.fill(0, ["support", "called", "hits"])
    return rows.selectExpr(
        "label_no",
        "label AS category",
        f"coalesce({fraction('hits', 'called')}, 0D) AS precision",
        f"coalesce({fraction('hits', 'support')}, 0D) AS recall",
        f"coalesce({fraction('hits * 2', '(called + support)')}, 0D) AS f1",
        "support",
    )


def classifier_evaluation(pairs: DataFrame, labels: list[str] = vocab.CATEGORIES) -> DataFrame:
    """One row: n, accuracy, macro F1 over all fixed labels. Fails on an empty set."""
    counted = pairs.selectExpr("coalesce(sum(n), 0L) AS n", "sum(if(truth = predicted, n, 0L)) AS hits")
    empty = "raise_error('Cannot compute metrics on an empty evaluation set')"
    return counted.withColumn("macro_f1", per_category(pairs, labels).agg(F.avg("f1")).scalar()).selectExpr(
        f"CASE WHEN n = 0 THEN CAST({empty} AS BIGINT) ELSE n END AS n_evaluated",
        f"{fraction('hits', 'n')} AS accuracy",
        "macro_f1",
    )


def confusion_matrix(pairs: DataFrame, labels: list[str] = vocab.CATEGORIES) -> DataFrame:
    """Every (truth, predicted) pair of the fixed labels with its count, zeros included."""
    names = F.array(*[F.lit(x) for x in labels])
    grid = (
        _labels(pairs, labels)
        .select(F.col("label_no").alias("truth_no"), F.col("label").alias("truth"), F.posexplode(names).alias("predicted_no", "predicted"))
    )
    return grid.join(pairs, ["truth", "predicted"], "left").select(
        "truth_no", "truth", "predicted_no", "predicted", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def confusion_table(pairs: DataFrame, labels: list[str] = vocab.CATEGORIES) -> DataFrame:
    """The confusion matrix as a table: one row per truth, one column per predicted label."""
    return confusion_matrix(pairs, labels).groupBy("truth_no", "truth").pivot("predicted", labels).agg(F.first("n"))


def classify_summary(validated: DataFrame) -> DataFrame:
    ok = F.col("success")
    return validated.agg(
        F.count(F.lit(1)).alias("tickets_attempted"),
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("input_tokens"))), F.lit(0).cast("bigint")).alias("total_input_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0).cast("bigint")).alias("total_output_tokens"),
    )


def failures_by_type(validated: DataFrame) -> DataFrame:
    """Failed calls per error code."""
    return validated.groupBy("error_type").agg(F.count("error_type").alias("n")).where("n > 0")


def token_cost(
    summary: DataFrame, input_price_per_million: Decimal | None = None, output_price_per_million: Decimal | None = None
) -> DataFrame:
    """Adds ``estimated_cost_usd``: NULL unless both prices are given and some call succeeded."""
    if not input_price_per_million or not output_price_per_million:
        return summary.withColumn("estimated_cost_usd", F.lit(None).cast("double"))
    money = lambda tokens, price: F.col(tokens).cast("decimal(18,0)") * F.lit(Decimal(price))
    total = money("total_input_tokens", input_price_per_million) + money("total_output_tokens", output_price_per_million)
    return summary.withColumn(
        "estimated_cost_usd", F.when(F.col("n_success") > 0, F.round(total * F.lit(Decimal("0.000001")), 4).cast("double"))
    )


def rules_summary(decided: DataFrame) -> DataFrame:
    path = F.col("decision_path")
    return decided.agg(
        F.count(F.lit(1)).alias("tickets_processed"),
        F.count_if(path == vocab.AUTOMATED).alias("n_automated"),
        F.count_if(path == vocab.HUMAN_REVIEW).alias("n_human_review"),
        F.count_if("is_fallback").alias("n_fallback"),
    )


def response_summary(decided: DataFrame) -> DataFrame:
    status = F.col("response_status")
    return decided.agg(
        F.count(F.lit(1)).alias("tickets_processed"),
        F.count_if(status == "DRAFT_GENERATED").alias("n_draft_generated"),
        F.count_if(status == "HUMAN_REVIEW_DRAFT").alias("n_human_review_draft"),
        F.count_if(status == "BLOCKED").alias("n_blocked"),
        F.count_if(status == "NOT_ELIGIBLE").alias("n_not_eligible"),
        F.count_if("is_fallback").alias("n_fallback"),
    )


def as_json(summary: DataFrame) -> DataFrame:
    """The run summary as one JSON text."""
    return summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("summary"))
