"""Registered queries: one callable ``(spark, directory) -> DataFrame`` per operator.

Results are flattened for comparison: decimals as doubles, counts as bigint,
arrays as joined text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom import vocab
from ticketloom.functions import labels, numeric
from ticketloom.operators import bitmaps, classification, evaluation, kpis, maintained, measures, quality, responses, routing, selfcheck, sketches, views
from ticketloom.operators.joins import owner_gate, product_names, quarantine_reasons, split_by_owner
from ticketloom.operators.scanning import scan_codes, scan_texts
from ticketloom.plans.testmodel import BROKEN_CONTEXTS, CLASSIFIER_OUTPUTS, DRAFT_TEXT, BROKEN_ANSWERS, GENERATIONS, REPEATED_KEYS, Model, derive, replace
from ticketloom.plans import runs
from ticketloom.session import shared_folder
from ticketloom.sources import audit, picks, scoring, snapshots, store, tables
from ticketloom.streaming.intake import ledger, start_intake
from ticketloom.streaming.route import start_routing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def flat(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, " | ")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(build: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    """Registers the function under its own name."""
    QUERIES[build.__name__] = lambda spark, directory: flat(build(Model(spark, directory)))
    return build


def rules_context(m: Model) -> DataFrame:
    return picks.rules_context(m.tickets, m.customers, m.orders)


def fact(m: Model, orders: bool = False) -> DataFrame:
    return views.ticket_fact(m.stored_tickets(), m.customers, m.orders if orders else None)


def later_empty(tickets: DataFrame) -> DataFrame:
    """Tickets that no later stage has handled."""
    empty = {
        c: F.lit(None).cast(t)
        for c, t in {
            "final_priority": "string", "rule_decision_at": "timestamp_ntz", "response_status": "string",
            "response_type": "string", "response_draft": "string", "response_generated_at": "timestamp_ntz",
        }.items()
    }
    return tickets.withColumns(empty)


def early_fact(m: Model, orders: bool = False) -> DataFrame:
    """Fact over tickets before routing; for queries that read no decision."""
    return views.ticket_fact(later_empty(m.tickets), m.customers, m.orders if orders else None)


def generations(m: Model) -> DataFrame:
    return derive(m.tickets, GENERATIONS)


def classified(m: Model) -> DataFrame:
    return classification.validate_classifications(derive(m.tickets, CLASSIFIER_OUTPUTS))


def broken_contexts(m: Model) -> DataFrame:
    return derive(rules_context(m), BROKEN_CONTEXTS)


def pairs(m: Model) -> DataFrame:
    return evaluation.pair_counts(picks.evaluation_rows(m.tickets))


# --- routing --------------------------------------------------------------------------


@query
def route_summary(m: Model) -> DataFrame:
    decided = routing.route_tickets(rules_context(m))
    return decided.groupBy("decision_path", "final_priority").agg(F.count(F.lit(1)).alias("tickets"))


@query
def route_decisions(m: Model) -> DataFrame:
    return routing.route_tickets(rules_context(m)).select("ticket_id", *routing.DECISION_COLUMNS)


@query
def route_rule_outcomes(m: Model) -> DataFrame:
    return routing.rule_outcomes(rules_context(m))


@query
def route_rule_frequency(m: Model) -> DataFrame:
    return evaluation.rule_frequency(routing.route_tickets(rules_context(m)))


@query
def route_breakdown(m: Model) -> DataFrame:
    return evaluation.rules_breakdown(routing.route_tickets(broken_contexts(m)))


@query
def route_fallback(m: Model) -> DataFrame:
    decided = routing.route_tickets(broken_contexts(m))
    return decided.select(
        F.coalesce("ticket_id", F.lit(-1)).alias("ticket_id"), "final_priority", "decision_path", "recommended_action",
        "triggered_rules", "conflicting_signals", "is_fallback", F.size("validation_errors").alias("n_errors"),
    )


@query
def rules_eval(m: Model) -> DataFrame:
    return evaluation.rules_evaluation(routing.route_tickets(broken_contexts(m)))


@query
def rules_eval_stored(m: Model) -> DataFrame:
    return evaluation.rules_evaluation_stored(picks.routing_results(m.decided_tickets()))


@query
def rules_breakdown_stored(m: Model) -> DataFrame:
    return evaluation.rules_breakdown_stored(picks.routing_results(m.decided_tickets()))


@query
def rules_batch_summary(m: Model) -> DataFrame:
    return evaluation.rules_summary(routing.route_tickets(broken_contexts(m)))


# --- picks ------------------------------------------------------------------------------


@query
def pick_unclassified(m: Model) -> DataFrame:
    return picks.unclassified(m.tickets)


@query
def pick_unclassified_first(m: Model) -> DataFrame:
    return picks.unclassified(m.tickets, limit=10)


@query
def context_for_rules(m: Model) -> DataFrame:
    return rules_context(m)


@query
def context_for_rules_first(m: Model) -> DataFrame:
    return picks.rules_context(m.decided_tickets(), m.customers, m.orders, limit=10)


@query
def context_for_response(m: Model) -> DataFrame:
    return picks.response_context(m.stored_tickets(), m.customers, m.orders, m.order_items, m.products)


@query
def context_for_response_first(m: Model) -> DataFrame:
    return picks.response_context(m.stored_tickets(), m.customers, m.orders, m.order_items, m.products, limit=10)


@query
def evaluation_scan(m: Model) -> DataFrame:
    return picks.evaluation_rows(m.tickets)


@query
def routing_results_scan(m: Model) -> DataFrame:
    return picks.routing_results(m.decided_tickets())


@query
def response_results_scan(m: Model) -> DataFrame:
    return picks.response_results(m.stored_tickets())


@query
def order_product_names(m: Model) -> DataFrame:
    return product_names(m.order_items, m.products)


# --- safety and responses -----------------------------------------------------------------


def planted_documents(m: Model) -> DataFrame:
    """Whole documents with one draft sentence in the middle of some and at the end of others."""
    draft = F.expr(DRAFT_TEXT.replace("ticket_id", "doc_id"))
    return m.raw("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text"), F.lit("\n"), draft))
        .otherwise(F.concat(draft, F.lit("\n"), F.col("text")))
        .alias("text"),
    )


@query
def safety_scan(m: Model) -> DataFrame:
    return scan_texts(planted_documents(m), "text", ["doc_id"])


@query
def safety_by_code(m: Model) -> DataFrame:
    return scan_codes(planted_documents(m), "text").groupBy("code").agg(F.count(F.lit(1)).alias("documents"))


@query
def response_eligibility(m: Model) -> DataFrame:
    return responses.with_eligibility(m.decided_tickets()).select(
        "ticket_id", "response_type", "eligibility", "eligibility_reasons", "needs_generation"
    )


@query
def response_recheck(m: Model) -> DataFrame:
    """Every stored decision claimed to be Automated, so that the second check decides."""
    claimed = m.decided_tickets().withColumn("decision_path", F.lit("Automated"))
    return responses.with_eligibility(claimed).select("ticket_id", "eligibility", "eligibility_reasons")


def response_columns(decided: DataFrame) -> DataFrame:
    return decided.select(
        "ticket_id", "response_status", "response_type", "response_draft", "customer_facing", "requires_human_review",
        "rationale", "is_fallback",
    )


@query
def response_decisions(m: Model) -> DataFrame:
    context = picks.response_context(m.decided_tickets().withColumn("response_status", F.lit(None).cast("string")),
                                     m.customers, m.orders, m.order_items, m.products)
    return response_columns(responses.decide_responses(context, generations(m)))


@query
def response_decisions_no_generator(m: Model) -> DataFrame:
    return response_columns(responses.decide_responses(m.decided_tickets()))


@query
def response_fallback(m: Model) -> DataFrame:
    """Responses to contexts of which some are broken."""
    decided = responses.decide_responses(replace(m.decided_tickets(), BROKEN_ANSWERS))
    return decided.select(
        F.coalesce("ticket_id", F.lit(-1)).alias("ticket_id"), "response_status", "is_fallback", "customer_facing", "requires_human_review",
        F.size("validation_errors").alias("n_errors"), F.when(F.col("is_fallback"), F.array_join("rationale", " | ")).alias("reason"),
    )


@query
def responses_run_updates(m: Model) -> DataFrame:
    """The rows that a whole response run without a generator writes back."""
    run_at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    pending = m.decided_tickets().withColumn("response_status", F.lit(None).cast("string"))
    return runs.run_responses(pending, m.customers, m.orders, m.order_items, m.products, run_at=run_at).updates


def _by_length() -> Callable[[], scoring.Scorer]:
    """A scorer that classifies by the length of the prompt, and fails on some lengths."""

    def make() -> scoring.Scorer:
        import json

        names = ["Complaint", "Other", "Spam"]

        def score(prompts):
            for p in prompts:
                n = len(p)
                answer = {"category": names[n % 3], "priority": "Low", "sentiment_score": (n % 5 - 2) / 4, "confidence": n % 4 / 4}
                yield {"error_type": "timeout"} if n % 7 == 0 else {"tool_input_json": json.dumps(answer), "input_tokens": n, "output_tokens": 9}

        return score

    return make


@query
def classify_run(m: Model) -> DataFrame:
    """A whole classification run of the pending tickets: its update rows, and its failures by type."""
    run_at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    run = runs.run_classify(m.tickets, run_at=run_at, make_scorer=_by_length(), scratch=shared_folder(m.spark, "classify-run"))
    failed = run.evaluation.select(
        F.lit(None).cast("bigint").alias("ticket_id"), F.col("error_type").alias("result"), F.col("n").cast("double").alias("number")
    )
    return run.updates.select("ticket_id", F.col("ai_predicted_category").alias("result"), F.col("sentiment_score").cast("double").alias("number")).unionByName(failed)


@query
def run_summary_json(m: Model) -> DataFrame:
    """Fields of a routing run's summary, read back from its JSON text."""
    summary = evaluation.rules_summary(routing.route_tickets(broken_contexts(m)))
    text = evaluation.as_json(summary)
    return text.selectExpr(*[f"CAST(get_json_object(summary, '$.{c}') AS {t}) AS {c}" for c, t in summary.dtypes])


@query
def view_export(m: Model) -> DataFrame:
    """The fact view written as CSV and read back with its types."""
    whole = fact(m, orders=True)
    folder = shared_folder(m.spark, "view-export")
    views.write_csv(whole, folder)
    back = views.read_csv(m.spark, folder, whole.schema)
    return back.select("ticket_id", "channel", "decision_path", "resolution_hours", "order_total_amount", "resolved_at", "delivery_delay_days", "recommended_action")


@query
def response_decisions_no_internal(m: Model) -> DataFrame:
    return response_columns(responses.decide_responses(m.decided_tickets(), generations(m), generate_internal_drafts=False))


@query
def response_invariants(m: Model) -> DataFrame:
    """Sound decisions break none; the planted ones all show."""
    broken = m.broken_stored_tickets().where(F.col("response_status").isNotNull()).withColumns(
        {"customer_facing": F.col("ticket_id") % 5 == 0, "requires_human_review": F.col("ticket_id") % 5 != 0}
    )
    return responses.response_violations(broken)


@query
def response_eval(m: Model) -> DataFrame:
    return evaluation.response_evaluation(m.responded())


@query
def response_eval_no_generator(m: Model) -> DataFrame:
    return evaluation.response_evaluation(responses.decide_responses(m.decided_tickets()))


@query
def response_eval_stored(m: Model) -> DataFrame:
    return evaluation.response_evaluation_stored(picks.response_results(m.stored_tickets()))


@query
def response_breakdown(m: Model) -> DataFrame:
    return evaluation.response_breakdown(picks.response_results(m.stored_tickets()))


@query
def response_batch_summary(m: Model) -> DataFrame:
    return evaluation.response_summary(m.responded())


@query
def response_flags(m: Model) -> DataFrame:
    return m.stored_tickets().select(
        "ticket_id",
        "response_status",
        F.expr(labels.customer_facing("response_status")).alias("customer_facing"),
        F.expr(labels.requires_human_review("response_status")).alias("requires_human_review"),
    )


@query
def response_prompts(m: Model) -> DataFrame:
    context = picks.response_context(m.stored_tickets(), m.customers, m.orders, m.order_items, m.products)
    eligible = responses.with_eligibility(context).where("needs_generation")
    return responses.prompt_context(eligible).select("ticket_id", F.expr(responses.response_prompt()).alias("prompt"))


# --- classification -------------------------------------------------------------------------


@query
def classification_prompts(m: Model) -> DataFrame:
    """Prompts over all turns of the conversations."""
    turns = m.raw("conversations")
    return turns.select("conv_id", "turn", F.expr(classification.classification_prompt("text")).alias("prompt"))


@query
def ticket_prompts(m: Model) -> DataFrame:
    """Prompts of the unclassified tickets."""
    pending = picks.unclassified(m.tickets)
    return pending.select("ticket_id", F.expr(classification.classification_prompt("message_text")).alias("prompt"))


@query
def model_calls(m: Model) -> DataFrame:
    """The model-call stage with a scorer that counts characters and fails on every fifth length."""

    def make_scorer():
        def score(prompts):
            return [
                {"input_tokens": len(p), "model": "length", "error_type": None if len(p) % 5 else "rate_limit"} for p in prompts
            ]

        return score

    scored = scoring.score_batches(ticket_prompts(m), make_scorer)
    return scored.select("ticket_id", "error_type", "input_tokens", "model")


@query
def classification_validation(m: Model) -> DataFrame:
    return classified(m).select(
        "ticket_id", "success", "error_type", "category", "priority", "sentiment_score", "confidence", "order_id",
        "mentions_customer_info",
    )


@query
def classification_repeated_keys(m: Model) -> DataFrame:
    checked = classification.validate_classifications(derive(m.tickets, REPEATED_KEYS))
    return checked.select("ticket_id", "success", "error_type", "category", "priority", "sentiment_score", "confidence", "order_id", "mentions_customer_info")


@query
def classify_batch_summary(m: Model) -> DataFrame:
    return evaluation.classify_summary(classified(m))


@query
def failures_by_type(m: Model) -> DataFrame:
    return evaluation.failures_by_type(classified(m))


@query
def token_cost(m: Model) -> DataFrame:
    return evaluation.token_cost(evaluation.classify_summary(classified(m)), Decimal("0.15"), Decimal("0.60"))


@query
def classifier_eval(m: Model) -> DataFrame:
    one = evaluation.classifier_evaluation(pairs(m))
    return one.select("n_evaluated", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query
def classifier_per_category(m: Model) -> DataFrame:
    rows = evaluation.per_category(pairs(m))
    return rows.select("category", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def confusion_matrix(m: Model) -> DataFrame:
    return evaluation.confusion_matrix(pairs(m))


@query
def confusion_labels(m: Model) -> DataFrame:
    """The same matrix over the labelled documents: quality as truth, toxicity as prediction."""
    rows = m.raw("labels").select(F.col("quality").cast("string").alias("t"), F.col("toxic").cast("string").alias("p"))
    return evaluation.confusion_matrix(evaluation.pair_counts(rows, "t", "p"), ["0", "1"])


# --- views ------------------------------------------------------------------------------------


@query
def ticket_fact(m: Model) -> DataFrame:
    return fact(m, orders=True)


@query
def classification_metrics(m: Model) -> DataFrame:
    return views.classification_metrics(m.tickets)


@query
def rule_decision_metrics(m: Model) -> DataFrame:
    return views.rule_decision_metrics(m.decided_tickets())


@query
def response_metrics(m: Model) -> DataFrame:
    return views.response_metrics(m.stored_tickets())


@query
def operational_metrics(m: Model) -> DataFrame:
    return views.operational_metrics(m.stored_tickets())


@query
def all_metrics_summary(m: Model) -> DataFrame:
    return selfcheck.summarize(views.all_metrics(m.stored_tickets()))


@query
def backlog(m: Model) -> DataFrame:
    return views.backlog(m.tickets)


@query
def stage_counters(m: Model) -> DataFrame:
    return views.stage_counters(m.stored_tickets())


@query
def delivery_delay(m: Model) -> DataFrame:
    delay = F.datediff("actual_delivery_date", "expected_delivery_date")
    return m.orders.groupBy(delay.alias("delivery_delay_days")).agg(F.count(F.lit(1)).alias("orders"))


@query
def duration_columns(m: Model) -> DataFrame:
    spans = [
        ("first_response_minutes", "first_response_at", numeric.MICROS_PER_MINUTE),
        ("resolution_hours", "resolved_at", numeric.MICROS_PER_HOUR),
        ("decision_hours", "decision_at", numeric.MICROS_PER_HOUR),
        ("rule_decision_hours", "rule_decision_at", numeric.MICROS_PER_HOUR),
        ("response_generation_hours", "response_generated_at", numeric.MICROS_PER_HOUR),
    ]
    return m.stored_tickets().select(
        "ticket_id",
        *[F.expr(numeric.duration(numeric.micros_between("created_at", end), unit)).alias(n) for n, end, unit in spans],
    )


# --- measures and charts ------------------------------------------------------------------------


@query
def measures_overall(m: Model) -> DataFrame:
    return measures.texts(measures.measures(fact(m)))


@query
def measures_by_channel(m: Model) -> DataFrame:
    return measures.texts(measures.measures(fact(m), ["channel"]))


@query
def measures_small_slices(m: Model) -> DataFrame:
    """Slices so small that the coverage warning shows on most of them."""
    sliced = measures.texts(measures.measures(measures.created_date(fact(m)), ["created_date", "channel", "customer_segment"]))
    return sliced.select("created_date", "channel", "customer_segment", "total_tickets", "classified_tickets", "exact_category_match_label", "ai_coverage_warning")


@query
def metrics_of_undecided(m: Model) -> DataFrame:
    """Tickets that no rule has decided: their rule metrics are not available, the others are."""
    return selfcheck.summarize(views.all_metrics(m.stored_tickets().where("decision_path IS NULL")))


@query
def measures_path_override(m: Model) -> DataFrame:
    """Slices by path and priority: pinned counts ignore the columns they pin."""
    return measures.measures(fact(m), ["channel", "decision_path", "final_priority"], empty="zero")


@query
def measures_grouping_sets(m: Model) -> DataFrame:
    dated = measures.created_date(fact(m))
    return measures.measures_for_sets(dated, [["created_date", "channel"], ["created_date"], ["channel"], []])


@query
def measures_sliced(m: Model) -> DataFrame:
    part = measures.slicer(fact(m), "2024-01-05", "2024-01-20", ["Email", "Chat", "Phone"])
    return measures.measures(part, ["channel"])


@query
def medians_by_channel(m: Model) -> DataFrame:
    return measures.median_measures(early_fact(m), ["channel"])


@query
def medians_by_customer_segment_and_country(m: Model) -> DataFrame:
    return measures.median_measures(early_fact(m), ["customer_segment", "country"])


@query
def medians_grouping_sets(m: Model) -> DataFrame:
    dated = measures.created_date(early_fact(m))
    return measures.median_measures_for_sets(dated, [["created_date", "channel"], ["channel"], []])


def _chart(name: str, column: str, keep_blank: bool = True) -> None:
    QUERIES[name] = lambda spark, directory: flat(measures.chart(fact(Model(spark, directory)), column, keep_blank))


_chart("chart_decision_path", "decision_path")
_chart("chart_original_priority", "original_priority")
_chart("chart_predicted_category", "ai_predicted_category", keep_blank=False)
_chart("chart_final_priority", "final_priority")
_chart("chart_response_status", "response_status", keep_blank=False)
_chart("chart_resolution_type", "resolution_type")


@query
def date_dimension(m: Model) -> DataFrame:
    return measures.date_dimension(m.tickets)


@query
def date_range(m: Model) -> DataFrame:
    return measures.date_range(m.tickets)


def _rank_of(fact: DataFrame, found: DataFrame) -> DataFrame:
    """Per channel: whether the share of values below each approximate median is one half, but for three times the stated error."""
    bound = 3 * sketches.rank_error()
    names = {name: column for name, column in measures.MEDIANS}
    joined = fact.join(found.withColumnRenamed("channel", "_channel"), F.col("channel") == F.col("_channel"))
    checks = []
    for name, column in names.items():
        value, n = F.round(F.col(column) * 100).cast("bigint"), F.count(column)
        own = F.round(F.col(name) * 100).cast("bigint")
        below, upto = F.count_if(value < own) / n, F.count_if(value <= own) / n
        checks.append(((below <= 0.5 + bound) & (upto >= 0.5 - bound)).alias(f"{name}_within"))
    return joined.groupBy("channel").agg(F.max("total_tickets").alias("total_tickets"), *checks)


@query
def medians_from_sketches(m: Model) -> DataFrame:
    """Medians of 14 days by channel from stored sketches of all days; their ranks are held against the tickets."""
    whole = early_fact(m)
    folder = shared_folder(m.spark, "daily-sketches")
    sketches.daily_sketches(whole).write.parquet(folder)
    days = m.spark.read.parquet(folder).where("created_date BETWEEN DATE'2024-01-05' AND DATE'2024-01-18'")
    return _rank_of(measures.slicer(whole, "2024-01-05", "2024-01-18"), sketches.median_measures(days, ["channel"]))


@query
def daily_volume(m: Model) -> DataFrame:
    return measures.daily_volume(m.tickets)


# --- quality ---------------------------------------------------------------------------------------


@query
def dq_row_counts(m: Model) -> DataFrame:
    return tables.row_counts(m.tables)


@query
def dq_pk(m: Model) -> DataFrame:
    return quality.primary_keys(m.broken_tables)


@query
def dq_fk_orphans(m: Model) -> DataFrame:
    return quality.foreign_keys(m.broken_tables)


@query
def dq_required_nulls(m: Model) -> DataFrame:
    return quality.required_nulls(m.broken_tables)


@query
def dq_duplicates(m: Model) -> DataFrame:
    return quality.duplicate_values(m.broken_tables)


@query
def dq_order_totals(m: Model) -> DataFrame:
    return quality.order_totals(m.tables)


@query
def dq_order_totals_mostly_sound(m: Model) -> DataFrame:
    return quality.order_totals(m.adding_up)


@query
def dq_orders_without_items(m: Model) -> DataFrame:
    return quality.orders_without_items(m.tables)


@query
def dq_line_totals(m: Model) -> DataFrame:
    return quality.line_totals(m.tables)


@query
def dq_owner_mismatch(m: Model) -> DataFrame:
    return quality.owner_mismatch(m.broken_tables)


@query
def dq_timestamps(m: Model) -> DataFrame:
    return quality.run_row_checks(m.broken_tables, quality.timestamp_checks())


@query
def dq_vocabulary(m: Model) -> DataFrame:
    return quality.run_row_checks(m.broken_tables, quality.vocabulary_checks())


@query
def dq_tickets_without_order(m: Model) -> DataFrame:
    return quality.tickets_without_order(m.tickets)


@query
def dq_routing(m: Model) -> DataFrame:
    return quality.routing_suite(m.broken_stored_tickets())


@query
def dq_response(m: Model) -> DataFrame:
    return quality.response_suite(m.broken_stored_tickets())


@query
def dq_stored_distributions(m: Model) -> DataFrame:
    return quality.stored_distributions(m.stored_tickets())


@query
def dq_view_grain(m: Model) -> DataFrame:
    """Repeated ids, and tickets lost with their customer."""
    broken = m.broken_tables["tickets"]
    return quality.view_grain(broken.join(m.customers.select("customer_id"), "customer_id"), broken)


@query
def dq_fact_grain(m: Model) -> DataFrame:
    """The fact view itself, over tickets of which some ids repeat and some customers are not there."""
    broken = m.broken_tables["tickets"]
    return bitmaps.fact_grain(views.ticket_fact(later_empty(broken), m.customers), broken)


@query
def distinct_customers_from_bitmaps(m: Model) -> DataFrame:
    """Customers per channel in a slice of days, from stored bitmaps of every day."""
    folder = shared_folder(m.spark, "daily-bitmaps")
    bitmaps.bitmaps(measures.created_date(m.tickets), "customer_id", ["created_date", "channel"]).write.parquet(folder)
    days = m.spark.read.parquet(folder).where("created_date BETWEEN DATE'2024-01-05' AND DATE'2024-01-18'")
    return bitmaps.distinct_counts(bitmaps.merged(days, ["channel"]), ["channel"]).select("channel", F.col("rows").alias("tickets"), F.col("keys").alias("customers"))


@query
def dq_fact_rows(m: Model) -> DataFrame:
    broken = views.ticket_fact(m.broken_stored_tickets(), m.customers, m.orders)
    return quality.row_checks(broken, "ticket_id", quality.fact_checks())


@query
def dq_metric_consistency(m: Model) -> DataFrame:
    return quality.metric_consistency(views.all_metrics(m.broken_stored_tickets()))


@query
def dq_metric_selfcheck(m: Model) -> DataFrame:
    stored = m.stored_tickets()
    return selfcheck.check_metrics(views.all_metrics(stored), selfcheck.fact_summary(fact(m, orders=True)))


@query
def dq_metric_selfcheck_broken(m: Model) -> DataFrame:
    """Metrics of one state checked against the fact of another: the differences show."""
    summary = selfcheck.fact_summary(early_fact(m, orders=True).where(F.col("channel") != "Phone"))
    return selfcheck.check_metrics(views.all_metrics(m.broken_stored_tickets()), summary)


@query
def dq_analytics(m: Model) -> DataFrame:
    """The analytics suite over broken tickets: grain of the fact view, its rows, and the metrics."""
    return quality.run_checks(m.tables | {"tickets": m.broken_stored_tickets()}, "analytics")


@query
def dq_checks_fire(m: Model) -> DataFrame:
    """``(planted, fired)``: every check on a row of metrics that breaks it, all of them on the sound row."""
    stored = m.stored_tickets()
    return selfcheck.planted_errors(views.all_metrics(stored), selfcheck.fact_summary(fact(m, orders=True)))


@query
def load_counts(m: Model) -> DataFrame:
    """Rows and broken constraints of the broken tables, counted by the writes that stage them."""
    broken = m.broken_tables
    checks = {t: quality.constraint_checks(t, df.columns) for t, df in broken.items()}
    staged = snapshots.stage_checked(broken, shared_folder(m.spark, "load"), "loaded", checks)
    rows = [(table, name, n) for table, counts in staged.counts.items() for name, n in counts.items() if n]
    return m.spark.createDataFrame(rows, "table_name string, counted string, n bigint")


@query
def load_gated(m: Model) -> DataFrame:
    """Tickets loaded behind the owner gate: what was loaded, and what went to the quarantine, by channel."""
    tables = {"orders": m.orders, "tickets": m.broken_tables["tickets"]}
    loaded = snapshots.load_checked(m.spark, tables, shared_folder(m.spark, "load"), "gated", {}, gate=True).tables
    accepted = loaded["tickets"].groupBy("channel").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("accepted"))
    stopped = loaded["tickets_quarantine"].groupBy("channel", "reason").agg(F.count(F.lit(1)).alias("n"))
    return accepted.unionByName(stopped)


@query
def dq_key_constraints(m: Model) -> DataFrame:
    return quality.key_constraints(m.broken_tables)


@query
def dq_constraints(m: Model) -> DataFrame:
    return quality.constraints_suite(m.broken_tables)


@query
def dq_stored_constraints(m: Model) -> DataFrame:
    return quality.constraints_suite({"tickets": m.broken_stored_tickets()})


@query
def dq_suite(m: Model) -> DataFrame:
    found = quality.run_checks(m.broken_tables, "tables", stage=shared_folder(m.spark, "dq-suite"))
    return found.groupBy("check_name").agg(F.count(F.lit(1)).alias("violations"))


@query
def dq_suite_rows(m: Model) -> DataFrame:
    """Every violation of the tables suite."""
    return quality.run_checks(m.broken_tables, "tables", stage=shared_folder(m.spark, "dq-suite"))


@query
def orders_per_customer(m: Model) -> DataFrame:
    return quality.orders_per_customer(m.customers, m.orders)


@query
def top_products(m: Model) -> DataFrame:
    return quality.top_products(m.order_items, m.products)


@query
def category_ranking(m: Model) -> DataFrame:
    """Categories in the order in which they are shown: by count, and by name."""
    places = [quality.placed(quality.distribution(m.tickets, "category", "(none)"), order) for order in ("count", "label")]
    return places[0].select(F.lit("count").alias("ordered_by"), "*").unionByName(places[1].select(F.lit("label").alias("ordered_by"), "*"))


@query
def category_distribution(m: Model) -> DataFrame:
    return quality.distribution(m.tickets, "category", "(none)")


# --- write-back, gate, audit, stream -------------------------------------------------------------------


@query
def overlay_predictions(m: Model) -> DataFrame:
    run_at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    updates = classification.classification_updates(classified(m), run_at)
    done = snapshots.apply_overlay(m.tickets, updates, ["ai_predicted_category", "classification_confidence", "sentiment_score", "decision_at"], run_at)
    return done.select("ticket_id", "category", "ai_predicted_category", "classification_confidence", "sentiment_score", "decision_at", "updated_at")


@query
def overlay_decisions(m: Model) -> DataFrame:
    run_at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    updates = routing.decision_updates(routing.route_tickets(broken_contexts(m)), run_at)
    target = m.tickets.withColumns({"final_priority": F.lit(None).cast("string"), "rule_decision_at": F.lit(None).cast("timestamp_ntz")})
    done = snapshots.apply_overlay(target, updates, ["final_priority", "decision_path", "rule_decision_at"], run_at)
    return done.select("ticket_id", "priority", "final_priority", "decision_path", "rule_decision_at", "updated_at")


@query
def overlay_responses(m: Model) -> DataFrame:
    run_at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    stored = m.decided_tickets()
    updates = responses.response_updates(responses.decide_responses(stored, generations(m)), run_at)
    owned = ["response_status", "response_type", "response_draft", "response_generated_at"]
    target = stored.withColumns({c: F.lit(None).cast("timestamp_ntz" if c.endswith("_at") else "string") for c in owned})
    return snapshots.apply_overlay(target, updates, owned, run_at).select("ticket_id", "decision_path", *owned, "updated_at")


def _written_back(m: Model) -> tuple[DataFrame, store.WriteBack]:
    """The tickets as a table in 64 id ranges, with some decisions written back behind the owner gate."""
    root = shared_folder(m.spark, "ticket-store")
    top = m.raw("events").agg(F.max("event_id")).first()[0]
    store.create(m.gated_tickets, root, "loaded", ids_per_part=max(100, top // 64))
    run_at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    done = store.write_back(m.spark, root, m.updates, vocab.ROUTING_COLUMNS, run_at, "decided", m.orders)
    return store.read(m.spark, root), done


@query
def write_back_tickets(m: Model) -> DataFrame:
    return _written_back(m)[0].select("ticket_id", "customer_id", "priority", *vocab.ROUTING_COLUMNS, "updated_at")


@query
def write_back_rejects(m: Model) -> DataFrame:
    return _written_back(m)[1].rejected.select("ticket_id", "reason")


@query
def maintained_metrics(m: Model) -> DataFrame:
    """The metric summary after three write-backs, from the first state and the rows that each of them changed."""
    root = shared_folder(m.spark, "ticket-store")
    top = m.raw("events").agg(F.max("event_id")).first()[0]
    store.create(m.gated_tickets, root, "loaded", ids_per_part=max(100, top // 64))
    tickets = store.read(m.spark, root)
    state = maintained.save(maintained.state_of(tickets), f"{root}/metrics/0")
    run_at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    rounds = [(m.updates, vocab.ROUTING_COLUMNS, m.orders), (m.predictions, vocab.CLASSIFIER_COLUMNS, None), (m.answers, vocab.RESPONSE_COLUMNS, None)]
    for i, (updates, owned, orders) in enumerate(rounds, 1):
        done = store.write_back(m.spark, root, updates, owned, run_at, f"round {i}", orders)
        changed = store.changes(m.spark, root, done, maintained.needed(tickets.columns))
        state = maintained.merged(state, maintained.state_of(changed))
    return selfcheck.summarize(maintained.metrics(maintained.save(state, f"{root}/metrics/{len(rounds)}")))


@query
def write_gate_reasons(m: Model) -> DataFrame:
    tickets = m.broken_tables["tickets"].select("ticket_id", "order_id", "customer_id")
    return quarantine_reasons(split_by_owner(tickets, m.broken_tables["orders"]).quarantine, m.broken_tables["orders"])


@query
def write_gate(m: Model) -> DataFrame:
    gated = owner_gate(m.broken_tables["tickets"], m.orders)
    return gated.select("ticket_id", "order_id", "customer_id", "accepted")


@query
def write_gate_rejects(m: Model) -> DataFrame:
    gated = owner_gate(m.broken_tables["tickets"], m.orders)
    return gated.where(~F.col("accepted")).groupBy("channel").agg(F.count(F.lit(1)).alias("rejected"))


@query
def rules_run_updates(m: Model) -> DataFrame:
    """The rows that a whole routing run writes back."""
    run_at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    return runs.run_rules(m.tickets, m.customers, m.orders, run_at=run_at).updates


@query
def redacted_turns(m: Model) -> DataFrame:
    """Conversation texts with two planted secrets taken out."""
    text = audit.redact(F.concat(F.lit("key sk-1 "), F.col("text"), F.lit(" pass.*word")), ["sk-1", "pass.*word"])
    return m.raw("conversations").select("conv_id", "turn", text.alias("text"))


@query
def audit_routing(m: Model) -> DataFrame:
    return audit.routing_events(routing.route_tickets(broken_contexts(m)), dry_run=True).drop("reasons")


@query
def audit_responses(m: Model) -> DataFrame:
    return audit.response_events(m.responded(), dry_run=True)


@query
def audit_classification(m: Model) -> DataFrame:
    return audit.classification_events(classified(m), dry_run=True).drop("latency_ms", "error_message")


@query
def stream_route(m: Model) -> DataFrame:
    """The tickets routed as a stream; equals the batch result."""
    schema = m.raw("events").schema
    events = m.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(m.directory)
    folder = shared_folder(m.spark, "stream-route")
    start_routing(m.tickets_from(events), m.customers, m.orders, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return m.spark.read.parquet(f"{folder}/out")


def _arrivals(m: Model) -> DataFrame:
    """What arrives in which batch: all tickets by week, some of them again in the next week, some three weeks late."""
    sent = m.gated_tickets.withColumn("sent_at", F.col("created_at"))
    week = F.least(F.floor((F.day("created_at") - 1) / 8), F.lit(3)).cast("int")
    late = (week == 0) & (F.col("ticket_id") % 70 == 1)
    first = sent.withColumn("batch", F.when(late, 3).otherwise(week))
    again = sent.where(~late & (week < 3) & (F.col("ticket_id") % 50 == 0)).withColumn("batch", week + 1)
    return first.unionByName(again)


@query
def stream_intake(m: Model) -> DataFrame:
    """Four batches with repeats and late tickets, decided and written back; what became of each ticket that was sent."""
    folder = shared_folder(m.spark, "stream-intake")
    store.create(m.gated_tickets, f"{folder}/table", "loaded", ids_per_part=max(100, m.raw("events").agg(F.max("event_id")).first()[0] // 64))
    arrivals = _arrivals(m)
    schema = arrivals.drop("batch").schema
    for batch in range(4):
        arrivals.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{folder}/sent")
        start_intake(
            m.spark.readStream.schema(schema).parquet(f"{folder}/sent"), m.customers, m.orders, f"{folder}/intake", f"{folder}/checkpoint",
            delay="2 DAY", table=f"{folder}/table", run_at=datetime(2024, 6, 1, 12),
        ).awaitTermination()
    late = m.spark.read.schema(schema).parquet(f"{folder}/intake/late/*").selectExpr("ticket_id", "'late' AS outcome", "CAST(NULL AS STRING) AS decision_path")
    stored = store.read(m.spark, f"{folder}/table").where("decision_path IS NOT NULL").selectExpr("ticket_id", "'written' AS outcome", "decision_path")
    counts = ledger(m.spark, f"{folder}/intake").selectExpr("batch_id AS ticket_id", "inline(array(named_struct('outcome', concat_ws(' ', 'batch', arrived, late, repeated, decided), 'decision_path', CAST(NULL AS STRING))))")
    return late.unionByName(stored).unionByName(counts)


# --- KPIs ------------------------------------------------------------------------------------------------


@query
def kpi_volume(m: Model) -> DataFrame:
    return kpis.volume(early_fact(m))


@query
def kpi_accuracy(m: Model) -> DataFrame:
    return kpis.labelled_accuracy(early_fact(m))


@query
def kpi_path_rates(m: Model) -> DataFrame:
    return kpis.path_rates(fact(m), ["channel"])


@query
def kpi_processing_time(m: Model) -> DataFrame:
    return kpis.processing_time(early_fact(m))


@query
def kpi_resolution_by_type(m: Model) -> DataFrame:
    return kpis.resolution_by_type(early_fact(m))


@query
def kpi_sentiment(m: Model) -> DataFrame:
    return kpis.sentiment(early_fact(m))


@query
def kpi_cost_savings(m: Model) -> DataFrame:
    return kpis.cost_savings(fact(m), Decimal("4.25"))


@query
def kpi_service_quality(m: Model) -> DataFrame:
    return kpis.service_quality(fact(m), sla_hours=24)


@query
def kpi_order_value_percentiles(m: Model) -> DataFrame:
    return kpis.order_value_percentiles(m.orders)


@query
def kpi_confidence_calibration(m: Model) -> DataFrame:
    return kpis.confidence_calibration(early_fact(m))


@query
def kpi_path_by_priority(m: Model) -> DataFrame:
    return kpis.cross_count(fact(m), "decision_path", "final_priority")


@query
def kpi_action_counts(m: Model) -> DataFrame:
    return kpis.cross_count(fact(m), "recommended_action")


@query
def kpi_category_by_path(m: Model) -> DataFrame:
    return kpis.cross_count(fact(m), "ground_truth_category", "decision_path")


@query
def kpi_urgent_tickets(m: Model) -> DataFrame:
    return kpis.urgent_tickets(fact(m))


@query
def kpi_type_distribution(m: Model) -> DataFrame:
    return kpis.cross_count(fact(m), "response_type")


@query
def kpi_status_by_path(m: Model) -> DataFrame:
    return kpis.cross_count(fact(m), "response_status", "decision_path")


@query
def kpi_monthly_medians(m: Model) -> DataFrame:
    return kpis.monthly_medians(early_fact(m))


@query
def kpi_first_response_by_channel(m: Model) -> DataFrame:
    return kpis.mean_duration(early_fact(m), "first_response_minutes", "channel")


@query
def kpi_resolution_by_category(m: Model) -> DataFrame:
    return kpis.mean_duration(early_fact(m), "resolution_hours", "ground_truth_category")


@query
def kpi_value_against_resolution(m: Model) -> DataFrame:
    return kpis.value_against_resolution(early_fact(m, orders=True))


