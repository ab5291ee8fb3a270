"""Whole runs: pick, decide, report; and their publication behind the double gate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.operators import classification, evaluation, responses, routing, selfcheck, views
from ticketloom.sources import audit, picks, scoring, snapshots, store
from ticketloom.vocab import DEFAULTS, Thresholds


@dataclass(frozen=True)
class Run:
    """What a run decided; all frames are lazy.

    ``updates`` holds the owned columns of the stage for the write-back,
    ``events`` the audit rows.
    """

    decided: DataFrame
    updates: DataFrame
    owned: list[str]
    events: Callable[[bool], DataFrame]
    summary: DataFrame
    evaluation: DataFrame
    run_at: Column


def run_rules(
    tickets: DataFrame, customers: DataFrame, orders: DataFrame, *, run_at: Column, limit: int | None = None,
    only_undecided: bool = True, limits: Thresholds = DEFAULTS, stage: str | None = None,
) -> Run:
    """Route the pending tickets. ``stage`` (a new path in the shared folder) keeps the decisions for all that reads them."""
    decided = routing.route_tickets(picks.rules_context(tickets, customers, orders, limit, only_undecided), limits)
    decided = _kept(decided, stage)
    return Run(
        decided,
        routing.decision_updates(decided, run_at),
        vocab.ROUTING_COLUMNS,
        lambda dry: audit.routing_events(decided, dry),
        evaluation.rules_summary(decided),
        evaluation.rules_evaluation(decided),
        run_at,
    )


def _kept(frame: DataFrame, stage: str | None) -> DataFrame:
    """The frame as it is, or written to ``stage`` and read from there, so that it is computed once."""
    if stage is None:
        return frame
    frame.write.mode("errorifexists").parquet(stage)
    return frame.sparkSession.read.parquet(stage)


def _scored(frame: DataFrame, make_scorer: Callable[[], scoring.Scorer], carry: list[str], scratch: str) -> DataFrame:
    """The model calls, written out: a second action must not call the model again."""
    return _kept(scoring.score_batches(frame, make_scorer, carry), scratch)


def run_responses(
    tickets: DataFrame, customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, *, run_at: Column,
    make_scorer: Callable[[], scoring.Scorer] | None = None, scratch: str | None = None, limit: int | None = None,
    generate_internal_drafts: bool = True, limits: Thresholds = DEFAULTS, stage: str | None = None,
) -> Run:
    """Decide responses for the unprocessed tickets.

    Without a scorer eligibility and status are real and no draft is made.
    With one, only the rows that need a draft are sent to it, and ``scratch``
    (a new path in the shared folder) keeps the answers. ``stage`` keeps the
    decisions, see ``run_rules``.
    """
    context = picks.response_context(tickets, customers, orders, items, products, limit)
    generations = None
    if make_scorer is not None:
        if scratch is None:
            raise ValueError("a run with a scorer needs a scratch path for its answers")
        eligible = responses.with_eligibility(context, limits, generate_internal_drafts).where("needs_generation")
        prompts = eligible.withColumn("prompt", F.expr(responses.response_prompt()))
        generations = _scored(prompts, make_scorer, [], scratch)
    decided = _kept(responses.decide_responses(context, generations, limits, generate_internal_drafts), stage)
    return Run(
        decided,
        responses.response_updates(decided, run_at),
        vocab.RESPONSE_COLUMNS,
        lambda dry: audit.response_events(decided, dry),
        evaluation.response_summary(decided),
        evaluation.response_evaluation(decided),
        run_at,
    )


def run_classify(
    tickets: DataFrame, *, run_at: Column, make_scorer: Callable[[], scoring.Scorer], scratch: str, limit: int | None = None,
    secrets: list[str] | None = None,
) -> Run:
    """Classify the unclassified tickets; failed calls are counted and never written."""
    prompts = picks.unclassified(tickets, limit).withColumn(
        "prompt", F.expr(classification.classification_prompt("message_text"))
    )
    validated = classification.validate_classifications(_scored(prompts, make_scorer, [], scratch))
    return Run(
        validated,
        classification.classification_updates(validated, run_at),
        vocab.CLASSIFIER_COLUMNS,
        lambda dry: audit.classification_events(validated, dry, secrets),
        evaluation.classify_summary(validated),
        evaluation.failures_by_type(validated),
        run_at,
    )


def publish_run(
    run: Run, tickets: DataFrame, root: str, version: str, log: str, run_date: str, *, config_live: bool, live: bool,
    orders: DataFrame | None = None,
) -> DataFrame:
    """Write the updated tickets if both live flags say so, then the audit events of this run in a folder of their own.

    With ``orders`` the owner gate holds: tickets linked to another customer's order stay as they are, and so do tickets whose
    updates contradict each other.
    """
    wet = snapshots.is_live(config_live, live)
    updated = snapshots.apply_overlay(tickets, run.updates, run.owned, run.run_at, orders, clashing="leave")
    published = snapshots.publish(updated, root, version, config_live=config_live, live=live)
    audit.write_events(run.events(not wet), log, run_date, run_id=version if wet else f"{version}-dry")
    return published


def publish_run_in_place(
    run: Run, spark: SparkSession, root: str, version: str, log: str, run_date: str, *, config_live: bool, live: bool,
    orders: DataFrame | None = None,
) -> store.WriteBack | None:
    """As ``publish_run`` on a table in id ranges: only ranges that hold an applied update are written; None in a dry run."""
    wet = snapshots.is_live(config_live, live)
    done = store.write_back(spark, root, run.updates, run.owned, run.run_at, version, orders) if wet else None
    audit.write_events(run.events(not wet), log, run_date, run_id=version if wet else f"{version}-dry")
    return done


def stored_rules_report(tickets: DataFrame) -> DataFrame:
    return evaluation.rules_evaluation_stored(picks.routing_results(tickets))


def stored_responses_report(tickets: DataFrame) -> DataFrame:
    return evaluation.response_evaluation_stored(picks.response_results(tickets))


def classifier_report(tickets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overall, per category, and the confusion matrix, all from one count of pairs."""
    pairs = evaluation.pair_counts(picks.evaluation_rows(tickets))
    return evaluation.classifier_evaluation(pairs), evaluation.per_category(pairs), evaluation.confusion_matrix(pairs)


def analytics_report(tickets: DataFrame, customers: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read-only: the metric summary and the issues of the self-check."""
    metrics = views.all_metrics(tickets)
    fact = views.ticket_fact(tickets, customers, orders)
    return selfcheck.summarize(metrics), selfcheck.check_metrics(metrics, selfcheck.fact_summary(fact))
