"""Derived labels, buckets and flags, as SQL expression text."""

from __future__ import annotations

from decimal import Decimal

from ticketloom import vocab
from ticketloom.functions.sql import listed, lookup, q


def priority_score(priority: str) -> str:
    """Low=0 .. Urgent=3; NULL for NULL."""
    return lookup(priority, {p: i for i, p in enumerate(vocab.PRIORITIES)})


def priority_of(score: str) -> str:
    return lookup(score, dict(enumerate(vocab.PRIORITIES)))


def recommended_action(path: str, priority: str) -> str:
    """NULL while undecided."""
    return (
        f"CASE WHEN {path} IS NULL THEN NULL WHEN {path} = {q(vocab.AUTOMATED)} THEN 'AUTO_RESOLVE' "
        f"WHEN {priority} IN ('High', 'Urgent') THEN 'HUMAN_REVIEW_URGENT' ELSE 'HUMAN_REVIEW_STANDARD' END"
    )


def response_type(category: str) -> str:
    return lookup(category, vocab.RESPONSE_TYPE_OF)


def customer_facing(status: str) -> str:
    return f"CASE WHEN {status} IN {listed(vocab.RESPONSE_STATUSES)} THEN {status} = 'DRAFT_GENERATED' END"


def requires_human_review(status: str) -> str:
    return (
        f"CASE WHEN {status} IN {listed(vocab.RESPONSE_STATUSES)} "
        f"THEN {status} IN ('HUMAN_REVIEW_DRAFT', 'BLOCKED') END"
    )


def sentiment_bucket(score: str) -> str:
    return (
        f"CASE WHEN {score} IS NULL THEN 'missing' WHEN {score} <= -0.7 THEN 'very_negative (<= -0.7)' "
        f"WHEN {score} <= -0.3 THEN 'negative (-0.7 to -0.3)' WHEN {score} < 0.3 THEN 'neutral (-0.3 to 0.3)' "
        f"WHEN {score} < 0.7 THEN 'positive (0.3 to 0.7)' ELSE 'very_positive (>= 0.7)' END"
    )


def confidence_bucket(score: str, threshold: Decimal) -> str:
    shown = float(threshold)
    return (
        f"CASE WHEN {score} IS NULL THEN 'missing' WHEN {score} < {threshold} "
        f"THEN 'below_threshold (< {shown})' ELSE 'at_or_above_threshold (>= {shown})' END"
    )


def or_label(value: str, label: str) -> str:
    return f"coalesce({value}, {q(label)})"


def not_available(value: str) -> str:
    """Display form of a metric: NULL becomes NOT AVAILABLE."""
    return f"coalesce(CAST(CAST({value} AS DOUBLE) AS STRING), {q(vocab.NOT_AVAILABLE)})"
