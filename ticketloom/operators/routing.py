"""Rule routing: nine rules as column expressions in one projection."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions.labels import priority_of, recommended_action
from ticketloom.functions.numeric import number_text
from ticketloom.functions.sql import any_of, fill, kept, kept_long, listed, lookup, q, settled, true
from ticketloom.vocab import DEFAULTS, RULE_TEXT, Thresholds

DECISION_COLUMNS = [
    "final_priority",
    "decision_path",
    "recommended_action",
    "triggered_rules",
    "reasons",
    "conflicting_signals",
    "is_fallback",
]


HIGH = str(vocab.PRIORITIES.index("High"))


@dataclass(frozen=True)
class Rule:
    """One rule as SQL text: when it fires, its detail texts, and what firing implies."""

    name: str
    fired: str
    fired_text: str
    quiet_text: str
    floor: str | None = None
    forces_review: bool = False
    conflict: bool = False


def outside(column: str, low: float, high: float | None = None) -> str:
    """Out of range or NaN; NULL passes."""
    above = "" if high is None else f" OR {column} > {high}"
    return f"coalesce(isnan(CAST({column} AS DOUBLE)) OR {column} < {low}{above}, false)"


def not_in(column: str, allowed: list[str]) -> str:
    return f"coalesce({column} NOT IN {listed(allowed)}, false)"


def error(condition: str, message: str, column: str = "") -> str:
    return f"CASE WHEN {condition} THEN {fill(message, value=column) if column else q(message)} END"


ROUTING_CHECKS = [
    ("ticket_id IS NULL", "ticket_id: missing or not an integer", ""),
    (outside("classification_confidence", 0, 1), "classification_confidence: not in [0, 1]", ""),
    (outside("sentiment_score", -1, 1), "sentiment_score: not in [-1, 1]", ""),
    (outside("order_value", 0), "order_value: below 0", ""),
    (
        not_in("ai_predicted_category", vocab.CATEGORIES),
        "ai_predicted_category: '{value}' is not an approved category",
        "ai_predicted_category",
    ),
    (
        not_in("customer_segment", vocab.SEGMENTS),
        "customer_segment: '{value}' is not a known customer segment",
        "customer_segment",
    ),
]


def failed(checks: list[tuple[str, str, str]]) -> str:
    """Whether any input check fails."""
    return any_of(condition for condition, _, _ in checks)


def errors(checks: list[tuple[str, str, str]]) -> str:
    """Messages of the input checks that fail."""
    return kept_long(error(*check) for check in checks)


def rules(limits: Thresholds = DEFAULTS, **words: str) -> list[Rule]:
    """The nine rules in their fixed order, over the routing context columns.

    ``words`` names columns that hold the sentiment, confidence and order
    value as text, for the detail texts.
    """
    category, confidence, sentiment = "ai_predicted_category", "classification_confidence", "sentiment_score"
    words = {"category": category, "sentiment": "NULL", "confidence": "NULL", "value": "NULL"} | words

    def rule(name: str, fired: str, limit: Decimal = Decimal(0), **more) -> Rule:
        hot, quiet = RULE_TEXT[name]
        texts = {"fired_text": "", "quiet_text": q(quiet)} | {k: more.pop(k) for k in list(more) if k.endswith("_text")}
        if not texts["fired_text"]:
            texts["fired_text"] = fill(hot, **words, limit=q(str(float(limit))))
        return Rule(name, fired, **texts, **more)

    mapped, unmapped = RULE_TEXT["base_category_priority"]
    base = f"coalesce({lookup(category, vocab.BASE_PRIORITY)}, 'Medium')"
    upset = true(f"{sentiment} <= {limits.strong_negative_sentiment}")
    vip = true(f"order_value >= {limits.high_value_order} AND customer_segment = 'VIP'")
    unsure = f"({category} IS NOT NULL AND ({confidence} IS NULL OR {confidence} < {limits.low_confidence}))"
    low_text = fill(RULE_TEXT["low_confidence"][0], **words, limit=q(str(float(limits.low_confidence))))
    no_order = f"({true(f'{category} IN {listed(vocab.ORDER_DEPENDENT)}')} AND order_id IS NULL)"
    glad = limits.conflict_positive_sentiment
    return [
        rule(
            "base_category_priority",
            "true",
            fired_text=f"CASE WHEN {category} IS NULL THEN {q(unmapped)} ELSE {fill(mapped, category=category, base=base)} END",
            floor=lookup(category, {c: vocab.PRIORITIES.index(p) for c, p in vocab.BASE_PRIORITY.items()}, "1"),
        ),
        rule("strong_negative_sentiment_priority", upset, limits.strong_negative_sentiment, floor=HIGH),
        rule("high_value_vip_order_priority", vip, limits.high_value_order, floor=HIGH),
        rule("missing_classification", f"({category} IS NULL)", forces_review=True),
        rule(
            "low_confidence",
            unsure,
            fired_text=f"CASE WHEN {confidence} IS NULL THEN {q(vocab.NO_CONFIDENCE_RECORDED)} ELSE {low_text} END",
            quiet_text=f"CASE WHEN {category} IS NULL THEN {q(vocab.NO_CATEGORY_TO_ASSESS)} "
            f"ELSE {q(RULE_TEXT['low_confidence'][1])} END",
            forces_review=True,
        ),
        rule("sensitive_category", true(f"{category} IN {listed(vocab.SENSITIVE)}"), forces_review=True),
        rule("strong_negative_sentiment_review", upset, limits.strong_negative_sentiment, forces_review=True),
        rule("missing_order_context", no_order, forces_review=True, conflict=True),
        rule(
            "sentiment_category_conflict",
            true(f"{category} = 'Complaint' AND {sentiment} > {glad}"),
            glad,
            forces_review=True,
            conflict=True,
        ),
    ]


def bits(conditions: list[str]) -> str:
    """Bit mask of the conditions, the first one lowest."""
    return " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(conditions))


def has(mask: str, *numbers: int) -> str:
    """Whether the mask has any of the bits."""
    return f"{mask} & {sum(1 << i for i in numbers)} <> 0"


def route_tickets(context: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Context rows plus the decision columns; never shuffles, never drops a row.

    An invalid row gets the safe fallback: human review, Medium, no rules but
    ``fallback_invalid_input``. It never fails open to Automated.

    The fired rules travel as one bit mask (0 for an invalid row, since the
    base rule fires on every valid one); decision, names and texts each follow
    from it in a small projection of their own. One big projection would
    compile to a method beyond the size that the JVM optimises.
    """
    nine = rules(limits)
    at = {r.name: i for i, r in enumerate(nine)}
    review = [i for i, r in enumerate(nine) if r.forces_review]
    conflict = [i for i, r in enumerate(nine) if r.conflict]
    raised = [i for i, r in enumerate(nine) if r.floor == HIGH]
    base = next(r.floor for r in nine if r.name == "base_category_priority")
    mask = f"CASE WHEN {failed(ROUTING_CHECKS)} THEN 0 ELSE {bits([r.fired for r in nine])} END"
    score = f"greatest(_base_floor, CASE WHEN {has('_fired', *raised)} THEN {HIGH} ELSE 0 END)"
    decision = {
        "is_fallback": "_fired = 0",
        "final_priority": f"CASE WHEN _fired = 0 THEN 'Medium' ELSE {priority_of(score)} END",
        "decision_path": f"CASE WHEN _fired = 0 OR {has('_fired', *review)} THEN {q(vocab.HUMAN_REVIEW)} "
        f"ELSE {q(vocab.AUTOMATED)} END",
        "conflicting_signals": has("_fired", *conflict),
        "triggered_rules": f"CASE WHEN _fired = 0 THEN array({q(vocab.FALLBACK_RULE)}) "
        f"ELSE {kept(f'CASE WHEN {has("_fired", i)} THEN {q(r.name)} END' for i, r in enumerate(nine))} END",
    }
    upset, clash = at["strong_negative_sentiment_review"], at["sentiment_category_conflict"]
    words = {
        "validation_errors": f"CASE WHEN _fired = 0 THEN {errors(ROUTING_CHECKS)} ELSE CAST(array() AS ARRAY<STRING>) END",
        "_sentiment": f"CASE WHEN {has('_fired', upset, clash)} THEN {number_text('sentiment_score')} END",
        "_confidence": f"CASE WHEN {has('_fired', at['low_confidence'])} THEN {number_text('classification_confidence')} END",
        "_value": f"CASE WHEN {has('_fired', at['high_value_vip_order_priority'])} THEN {number_text('order_value')} END",
    }
    worded = rules(limits, sentiment="_sentiment", confidence="_confidence", value="_value")
    texts = kept_long(f"CASE WHEN {has('_fired', i)} THEN {r.fired_text} END" for i, r in enumerate(worded))
    reason = f"array(concat({q(vocab.RULE_FALLBACK_REASON)}, array_join(validation_errors, '; ')))"
    decided = context.selectExpr("*", settled({"_fired": mask, "_base_floor": base}))
    for step in (decision, words, {"reasons": f"CASE WHEN _fired = 0 THEN {reason} ELSE {texts} END"}):
        decided = decided.withColumns({n: F.expr(e) for n, e in step.items()})
    action = F.expr(recommended_action("decision_path", "final_priority"))
    return decided.withColumn("recommended_action", action).drop("_fired", "_base_floor", "_sentiment", "_confidence", "_value")


def rule_outcomes(context: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One row per valid ticket and rule, fired or not, with the detail text.

    Rows that fail the input checks have no outcomes: no rule looked at them.
    """
    outcomes = ", ".join(
        f"named_struct('rule_no', {i}, 'rule_name', {q(r.name)}, 'triggered', {has('_fired', i - 1)}, "
        f"'detail', CASE WHEN {has('_fired', i - 1)} THEN {r.fired_text} ELSE {r.quiet_text} END, "
        f"'priority_floor', {_floor_text(r, i - 1)}, "
        f"'forces_human_review', {has('_fired', i - 1)} AND {str(r.forces_review).lower()}, "
        f"'is_conflict_signal', {has('_fired', i - 1)} AND {str(r.conflict).lower()})"
        for i, r in enumerate(rules(limits, sentiment="_sentiment", confidence="_confidence", value="_value"), 1)
    )
    nine = rules(limits)
    base = next(r.floor for r in nine if r.name == "base_category_priority")
    numbers = {"_sentiment": "sentiment_score", "_confidence": "classification_confidence", "_value": "order_value"}
    return (
        context.where(f"NOT {failed(ROUTING_CHECKS)}")
        .selectExpr("*", settled({"_fired": bits([r.fired for r in nine]), "_base_floor": base}))
        .withColumns({n: F.expr(number_text(c)) for n, c in numbers.items()})
        .selectExpr("ticket_id", f"inline(array({outcomes}))")
    )


def _floor_text(rule: Rule, bit: int) -> str:
    if rule.floor is None:
        return "CAST(NULL AS STRING)"
    label = priority_of("_base_floor") if rule.name == "base_category_priority" else q(vocab.PRIORITIES[int(rule.floor)])
    return f"CASE WHEN {has('_fired', bit)} THEN {label} END"


def decision_updates(decided: DataFrame, run_at: Column) -> DataFrame:
    """Update rows for the write-back; rows without an id match no ticket and stay out."""
    return decided.where("ticket_id IS NOT NULL").select(
        "ticket_id", "final_priority", "decision_path", run_at.alias("rule_decision_at")
    )
