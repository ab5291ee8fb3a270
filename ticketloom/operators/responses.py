"""Response decisions: eligibility, generation outcome, status, draft and rationale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions.jsonfields import field, get, json_object, truthy
from ticketloom.functions.labels import customer_facing, requires_human_review, response_type
from ticketloom.functions.numeric import number_text
from ticketloom.functions.safety import lowered, strip, violation_codes
from ticketloom.functions.sql import any_of, fill, kept, kept_long, listed, q, settled, true
from ticketloom.operators.routing import bits, error, errors, failed, has, not_in, outside
from ticketloom.vocab import DEFAULTS, Thresholds

# The only columns that may reach a model call.
PROMPT_COLUMNS = [
    "message_text",
    "ai_predicted_category",
    "sentiment_score",
    "final_priority",
    "customer_segment",
    "response_type",
    "order_id",
    "order_status",
    "expected_delivery_date",
    "actual_delivery_date",
    "product_names",
]
GENERATION_COLUMNS = ["tool_input_json", "error_type"]


def response_checks(columns: list[str]) -> list[tuple[str, str, str]]:
    """Input checks of a response context; ``order_value`` is optional as a column."""
    checks = [
        ("ticket_id IS NULL", "ticket_id: missing or not an integer", ""),
        ("message_text IS NULL", "message_text: required", ""),
        (outside("classification_confidence", 0, 1), "classification_confidence: not in [0, 1]", ""),
        (outside("sentiment_score", -1, 1), "sentiment_score: not in [-1, 1]", ""),
        (
            not_in("ai_predicted_category", vocab.CATEGORIES),
            "ai_predicted_category: '{value}' is not an approved category",
            "ai_predicted_category",
        ),
        (
            not_in("decision_path", vocab.DECISION_PATHS),
            "decision_path: '{value}' is not a valid decision_path",
            "decision_path",
        ),
    ]
    if "order_value" in columns:
        checks.append((outside("order_value", 0), "order_value: below 0", ""))
    return checks


def recheck_problems(limits: Thresholds = DEFAULTS, **words: str) -> list[tuple[str, str]]:
    """``(condition, text)`` of what speaks against an automated response.

    ``words`` names columns that hold the confidence and the sentiment as text.
    """
    words = {"confidence": "NULL", "sentiment": "NULL"} | words
    category, confidence, sentiment = "ai_predicted_category", "classification_confidence", "sentiment_score"
    low = {"confidence": words["confidence"], "limit": q(str(float(limits.low_confidence)))}
    return [
        (f"({category} IS NULL)", q(vocab.PROBLEM_NO_CLASS)),
        (f"({confidence} IS NULL)", q(vocab.PROBLEM_NO_CONFIDENCE)),
        (true(f"{confidence} < {limits.low_confidence}"), fill(vocab.PROBLEM_LOW_CONFIDENCE, **low)),
        (true(f"{category} IN {listed(vocab.SENSITIVE)}"), fill(vocab.PROBLEM_SENSITIVE, category=category)),
        (
            true(f"{sentiment} <= {limits.strong_negative_sentiment}"),
            fill(vocab.PROBLEM_SENTIMENT, sentiment=words["sentiment"]),
        ),
        (
            f"({true(f'{category} IN {listed(vocab.ORDER_DEPENDENT)}')} AND order_id IS NULL)",
            fill(vocab.PROBLEM_NO_ORDER, category=category),
        ),
    ]


def with_eligibility(context: DataFrame, limits: Thresholds = DEFAULTS, generate_internal_drafts: bool = True) -> DataFrame:
    """Adds validity, response type, eligibility with its reasons, and ``needs_generation``.

    A stored Automated decision is checked again and fails safe. Filter on
    ``needs_generation`` before the model-call stage: rows that are not
    eligible, or whose internal drafts are switched off, cost no call.
    """
    checks = response_checks(context.columns)
    problems = recheck_problems(limits, confidence="_confidence", sentiment="_sentiment")
    human = f"decision_path = {q(vocab.HUMAN_REVIEW)}"
    outcome = (
        f"CASE WHEN {failed(checks)} THEN NULL WHEN decision_path IS NULL THEN 'no_phase4_decision' "
        f"WHEN {human} OR {any_of(c for c, _ in recheck_problems(limits))} THEN 'human_review' ELSE 'automated_eligible' END"
    )
    automated = "eligibility IS NOT NULL AND decision_path = " + q(vocab.AUTOMATED)
    found = kept_long([q(vocab.RECHECK_FAILED), *[f"CASE WHEN {has('_problems', i)} THEN {t} END" for i, (_, t) in enumerate(problems)]])
    sound = [
        fill(vocab.OK_CLASS, category="ai_predicted_category"),
        fill(vocab.OK_CONFIDENCE, confidence="_confidence"),
        f"CASE WHEN order_id IS NOT NULL THEN {q(vocab.OK_ORDER)} END",
    ]
    wanted = ["automated_eligible", "human_review"] if generate_internal_drafts else ["automated_eligible"]
    steps = [
        {
            "response_type": f"CASE WHEN eligibility IS NOT NULL THEN {response_type('ai_predicted_category')} END",
            "needs_generation": true(f"eligibility IN {listed(wanted)}"),
        },
        {
            "validation_errors": f"CASE WHEN eligibility IS NULL THEN {errors(checks)} ELSE CAST(array() AS ARRAY<STRING>) END",
            "_problems": f"CASE WHEN {automated} THEN {bits([c for c, _ in problems])} ELSE 0 END",
            "_confidence": f"CASE WHEN {automated} THEN {number_text('classification_confidence')} END",
            "_sentiment": f"CASE WHEN {automated} THEN {number_text('sentiment_score')} END",
        },
        {
            "eligibility_reasons": "CASE WHEN eligibility IS NULL THEN NULL "
            f"WHEN decision_path IS NULL THEN array({q(vocab.NO_DECISION_YET)}) "
            f"WHEN {human} THEN array({q(vocab.RESPECT_HUMAN_REVIEW)}) "
            f"WHEN _problems <> 0 THEN {found} ELSE {kept_long(sound)} END",
        },
    ]
    rows = context.selectExpr("*", settled({"eligibility": outcome}))
    for step in steps:
        rows = rows.withColumns({n: F.expr(e) for n, e in step.items()})
    return rows.drop("_problems", "_confidence", "_sentiment")


def generation_outcome(generated: DataFrame) -> DataFrame:
    """Adds ``failure`` (NULL on success or where no call was needed), ``draft_text``,
    ``safety_codes`` and ``missing_information``.

    ``draft_text`` is present only for a clean draft: a text that fails the
    scan is dropped here, and only the codes travel on.
    """
    needed = "needs_generation AND error_type IS NULL"
    failure = (
        "CASE WHEN NOT needs_generation THEN NULL WHEN error_type IS NOT NULL THEN error_type "
        "WHEN _document IS NULL OR _flag.kind IS NULL THEN 'malformed_response' "
        f"WHEN NOT {truthy('_flag')} THEN 'model_declined' WHEN coalesce(_draft, '') = '' THEN 'empty_draft' "
        "WHEN size(safety_codes) > 0 THEN 'safety_violation' END"
    )
    steps = [
        {"_document": f"CASE WHEN {needed} THEN {json_object('tool_input_json')} END"},
        {"_flag": field("_document", "can_generate"), "_text": field("_document", "draft_text")},
        {"_draft": f"CASE WHEN {truthy('_flag')} AND {truthy('_text')} THEN {strip('_text.text')} END"},
        {"_lowered": lowered("_draft")},
        {"safety_codes": violation_codes("_draft", "_lowered")},
    ]
    texts = {
        "missing_information": "CASE WHEN failure = 'model_declined' "
        f"THEN {get('_document', 'missing_information', 'array<string>')} END",
        "draft_text": "CASE WHEN needs_generation AND failure IS NULL THEN _draft END",
    }
    for step in steps:
        generated = generated.withColumns({n: F.expr(e) for n, e in step.items()})
    generated = generated.selectExpr("*", settled({"failure": failure})).withColumns({n: F.expr(e) for n, e in texts.items()})
    return generated.drop("_document", "_flag", "_text", "_draft", "_lowered")


def decide_responses(
    context: DataFrame,
    generations: DataFrame | None = None,
    limits: Thresholds = DEFAULTS,
    generate_internal_drafts: bool = True,
) -> DataFrame:
    """Response decision per ticket: status, type, draft, flags, rationale.

    ``generations`` is ``(ticket_id, tool_input_json, error_type)``, one row
    per ticket that needed a model call; NULL means no generator. A context that already
    carries the two generation columns (the output of the model-call stage
    with pass-through) needs no join: pass ``generations=context``.
    """
    eligible = with_eligibility(context, limits, generate_internal_drafts)
    has_generator = generations is not None
    if generations is context and has_generator:
        rows = generation_outcome(eligible)
    elif has_generator:
        rows = generation_outcome(eligible.join(generations.select("ticket_id", *GENERATION_COLUMNS), "ticket_id", "left"))
    else:
        empty = F.lit(None).cast("string")
        rows = eligible.withColumns(
            {"failure": empty, "draft_text": empty}
        )
    succeeded = "failure IS NULL" if has_generator else "false"
    internal, auto = "eligibility = 'human_review'", "eligibility = 'automated_eligible'"
    if has_generator:
        codes, missing = "array_join(safety_codes, ', ')", "coalesce(nullif(array_join(missing_information, ', '), ''), 'unspecified')"
        note = (
            f"CASE WHEN {internal} AND NOT needs_generation THEN NULL "
            f"WHEN {internal} AND {succeeded} THEN {q(vocab.INTERNAL_DRAFT_OK)} "
            f"WHEN {internal} THEN {fill(vocab.INTERNAL_DRAFT_FAILED, failure='failure')} "
            f"WHEN {auto} AND {succeeded} THEN {q(vocab.AUTOMATED_OK)} "
            f"WHEN {auto} AND failure = 'safety_violation' THEN {fill(vocab.AUTOMATED_UNSAFE, codes=codes)} "
            f"WHEN {auto} AND failure = 'model_declined' THEN {fill(vocab.AUTOMATED_DECLINED, missing=missing)} "
            f"WHEN {auto} THEN {fill(vocab.AUTOMATED_FAILED, failure='failure')} END"
        )
    else:
        note = f"CASE WHEN {internal} THEN {q(vocab.INTERNAL_DRAFT_SKIPPED)} WHEN {auto} THEN {q(vocab.AUTOMATED_SKIPPED)} END"
    fallback = f"array(concat({q(vocab.RESPONSE_FALLBACK_REASON)}, array_join(validation_errors, '; ')))"
    first = {
        "response_status": "CASE WHEN eligibility IS NULL OR eligibility = 'no_phase4_decision' THEN 'NOT_ELIGIBLE' "
        f"WHEN {internal} THEN 'HUMAN_REVIEW_DRAFT' WHEN {succeeded} THEN 'DRAFT_GENERATED' ELSE 'BLOCKED' END",
        "response_draft": f"CASE WHEN needs_generation AND {succeeded} THEN draft_text END",
        "rationale": f"CASE WHEN eligibility IS NULL THEN {fallback} ELSE concat(eligibility_reasons, {kept_long([note])}) END",
        "is_fallback": "eligibility IS NULL",
    }
    flags = {
        "customer_facing": customer_facing("response_status"),
        "requires_human_review": requires_human_review("response_status"),
    }
    decided = rows.withColumns({n: F.expr(e) for n, e in first.items()})
    return decided.withColumns({n: F.expr(e) for n, e in flags.items()}).drop("draft_text")


def response_violations(decided: DataFrame) -> DataFrame:
    """Rows that break the result invariants: ``(ticket_id, violation)``; empty when sound."""
    has_text = "coalesce(response_draft, '') <> ''"
    known = true(f"response_status IN {listed(vocab.RESPONSE_STATUSES)}")
    flags = (
        f"customer_facing <=> {customer_facing('response_status')} "
        f"AND requires_human_review <=> {requires_human_review('response_status')}"
    )
    broken = kept(
        [
            error(f"NOT {known}", "response_status not approved"),
            error(not_in("response_type", vocab.RESPONSE_TYPES), "response_type not approved"),
            error(f"{known} AND NOT ({flags})", "flags do not match response_status"),
            error(f"response_status = 'DRAFT_GENERATED' AND NOT {has_text}", "DRAFT_GENERATED without response_draft"),
            error(
                f"response_status IN ('BLOCKED', 'NOT_ELIGIBLE') AND {has_text}", "response_draft on a status without draft"
            ),
        ]
    )
    return decided.selectExpr("ticket_id", f"explode({broken}) AS violation")


def prompt_context(eligible: DataFrame) -> DataFrame:
    """The columns a model call may see, and no others."""
    return eligible.select("ticket_id", *PROMPT_COLUMNS)


def response_prompt() -> str:
    """User prompt text over the prompt columns."""

    def shown(label: str, value: str, empty: str) -> str:
        return f"concat({q(label)}, coalesce(nullif({value}, ''), {q(empty)}))"

    # --- Fixed values: prompt wording ---
    order = [
        shown("Linked order: order_status=", "order_status", "None"),
        shown(", expected_delivery_date=", "CAST(expected_delivery_date AS STRING)", "None"),
        shown(", actual_delivery_date=", "CAST(actual_delivery_date AS STRING)", "None"),
    ]
    lines = [
        fill('Customer message:\n"""\n{message}\n"""', message="message_text"),
        "''",
        shown("Predicted category: ", "ai_predicted_category", "unknown"),
        shown("Sentiment score (-1 to 1): ", number_text("sentiment_score"), "None"),
        shown("Priority: ", "final_priority", "unknown"),
        shown("Customer segment: ", "customer_segment", "unknown"),
        shown("Response purpose type: ", "response_type", "unknown"),
        f"CASE WHEN order_id IS NULL THEN 'No order is linked to this ticket.' ELSE concat({', '.join(order)}) END",
        "CASE WHEN order_id IS NOT NULL AND product_names <> '' THEN concat('Products in this order: ', product_names) END",
    ]
    return f"concat_ws('\\n', {', '.join(lines)})"


def response_updates(decided: DataFrame, run_at: Column) -> DataFrame:
    return decided.where("ticket_id IS NOT NULL").select(
        "ticket_id", "response_status", "response_type", "response_draft", run_at.alias("response_generated_at")
    )
