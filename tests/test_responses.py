import json

import pytest

from ticketloom import vocab
from ticketloom.operators import evaluation
from ticketloom.operators.responses import (
    PROMPT_COLUMNS, decide_responses, prompt_context, response_prompt, response_violations, with_eligibility,
)
from ticketloom.operators.scanning import scan_codes, scan_texts
from pyspark.sql import functions as F

SCHEMA = (
    "ticket_id bigint, message_text string, ai_predicted_category string, classification_confidence double, sentiment_score double, "
    "decision_path string, final_priority string, order_id bigint, order_status string, order_value double, "
    "expected_delivery_date string, actual_delivery_date string, product_names string, customer_segment string"
)
GOOD = {"can_generate": True, "draft_text": "Thanks, we are looking into it."}


def context(spark, *rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"message_text": "hi", **r}.get(n) for n in names) for r in rows], SCHEMA)


AUTO = dict(ai_predicted_category="Order Status Inquiry", classification_confidence=0.95, sentiment_score=0.1,
            decision_path="Automated", final_priority="Low", order_id=10)
HUMAN = dict(ai_predicted_category="Complaint", classification_confidence=0.9, sentiment_score=-0.5, decision_path="Human Review",
             final_priority="Urgent")


def generate(spark, **outputs):
    rows = [(int(k[1:]), v if v is None or isinstance(v, str) else json.dumps(v), None) for k, v in outputs.items()]
    return spark.createDataFrame(rows, "ticket_id bigint, tool_input_json string, error_type string")


def test_without_a_generator(spark):
    rows = {r.ticket_id: r for r in decide_responses(context(spark, dict(AUTO, ticket_id=1), dict(HUMAN, ticket_id=2), dict(ticket_id=3))).collect()}
    assert [rows[i].response_status for i in (1, 2, 3)] == ["BLOCKED", "HUMAN_REVIEW_DRAFT", "NOT_ELIGIBLE"]
    assert rows[1].rationale[-1] == vocab.AUTOMATED_SKIPPED and rows[2].rationale[-1] == vocab.INTERNAL_DRAFT_SKIPPED
    assert rows[3].rationale == [vocab.NO_DECISION_YET] and rows[3].response_type is None


@pytest.mark.parametrize(
    "output,status,code",
    [
        (GOOD, "DRAFT_GENERATED", None),
        (dict(GOOD, draft_text="  padded  "), "DRAFT_GENERATED", None),
        (dict(GOOD, draft_text="Your refund has been processed."), "BLOCKED", "safety_violation"),
        ({"can_generate": False, "missing_information": ["order number"]}, "BLOCKED", "model_declined"),
        ({"can_generate": None}, "BLOCKED", "model_declined"),
        ({"can_generate": True, "draft_text": "   "}, "BLOCKED", "empty_draft"),
        ({"can_generate": True}, "BLOCKED", "empty_draft"),
        ({"draft_text": "x"}, "BLOCKED", "malformed_response"),
        ("[1]", "BLOCKED", "malformed_response"),
        ("nonsense", "BLOCKED", "malformed_response"),
        (None, "BLOCKED", "malformed_response"),
    ],
)
def test_generation_outcomes(spark, output, status, code):
    row = decide_responses(context(spark, dict(AUTO, ticket_id=1)), generate(spark, t1=output)).first()
    assert (row.response_status, row.failure) == (status, code)
    assert (row.response_draft is not None) == (status == "DRAFT_GENERATED")
    if status == "DRAFT_GENERATED":
        assert row.response_draft == row.response_draft.strip("  ")
    if code == "safety_violation":
        assert "refund_claimed_or_promised" in row.rationale[-1]
    if code == "model_declined":
        assert ("order number" if output["can_generate"] is False else "unspecified") in row.rationale[-1]


def test_internal_draft_failure_keeps_the_status(spark):
    row = decide_responses(context(spark, dict(HUMAN, ticket_id=1)), generate(spark, t1="oops")).first()
    assert row.response_status == "HUMAN_REVIEW_DRAFT" and row.response_draft is None
    assert "malformed_response" in row.rationale[-1]


def test_internal_drafts_can_be_switched_off(spark):
    frame = context(spark, dict(HUMAN, ticket_id=1), dict(AUTO, ticket_id=2), dict(ticket_id=3))
    needed = with_eligibility(frame, generate_internal_drafts=False).where("needs_generation")
    assert [r.ticket_id for r in needed.collect()] == [2]
    row = decide_responses(frame, generate(spark, t1=GOOD, t2=GOOD), generate_internal_drafts=False).where("ticket_id = 1").first()
    assert row.response_draft is None and row.rationale == [vocab.RESPECT_HUMAN_REVIEW]


@pytest.mark.parametrize(
    "change,words",
    [
        (dict(ai_predicted_category=None), vocab.PROBLEM_NO_CLASS),
        (dict(classification_confidence=None), vocab.PROBLEM_NO_CONFIDENCE),
        (dict(classification_confidence=0.5), "classification_confidence 0.5 is below the 0.75 threshold."),
        (dict(ai_predicted_category="Complaint"), "category 'Complaint' is sensitive."),
        (dict(sentiment_score=-0.7), "sentiment_score -0.7 is strongly negative."),
        (dict(ai_predicted_category="Refund Request", order_id=None), "requires order context"),
    ],
)
def test_recheck_fails_safe(spark, change, words):
    row = with_eligibility(context(spark, dict(AUTO, ticket_id=1, **{}) | change)).first()
    assert row.eligibility == "human_review" and any(words in r for r in row.eligibility_reasons)


@pytest.mark.parametrize("change", [dict(message_text=None), dict(decision_path="Maybe"), dict(ai_predicted_category="Spam"),
                                    dict(classification_confidence=2.0), dict(order_value=-1.0)])
def test_invalid_context_falls_back(spark, change):
    row = decide_responses(context(spark, dict(AUTO, ticket_id=1) | change), generate(spark, t1=GOOD)).first()
    assert row.is_fallback and row.response_status == "NOT_ELIGIBLE" and row.response_draft is None and row.response_type is None


SAFE = [
    "We are sorry for the wait; the parcel shows as Delayed at the moment.",
    "Which order number does this concern?",
    "A colleague looks at the refund question this afternoon.",
    "You will hear from us as soon as there is news about the return.",
    "Your note reached us and the right team reads it today.",
]
UNSAFE = [
    ("All refunds have been finalized on our side.", "refund_claimed_or_promised"),
    ("Since Monday we've already issued the refund.", "refund_claimed_or_promised"),
    ("The second charge was voided by the bank desk.", "payment_reversal_claimed"),
    ("Store credit of ten euros has been given for the delay.", "compensation_promised"),
    ("Your account was quietly reset over night.", "account_change_claimed"),
    ("Your shipment was this morning resent by air.", "shipment_or_order_change_claimed"),
    ("We've corrected the entry in our books.", "action_performed_claimed"),
    ("I'm an AI and glad to assist.", "internal_architecture_mentioned"),
    ("The large language model rates this as urgent.", "internal_architecture_mentioned"),
    ("YOUR REFUND HAS BEEN ISSUED.", "refund_claimed_or_promised"),
    ("Your refund haſ been iſſued.", "refund_claimed_or_promised"),
    ("Your payment has been\u00a0reversed. Thank you", "payment_reversal_claimed"),
    ("Your refund" + "\n" + "has been processed", None),
]


def test_scanner(spark):
    rows = [(i, t) for i, t in enumerate(SAFE + [""])] + [(100 + i, t) for i, (t, _) in enumerate(UNSAFE)] + [(999, None)]
    found = scan_codes(spark.createDataFrame(rows, "id int, text string"), "text", ["id"]).collect()
    got: dict[int, set[str]] = {}
    for r in found:
        got.setdefault(r.id, set()).add(r.code)
    assert not [i for i in got if i < 100 or i == 999]
    for i, (_, code) in enumerate(UNSAFE):
        assert (code in got.get(100 + i, set())) if code else (100 + i not in got)


def test_scanner_equals_the_patterns_run_alone(spark):
    """The search for openings may not change any result."""
    import re

    from ticketloom.functions.safety import FORBIDDEN

    texts = SAFE + [t for t, _ in UNSAFE] + [f"{a} {b}" for a in SAFE for b, _ in UNSAFE]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.pattern_no, r.matched) for r in scan_texts(frame, "text", ["id"]).collect()}
    expected = set()
    for i, text in enumerate(texts):
        for n, (_, pattern) in enumerate(FORBIDDEN, 1):
            hit = re.search(pattern, text, re.IGNORECASE)
            if hit:
                expected.add((i, n, hit.group(0)))
    assert got == expected


def test_invariants_hold_and_catch(spark):
    frame = context(spark, dict(AUTO, ticket_id=1), dict(HUMAN, ticket_id=2), dict(ticket_id=3))
    decided = decide_responses(frame, generate(spark, t1=GOOD, t2=GOOD))
    assert response_violations(decided).count() == 0
    broken = decided.withColumn("response_draft", F.lit("leaked")).withColumn("customer_facing", F.lit(True))
    assert {r.violation for r in response_violations(broken).collect()} == {
        "flags do not match response_status", "response_draft on a status without draft",
    }


def test_prompt_holds_no_personal_data(spark):
    frame = with_eligibility(context(spark, dict(AUTO, ticket_id=1, order_status="Shipped", product_names="Lamp", order_value=99.0)))
    allowed = prompt_context(frame)
    assert allowed.columns == ["ticket_id", *PROMPT_COLUMNS]
    text = allowed.select(F.expr(response_prompt())).first()[0]
    assert text.splitlines()[:3] == ["Customer message:", '"""', "hi"] and "Products in this order: Lamp" in text
    assert "99" not in text and "order_status=Shipped, expected_delivery_date=None" in text


def test_evaluation(spark):
    frame = context(spark, dict(AUTO, ticket_id=1), dict(HUMAN, ticket_id=2), dict(ticket_id=3), dict(AUTO, ticket_id=4))
    row = evaluation.response_evaluation(
        decide_responses(frame, generate(spark, t1=GOOD, t2=GOOD, t4={"can_generate": False}))
    ).first()
    assert (row.automated_response_eligible_rate, row.blocked_response_rate, row.draft_generation_attempted) == (0.25, 0.25, 3)
    assert row.draft_generation_success_rate == 2 / 3 and row.internal_draft_rate == 1.0 and row.missing_context_rate == 0.25
    none = evaluation.response_evaluation(decide_responses(frame)).first()
    assert none.draft_generation_attempted == 0 and none.draft_generation_success_rate is None
