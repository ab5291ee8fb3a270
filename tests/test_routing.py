import pytest

from ticketloom import vocab
from ticketloom.operators import evaluation
from ticketloom.operators.routing import decision_updates, route_tickets, rule_outcomes
from pyspark.sql import functions as F
from ticketloom.plans.testmodel import Model

SCHEMA = (
    "ticket_id bigint, ai_predicted_category string, classification_confidence double, sentiment_score double, "
    "order_id bigint, order_value double, customer_segment string"
)


def decide(spark, *rows):
    frame = spark.createDataFrame([(r + (None,) * 7)[:7] for r in rows], SCHEMA)
    return {r.ticket_id: r for r in route_tickets(frame).collect()}


def test_paths_and_priorities(spark):
    """One ticket per way a decision can come about; the values are this test's own."""
    got = decide(
        spark,
        (21, "Order Status Inquiry", 0.81, 0.45, 700),
        (22, "Product Question", 0.99, -0.2),
        (23, "Refund Request", 0.31, 0.05, 701),
        (24, "Account Problem", 0.77, 0.6),
        (25, "Payment Problem", 0.88, -0.65, 702),
        (26, "Complaint", 0.93, -0.85, 703),
    )
    assert [(got[i].decision_path, got[i].final_priority) for i in range(21, 27)] == [
        ("Automated", "Low"),
        ("Automated", "Low"),
        ("Human Review", "Medium"),
        ("Human Review", "Medium"),
        ("Human Review", "High"),
        ("Human Review", "Urgent"),
    ]
    assert not got[21].conflicting_signals and "strong_negative_sentiment_review" not in got[25].triggered_rules
    assert got[26].triggered_rules == [
        "base_category_priority",
        "strong_negative_sentiment_priority",
        "sensitive_category",
        "strong_negative_sentiment_review",
    ]
    assert got[26].reasons[1] == "sentiment_score=-0.85 <= -0.7: raising priority floor to High."


def test_edges(spark):
    got = decide(
        spark,
        (1, "Other", 0.75, 0.0),
        (2, "Other", 0.749, 0.0),
        (3, "Other", 0.9, -0.7),
        (4, "Other", 0.9, -0.69),
        (5, "Other", 0.9, 0.0, 1, 450.0, "VIP"),
        (6, "Other", 0.9, 0.0, 1, 600.0, "Returning"),
        (7, "Complaint", 0.9, 0.3),
        (8, "Complaint", 0.9, 0.31),
        (9, None),
        (10, "Other"),
    )
    assert got[1].triggered_rules == ["base_category_priority"]
    assert "low_confidence" in got[2].triggered_rules
    assert got[3].final_priority == "High" and got[4].final_priority == "Low"
    assert got[5].final_priority == "High" and got[5].decision_path == "Automated"
    assert got[6].final_priority == "Low"
    assert not got[7].conflicting_signals and got[8].conflicting_signals
    assert (got[9].final_priority, got[9].triggered_rules) == ("Medium", ["base_category_priority", "missing_classification"])
    assert vocab.NO_CONFIDENCE_RECORDED in got[10].reasons


@pytest.mark.parametrize(
    "row",
    [
        (1, "Other", 5.0),
        (1, "Other", float("nan")),
        (1, "Other", 0.9, -1.5),
        (1, "Spam", 0.9),
        (1, "Other", 0.9, 0.0, 1, -1.0),
        (1, "Other", 0.9, 0.0, 1, 1.0, "Gold"),
    ],
)
def test_invalid_input_never_automates(spark, row):
    got = decide(spark, row)[1]
    assert (got.decision_path, got.final_priority, got.recommended_action) == ("Human Review", "Medium", "HUMAN_REVIEW_STANDARD")
    assert got.triggered_rules == ["fallback_invalid_input"] and got.is_fallback and len(got.validation_errors) == 1
    assert got.reasons[0].startswith(vocab.RULE_FALLBACK_REASON)


def test_rows_without_id_stay_out_of_the_update(spark):
    frame = spark.createDataFrame([(None, "Other", 0.9, 0.0, None, None, None)], SCHEMA)
    assert decision_updates(route_tickets(frame), F.lit(None).cast("timestamp_ntz")).count() == 0


def test_all_nine_outcomes_are_kept(spark):
    frame = spark.createDataFrame([(1, "Complaint", 0.5, 0.9, None, None, "VIP"), (2, "Spam", 0.5, 0.9, None, None, "VIP")], SCHEMA)
    rows = rule_outcomes(frame).orderBy("rule_no").collect()
    assert [r.rule_name for r in rows] == list(vocab.RULE_TEXT)
    assert [r.rule_no for r in rows if r.triggered] == [1, 5, 6, 9]
    assert rows[0].priority_floor == "Urgent" and rows[1].priority_floor is None
    assert rows[3].detail == "AI classification is present."


def test_thresholds_are_parameters(spark):
    from decimal import Decimal

    from ticketloom.vocab import Thresholds

    frame = spark.createDataFrame([(1, "Other", 0.8, 0.0, None, None, None)], SCHEMA)
    strict = route_tickets(frame, Thresholds(low_confidence=Decimal("0.9"))).first()
    assert strict.decision_path == "Human Review" and "classification_confidence=0.8 < 0.9." in strict.reasons


def test_no_tickets_give_null_rates(spark):
    row = evaluation.rules_evaluation(route_tickets(spark.createDataFrame([], SCHEMA))).first()
    assert row.n_processed == 0 and row.automated_rate is None and row.fallback_frequency is None


def test_plan_has_no_shuffle_and_no_python(spark):
    frame = spark.createDataFrame([(1, "Other", 0.8, 0.0, None, None, None)], SCHEMA)
    plan = route_tickets(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_tickets_without_an_order_do_not_meet_in_one_task(spark, tmp_path):
    """In the join that decided and stored tickets are made of, with every join shuffled."""
    at = "timestamp_ntz'2024-01-05 10:00:00'"
    tables = {
        "nation": spark.range(1).selectExpr("id AS n_nationkey", "'FRANCE' AS n_name"),
        "customer": spark.range(20).selectExpr("id AS c_custkey", "concat('C', id) AS c_name", "0L AS c_nationkey"),
        "orders": spark.range(200).selectExpr("id AS o_orderkey", "id % 20 AS o_custkey", "'F' AS o_orderstatus", "id * 1000D AS o_totalprice", f"{at} AS o_orderdate"),
        "events": spark.range(200).selectExpr("id AS event_id", f"{at} AS ts", "id % 20 AS user_id", "'view' AS event_type", "'{}' AS props"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = Model(spark, str(tmp_path))._joined().select("ticket_id", "order_id", "order_value", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.ticket_id: r.order_value for r in rows} == {i: float(i) if i % 10 >= 3 else None for i in range(200)} and len(rows) == 200
    assert len({r.task for r in rows if r.order_id is None}) > 1
