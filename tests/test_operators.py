"""Numbers, joins, medians, classification, measures, quality: brute force on small frames."""

import random
import statistics
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ticketloom import vocab
from ticketloom.functions import numeric
from ticketloom.operators import classification, evaluation, measures, quality, selfcheck, views
from ticketloom.operators.joins import childless, lookup_join, orphans, owner_gate, product_names
from ticketloom.operators.medians import HUNDREDTHS, exact_medians, exact_quantiles
from ticketloom.plans.testmodel import Model


@pytest.mark.parametrize("value", [0.0, 0.9, -0.9, 450.0, 0.001, 0.0005, 0.00012, 1e-05, 2.5e-7, 1e-10, 12345678.0, 12345678.25, 1e15, 1e16, 1e22, -3.0])
def test_number_text_is_as_python_prints(spark, value):
    frame = spark.createDataFrame([(value,)], "x double")
    assert frame.selectExpr(numeric.number_text("x")).first()[0] == str(value)


@pytest.mark.parametrize("n,d,places,expected", [(1, 8, 2, "0.13"), (-1, 8, 2, "-0.13"), (2, 3, 4, "0.6667"), (5, 0, 2, None), (0, 7, 2, "0.00"), (1005, 1000, 2, "1.01")])
def test_rounding_is_half_away_from_zero(spark, n, d, places, expected):
    frame = spark.createDataFrame([(n, d)], "n bigint, d bigint")
    got = frame.selectExpr(f"CAST({numeric.half_up_ratio('n', 'd', places)} AS STRING)").first()[0]
    assert got == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_durations_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.range(1).selectExpr(
            "TIMESTAMP_NTZ'2024-03-10 01:30:00.000001' AS a", "TIMESTAMP_NTZ'2024-03-10 03:30:00.000003' AS b", "CAST(NULL AS TIMESTAMP_NTZ) AS c"
        ).selectExpr(numeric.micros_between("a", "b"), numeric.micros_between("b", "a"), numeric.micros_between("a", "c")).first()
        assert tuple(row) == (7_200_000_002, -7_200_000_002, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lookup_join_keeps_rows_and_spreads_null_keys(spark):
    rows = [(i, None if i % 3 == 0 else 7 if i % 3 == 1 else i) for i in range(3000)]
    facts = spark.createDataFrame(rows, "id bigint, k bigint")
    parents = spark.createDataFrame([(k, f"p{k}") for k in range(0, 3000, 5)] + [(7, "seven")], "k bigint, name string")
    plain = {(r.id, r.k, r.name) for r in facts.join(parents, "k", "left").collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = lookup_join(facts, parents, "k", "id")
        got = joined.collect()
        assert {(r.id, r.k, r.name) for r in got} == plain and len(got) == 3000
        sizes = joined.where("k IS NULL").groupBy(F.spark_partition_id()).count()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert lookup_join(facts, parents, "k", "id").where("k IS NULL").groupBy(F.spark_partition_id().alias("p")).count().count() == 4
        del sizes
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_owner_gate_and_orphans(spark):
    tickets = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, None, 5), (4, 99, 5)], "ticket_id bigint, order_id bigint, customer_id bigint")
    orders = spark.createDataFrame([(10, 5), (11, 6)], "order_id bigint, customer_id bigint")
    assert {r.ticket_id: r.accepted for r in owner_gate(tickets, orders).collect()} == {1: True, 2: False, 3: True, 4: False}
    assert [r.order_id for r in childless(orders, tickets, "order_id").collect()] == []
    assert sorted(r.ticket_id for r in orphans(tickets, orders, "order_id").collect()) == [3, 4]
    assert [r.ticket_id for r in orphans(tickets, orders, "order_id", null_is_orphan=False).collect()] == [4]
    assert orphans(tickets, orders, "order_id").columns == tickets.columns


def test_product_names_are_distinct_and_sorted(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (1, 3), (2, 2)], "order_id bigint, product_id bigint")
    products = spark.createDataFrame([(1, "pen"), (2, "cup"), (3, "pen")], "product_id bigint, product_name string")
    got = {r.order_id: r.product_names for r in product_names(items, products).collect()}
    assert got == {1: "cup, pen", 2: "cup"}


def test_medians_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-(10**13), 10**13) if i % 3 else 42, rng.randint(0, 9)) for i in range(2001)]
    rows += [("one", 5, None), ("none", None, None)]
    frame = spark.createDataFrame(rows, "g string, x bigint, y bigint")
    got = {r.g: (r.x2, r.y2) for r in exact_medians(frame, {"x2": "x", "y2": "y"}, ["g"]).collect()}
    for group in ("a", "b", None, "one"):
        for i, column in enumerate((1, 2)):
            values = [r[column] for r in rows if r[0] == group and r[column] is not None]
            assert got[group][i] == (2 * statistics.median(values) if values else None)
    assert "none" not in got
    empty = exact_medians(frame.where("false"), {"x2": "x"}).collect()
    assert [tuple(r) for r in empty] == [(None,)]


def test_quantiles_against_brute_force(spark):
    import numpy as np

    values = [random.Random(i).randint(0, 50000) for i in range(1003)]
    frame = spark.createDataFrame([(v,) for v in values], "x bigint")
    shares = {"p50": (1, 2), "p75": (3, 4), "p90": (9, 10), "p95": (19, 20)}
    row = exact_quantiles(frame, "x", shares, levels=HUNDREDTHS).first()
    for name, (n, d) in shares.items():
        assert row[name] == pytest.approx(float(np.percentile(values, 100 * n / d)))
    nothing = exact_quantiles(frame.where("false"), "x", shares, levels=HUNDREDTHS).collect()
    assert [tuple(r) for r in nothing] == [(0, None, None, None, None)]


CLASSIFIER = [
    ('{"category":"Other","priority":"Low","sentiment_score":0.1,"confidence":0.9}', None),
    ('{"category":"Spam","priority":"Nope","sentiment_score":0.1,"confidence":0.9}', "invalid_category"),
    ('{"category":"Other","priority":"Nope","sentiment_score":9,"confidence":0.9}', "invalid_priority"),
    ('{"category":"Other","priority":"Low","sentiment_score":0.1}', "invalid_response_schema"),
    ('{"category":"Other","priority":"Low","sentiment_score":5.0,"confidence":0.9}', "invalid_response_schema"),
    ('{"priority":"Low","sentiment_score":0.1,"confidence":0.9}', "invalid_category"),
    ('{"category":"Other","priority":"Low","sentiment_score":" -0.5 ","confidence":"1","order_id":"12"}', None),
    ('{"category":"Other","priority":"Low","sentiment_score":true,"confidence":0.9,"order_id":3.0}', None),
    ('{"category":"Other","priority":"Low","sentiment_score":0,"confidence":0.9,"order_id":3.5}', "invalid_response_schema"),
    ('{"category":"Other","priority":"Low","sentiment_score":0,"confidence":0.9,"order_id":null}', None),
    ('{"category":"Other","priority":"Low","sentiment_score":0,"confidence":0.9,"mentions_customer_info":null}', "invalid_response_schema"),
    ('{"category":"Other","priority":"Low","sentiment_score":0,"confidence":0.9,"mentions_customer_info":"yes"}', None),
    ('{"category":7,"priority":"Low","sentiment_score":0,"confidence":0.9}', "invalid_category"),
    ("[1]", "malformed_response"),
    ("oops", "malformed_response"),
    ("", "malformed_response"),
    (None, "malformed_response"),
]


def test_classifier_output(spark):
    rows = [(i, text, None) for i, (text, _) in enumerate(CLASSIFIER)] + [(99, None, "timeout")]
    checked = classification.validate_classifications(spark.createDataFrame(rows, "ticket_id bigint, tool_input_json string, error_type string"))
    got = {r.ticket_id: r for r in checked.collect()}
    for i, (_, error) in enumerate(CLASSIFIER):
        assert (got[i].error_type, got[i].success) == (error, error is None), CLASSIFIER[i]
    assert got[99].error_type == "timeout"
    assert (got[6].sentiment_score, got[6].confidence, got[6].order_id) == (-0.5, 1.0, 12)
    assert (got[7].sentiment_score, got[7].order_id) == (1.0, 3) and got[11].mentions_customer_info
    assert got[1].category is None and got[0].input_tokens == 0
    updates = classification.classification_updates(checked, F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    assert updates.count() == sum(e is None for _, e in CLASSIFIER)


def test_classifier_metrics(spark):
    pairs = [("Other", "Other")] * 3 + [("Other", "Complaint"), ("Complaint", "Complaint")]
    counted = evaluation.pair_counts(spark.createDataFrame(pairs, "t string, p string"), "t", "p")
    one = evaluation.classifier_evaluation(counted).first()
    assert (one.n_evaluated, one.accuracy) == (5, 0.8)
    assert one.macro_f1 == pytest.approx((6 / 7 + 2 / 3) / 10)
    table = evaluation.confusion_table(counted).where("truth = 'Other'").first()
    assert (table["Other"], table["Complaint"], table["Refund Request"]) == (3, 1, 0)
    with pytest.raises(PySparkException):
        evaluation.classifier_evaluation(counted.where("false")).collect()


def test_cost_needs_both_prices_and_a_success(spark):
    from decimal import Decimal

    summary = spark.createDataFrame([(1, 1000, 500)], "n_success bigint, total_input_tokens bigint, total_output_tokens bigint")
    assert evaluation.token_cost(summary, Decimal("1")).first().estimated_cost_usd is None
    assert evaluation.token_cost(summary, Decimal("1"), Decimal("2")).first().estimated_cost_usd == 0.002
    failed = summary.withColumn("n_success", F.lit(0))
    assert evaluation.token_cost(failed, Decimal("1"), Decimal("2")).first().estimated_cost_usd is None
    assert '"estimated_cost_usd":null' in evaluation.as_json(evaluation.token_cost(summary)).first().summary


def test_empty_population_is_null(spark, small):
    stored = Model(spark, small).stored_tickets().where("false")
    row = views.all_metrics(stored).first()
    assert row.classification.total_tickets == 0 and row.classification.classification_coverage_pct is None
    assert row.operational.median_resolution_hours is None and row.rule_decisions.average_priority_score is None
    shown = {r.metric: r.shown for r in selfcheck.summarize(views.all_metrics(stored)).collect()}
    assert shown["automated_rate_pct"] == "NOT AVAILABLE"


def test_zero_and_null_rates_on_an_empty_slice(spark, small):
    m = Model(spark, small)
    fact = views.ticket_fact(m.stored_tickets(), m.customers, m.orders).where("decision_path IS NULL")
    assert measures.measures(fact, empty="zero").first().automated_rate == 0.0
    assert measures.measures(fact).first().automated_rate is None


def test_few_classified_tickets_give_a_warning(spark, small):
    m = Model(spark, small)
    fact = views.ticket_fact(m.stored_tickets(), m.customers, m.orders).where("ai_predicted_category IS NOT NULL").limit(3)
    row = measures.texts(measures.measures(fact)).first()
    assert row.ai_coverage_warning.startswith("AI sample size is very small: 3 of 3 tickets.")


def test_sound_tables_have_no_routing_or_response_violations(spark, small):
    stored = Model(spark, small).stored_tickets()
    assert quality.routing_suite(stored).count() == 0
    found = {r.check_name for r in quality.response_suite(stored).collect()}
    assert found <= {"response_without_phase4_decision", "human_review_draft_without_phase4_human_review"}


BREAKS = [
    ("classification", "classified_tickets", 1, {"classification_counts", "classification_coverage_pct", "exact_category_match_rate_pct"}),
    ("classification", "low_confidence_rate_pct", 5, {"low_confidence_rate_pct"}),
    ("classification", "classification_coverage_pct", 200, {"classification_coverage_pct", "classification.classification_coverage_pct"}),
    ("rule_decisions", "automated_decisions", 7, {"rule_decision_counts", "automated_rate_pct"}),
    ("rule_decisions", "human_review_rate_pct", 3, {"human_review_rate_pct", "decision_rates_sum"}),
    ("responses", "blocked_responses", 2, {"response_status_counts", "blocked_rate_pct"}),
    ("responses", "response_not_processed", 2, {"response_processed_partition"}),
    ("operational", "median_resolution_hours", 1, {"median_resolution_hours"}),
    ("operational", "resolved_tickets", 1, {"resolved_count"}),
    ("operational", "avg_resolution_hours", -9999, {"operational.avg_resolution_hours"}),
]


def test_selfcheck_finds_each_planted_error(spark, small):
    m = Model(spark, small)
    metrics = spark.createDataFrame(views.all_metrics(m.stored_tickets()).collect())
    summary = selfcheck.fact_summary(views.ticket_fact(m.stored_tickets(), m.customers, m.orders))
    summary = spark.createDataFrame(summary.collect(), summary.schema)
    assert selfcheck.check_metrics(metrics, summary).count() == 0
    for block, field, delta, expected in BREAKS:
        changed = metrics.withColumn(block, F.col(block).withField(field, F.col(f"{block}.{field}") + delta))
        assert {r.check for r in selfcheck.check_metrics(changed, summary).collect()} == expected, field


def test_missing_views(spark, small):
    m = Model(spark, small)
    assert views.missing_views(spark, ["vw_no_such_view"]) == ["vw_no_such_view"]
    views.register_views(spark, m.stored_tickets(), m.customers, m.orders)
    assert views.missing_views(spark) == []
    imported = views.import_views(spark, {"final_priority_score": "bigint"})
    assert dict(imported["vw_ticket_analytics"].dtypes)["final_priority_score"] == "bigint"
    assert len(imported["vw_ticket_analytics"].columns) == 36


def test_vocabularies_are_closed():
    assert set(vocab.RESPONSE_TYPE_OF) == set(vocab.CATEGORIES) == set(vocab.BASE_PRIORITY)
    assert set(vocab.RESPONSE_TYPE_OF.values()) == set(vocab.RESPONSE_TYPES)


def test_every_metric_check_fires_on_its_own_error_and_on_no_sound_row(spark, small):
    m = Model(spark, small)
    metrics = views.all_metrics(m.stored_tickets())
    summary = selfcheck.fact_summary(views.ticket_fact(m.stored_tickets(), m.customers, m.orders))
    found = [(r.planted, r.fired) for r in selfcheck.planted_errors(metrics, summary).collect()]
    shares = selfcheck.percentages(metrics)
    names = {n for n, _, _ in selfcheck.metric_checks(shares)} | {c.name for c in quality.consistency_checks()}
    assert len(names) == 39 + 9 and set(selfcheck.all_errors(shares)) == names
    assert all((n, n) in found for n in names) and all(p != "none" for p, _ in found)


@pytest.mark.parametrize("text,kept", [
    ('{"a":1,"a":"two"}', "two"), ('{"a":1,"b":2,"a":null}', None), ('{"a":{"a":1},"a":[1,2]}', "[1,2]"), ('{"a":1,"a":2.50}', "2.5"), ('{"a":3,"a":true}', "true"),
])
def test_of_a_repeated_key_the_last_counts(spark, text, kept):
    from ticketloom.functions import jsonfields

    frame = spark.createDataFrame([(text,)], "t string").selectExpr(f"{jsonfields.json_object('t')} AS d")
    assert frame.selectExpr(jsonfields.get("d", "a", "string")).first()[0] == kept
    assert frame.selectExpr("d IS NULL").first()[0] is False


@pytest.mark.parametrize("text", ['{"a":1,"a":2', '{"a":1,"a":2} {"a":3}', '{"a":1,"a":2},{"a":3}', '{"a":NaN,"a":2}', '[{"a":1,"a":2}]', "{}x"])
def test_broken_texts_with_repeated_keys_stay_broken(spark, text):
    from ticketloom.functions import jsonfields

    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.selectExpr(f"{jsonfields.json_object('t')} IS NULL").first()[0] is True
