from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketloom import schemas
from ticketloom.operators import responses, views
from ticketloom.plans import runs
from ticketloom.plans.queries import QUERIES
from ticketloom.plans.testmodel import Model
from ticketloom.sources import audit, picks, scoring, snapshots, tables


def at():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")



def test_csv_reads_with_types_and_empty_as_null(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(
        "customer_id,first_name,last_name,email,phone,signup_date,customer_segment,country,is_active\n"
        '1,Ann,"O, Neil",a@x.org,,2024-01-02,VIP,Chad,True\n'
    )
    frame = tables.read_csv(spark, str(tmp_path / "customers.csv"), "customers")
    row = frame.first()
    assert row.phone is None and row.last_name == "O, Neil" and row.is_active is True
    assert [f.dataType for f in frame.schema] == [f.dataType for f in schemas.CUSTOMERS]


def test_csv_field_with_a_line_break(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(
        "customer_id,first_name,last_name,email,phone,signup_date,customer_segment,country,is_active\n"
        '1,Ann,"O\nNeil",a@x.org,,2024-01-02,VIP,Chad,True\n'
    )
    assert tables.read_csv(spark, str(tmp_path / "customers.csv"), "customers", line_breaks=True).first().last_name == "O\nNeil"


def test_csv_fails_on_a_bad_row(spark, tmp_path):
    (tmp_path / "products.csv").write_text("product_id,product_name,category,sku,price,stock_quantity,is_active\nx,a,b,c,1.5,2,True\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "products.csv"), "products").collect()


def tickets(spark):
    return spark.createDataFrame(
        [(1, "a", "Low", None, datetime(2024, 1, 1)), (2, "b", "High", "Automated", datetime(2024, 1, 1))],
        "ticket_id bigint, category string, priority string, decision_path string, updated_at timestamp_ntz",
    )


def test_overlay_changes_only_owned_columns(spark):
    updates = spark.createDataFrame([(2, None), (3, "Human Review")], "ticket_id bigint, decision_path string")
    got = {r.ticket_id: r for r in snapshots.apply_overlay(tickets(spark), updates, ["decision_path"], at()).collect()}
    assert set(got) == {1, 2} and got[2].decision_path is None and got[2].updated_at == datetime(2024, 6, 1, 12)
    assert got[1].updated_at == datetime(2024, 1, 1) and got[2].priority == "High"
    with pytest.raises(ValueError):
        snapshots.apply_overlay(tickets(spark), updates.withColumn("priority", F.lit("x")), ["decision_path"], at())


@pytest.mark.parametrize("config_live,live", [(False, False), (True, False), (False, True)])
def test_dry_run_writes_nothing(spark, tmp_path, config_live, live):
    snapshots.publish(tickets(spark), str(tmp_path / "t"), "v1", config_live=config_live, live=live)
    assert not (tmp_path / "t").exists()


def test_publish_and_failed_reload(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.publish(tickets(spark), root, "v1", config_live=True, live=True)
    assert snapshots.read_current(spark, root).count() == 2
    next_version = snapshots.read_current(spark, root).where("ticket_id = 1")
    snapshots.publish(next_version, root, "v2", config_live=True, live=True)
    assert snapshots.read_current(spark, root).count() == 1

    def reject(staged):
        return staged["tickets"].where("true")

    base = str(tmp_path / "all")
    snapshots.reload_tables(spark, {"tickets": tickets(spark)}, base, "a", lambda s: s["tickets"].where("false"))
    with pytest.raises(ValueError):
        snapshots.reload_tables(spark, {"tickets": tickets(spark).limit(1)}, base, "b", reject)
    assert snapshots.read_tables(spark, base, ["tickets"])["tickets"].count() == 2


def test_a_taken_version_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.publish(tickets(spark), root, "v1", config_live=True, live=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        snapshots.publish(snapshots.read_current(spark, root).limit(1), root, "v1", config_live=True, live=True)
    assert snapshots.read_current(spark, root).count() == 2


def test_reload_that_dies_between_tables_changes_none(spark, tmp_path):
    base = str(tmp_path / "r")
    both = {"a": tickets(spark), "b": tickets(spark)}
    snapshots.reload_tables(spark, both, base, "v1")
    snapshots.stage_snapshot(tickets(spark), f"{base}/b", "v2")  # makes the second table's stage fail
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        snapshots.reload_tables(spark, {n: t.limit(1) for n, t in both.items()}, base, "v2")
    assert {n: t.count() for n, t in snapshots.read_tables(spark, base, ["a", "b"]).items()} == {"a": 2, "b": 2}


def test_repeated_updates_add_no_rows(spark):
    updates = spark.createDataFrame([(1, "Human Review"), (1, "Automated"), (1, None)], "ticket_id long, decision_path string")
    got = snapshots.apply_overlay(tickets(spark), updates, ["decision_path"], at()).collect()
    assert len(got) == 2 and [r.decision_path for r in got if r.ticket_id == 1] == ["Human Review"]


def test_audit_file_has_no_text(spark, tmp_path, small):
    m = Model(spark, small)
    decided = responses.decide_responses(m.decided_tickets())
    audit.write_events(audit.response_events(decided, dry_run=True), str(tmp_path / "log"), "2024-06-01")
    back = spark.read.json(str(tmp_path / "log"))
    assert not {"message_text", "response_draft", "email", "customer_id", "rationale"} & set(back.columns)
    assert back.count() == decided.count() and {"event", "run_date"} <= set(back.columns)


def test_secrets_are_redacted(spark):
    frame = spark.createDataFrame([("key sk-1 failed",)], "m string")
    assert frame.select(audit.redact(F.col("m"), ["sk-1", ""])).first()[0] == "key [REDACTED] failed"


def test_contexts_hold_no_personal_data(spark, small):
    m = Model(spark, small)
    rules = picks.rules_context(m.tickets, m.customers, m.orders)
    answers = picks.response_context(m.stored_tickets(), m.customers, m.orders, m.order_items, m.products)
    for frame in (rules, answers):
        assert not {"customer_id", "email", "phone", "first_name", "last_name", "payment_method", "total_amount", "priority"} & set(frame.columns)
    assert "order_value" not in answers.columns


def drafting():
    """A scorer factory defined inside a function, so that it travels to the workers by value."""

    def make():
        import json

        def score(prompts):
            for p in prompts:
                if "error" in p:
                    yield {"error_type": "timeout"}
                else:
                    yield {"tool_input_json": json.dumps({"can_generate": True, "draft_text": "We look into it."}), "input_tokens": 3}

        return score

    return make


def classifying():
    def make():
        import json

        good = {"category": "Other", "priority": "Low", "sentiment_score": 0.1, "confidence": 0.9}

        def score(prompts):
            for p in prompts:
                answer = good if "error" not in p else {"category": "Spam"}
                yield {"tool_input_json": json.dumps(answer), "input_tokens": 5, "output_tokens": 2}

        return score

    return make


def test_model_call_stage(spark):
    prompts = spark.createDataFrame([(1, "hi", "x"), (2, "an error", "y")], "ticket_id bigint, prompt string, extra string")
    got = {r.ticket_id: r for r in scoring.score_batches(prompts, drafting(), ["extra"]).collect()}
    assert got[2].error_type == "timeout" and got[1].input_tokens == 3 and got[1].extra == "x" and got[1].model is None


def test_whole_runs(spark, small, tmp_path):
    """Route, respond and classify as runs: dry runs write nothing, live ones publish and log."""
    m = Model(spark, small)
    before = m.decided_tickets().withColumns(
        {c: F.lit(None).cast("timestamp_ntz" if c.endswith("_at") else "string")
         for c in ("response_status", "response_type", "response_draft", "response_generated_at")}
    )
    parts = dict(customers=m.customers, orders=m.orders, items=m.order_items, products=m.products)
    dry = runs.run_rules(before, m.customers, m.orders, run_at=at())
    undecided = before.where("decision_path IS NULL").count()
    assert dry.decided.count() == undecided and dry.summary.first().tickets_processed == undecided
    live = runs.publish_run(dry, before, str(tmp_path / "t"), "v1", str(tmp_path / "log"), "2024-06-01", config_live=True, live=True)
    assert live.where("decision_path IS NULL").count() == 0
    assert spark.read.json(str(tmp_path / "log")).count() == undecided

    answered = runs.run_responses(live, **parts, run_at=at(), make_scorer=drafting(), scratch=str(tmp_path / "scores"))
    total = live.count()
    assert answered.summary.first().tickets_processed == total
    assert answered.evaluation.first().draft_generation_success_rate > 0
    kept = runs.run_rules(before, m.customers, m.orders, run_at=at(), stage=str(tmp_path / "decided"))
    assert kept.updates.exceptAll(dry.updates).isEmpty() and kept.decided.count() == undecided
    for _ in range(2):  # a repeated dry run replaces its own events
        runs.publish_run(kept, before, str(tmp_path / "t"), "v9", str(tmp_path / "dry"), "2024-06-01", config_live=True, live=False)
        assert spark.read.json(str(tmp_path / "dry")).where("run_id = 'v9-dry' AND dry_run").count() == undecided
    none = runs.run_responses(live, **parts, run_at=at(), limit=5)
    assert none.decided.count() == 5 and none.evaluation.first().draft_generation_attempted == 0
    after = runs.publish_run(answered, live, str(tmp_path / "t"), "v2", str(tmp_path / "log"), "2024-06-01", config_live=True, live=True)
    assert after.where("response_status IS NULL").count() == 0
    assert after.columns == live.columns

    called = runs.run_classify(before, run_at=at(), make_scorer=classifying(), scratch=str(tmp_path / "calls"), limit=20)
    row = called.summary.first()
    assert row.tickets_attempted == 20 and row.n_success + row.n_failed == 20


def test_view_export(spark, small, tmp_path):
    m = Model(spark, small)
    views.register_views(spark, m.stored_tickets(), m.customers, m.orders)
    views.export_views(spark, str(tmp_path))
    back = spark.read.option("header", True).csv(str(tmp_path / "vw_ticket_analytics"))
    assert len(back.columns) == 36 and back.count() == m.tickets.count()


def test_stream_equals_batch(spark, small):
    batch = QUERIES["route_decisions"](spark, small)
    stream = QUERIES["stream_route"](spark, small)
    assert sorted(map(str, batch.collect())) == sorted(map(str, stream.collect()))


def test_stream_takes_new_files_once(spark, small, tmp_path):
    from ticketloom.streaming.route import start_routing

    m = Model(spark, small)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    events = m.raw("events")
    for i in range(2):
        events.where(f"event_id % 2 = {i}").coalesce(1).write.mode("append").parquet(source)
        stream = m.tickets_from(spark.readStream.schema(events.schema).parquet(source))
        start_routing(stream, m.customers, m.orders, out, check).awaitTermination()
    assert spark.read.parquet(out).count() == events.count() == spark.read.parquet(out).select("ticket_id").distinct().count()




def test_load_counts_in_the_pass_that_writes_and_can_be_repeated(spark, small, tmp_path):
    from ticketloom.operators import quality

    m, root = Model(spark, small), str(tmp_path / "load")
    sound = {"customers": m.customers, "products": m.products}
    checks = {t: quality.constraint_checks(t, df.columns) for t, df in sound.items()}
    loaded = snapshots.load_checked(spark, sound, root, "a", checks)
    assert loaded.counts["customers"]["rows"] == m.customers.count() and loaded.failures() == {}
    broken = {t: m.broken_tables[t] for t in sound}
    with pytest.raises(snapshots.LoadRefused) as refused:
        snapshots.load_checked(spark, broken, root, "b", checks)
    want = {r.check_name: r["count"] for r in quality.constraints_suite(broken).groupBy("check_name").count().collect()}
    assert {n: k for own in refused.value.failures.values() for n, k in own.items()} == want
    assert snapshots.current_version(spark, root) == "a" and not (tmp_path / "load" / "customers" / "snapshot=b").exists()
    snapshots.stage_snapshot(m.customers.limit(1), f"{root}/customers", "b")  # what an attempt that died left
    again = snapshots.load_checked(spark, sound, root, "b", checks, between=lambda t: quality.duplicates(t["customers"], "dupes", ["customer_id"]))
    assert again.tables["customers"].count() == m.customers.count() and snapshots.current_version(spark, root) == "b"
    with pytest.raises(snapshots.LoadRefused):
        snapshots.load_checked(spark, sound, root, "c", checks, between=lambda t: quality.duplicates(t["customers"], "segments", ["customer_segment"]))
    with pytest.raises(ValueError):
        snapshots.load_checked(spark, sound, root, "a", checks)
    assert snapshots.current_version(spark, root) == "b"


def test_long_csv_reads_what_the_plain_reader_reads(spark, tmp_path):
    """Fields with line breaks, quotes, carriage returns and blank lines, cut into splits of a few hundred bytes."""
    import csv
    import random

    from ticketloom.sources import longcsv

    draw = random.Random(9)
    names = schemas.CUSTOMERS.names
    folder = tmp_path / "customers"
    folder.mkdir()
    pieces = ["O", ", ", '"', "\n", "\n\n", "a\r\nb", "Neil", " x", "é"]
    for part in range(3):
        with open(folder / f"{part}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if part == 1 else "\n")
            writer.writerow(names)
            for i in range(60):
                last = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 9))) + "z" + ("\nlong" * 300 if i == 30 else "")
                writer.writerow([part * 100 + i, "Ann", last, f"{i}@x.org", "", "2024-01-02", "VIP", "Chad", "true"])
                if i % 20 == 0:
                    out.write("\n")
    plain = tables.read_csv(spark, str(folder), "customers", line_breaks=True)
    # The plain reader writes line breaks inside fields as it finds them between records; this one leaves fields as they are.
    same = F.replace("last_name", F.lit("\r\n"), F.lit("\n")).alias("last_name")
    want = sorted(map(str, plain.withColumn("last_name", same).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = longcsv.read_long_csv(spark, str(folder), "customers")
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 30
        assert sorted(map(str, got.withColumn("last_name", same).collect())) == want and len(want) == 180
        assert got.schema == plain.schema
        (folder / "9.csv").write_text(",".join(names) + '\n1,Ann,"open,a,,2024-01-02,VIP,Chad,true\n')
        with pytest.raises(Exception, match="not closed"):
            longcsv.read_long_csv(spark, str(folder), "customers").collect()
        (folder / "9.csv").write_text("a,b\n1,2\n")
        with pytest.raises(Exception, match="header"):
            longcsv.read_long_csv(spark, str(folder), "customers").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_loads_behind_the_gate_keep_what_it_stops(spark, small, tmp_path):
    m = Model(spark, small)
    tables_ = {"orders": m.orders, "tickets": m.gated_tickets}
    loaded = snapshots.reload_tables(spark, tables_, str(tmp_path / "a"), "v1", gate=True)
    total = m.gated_tickets.count()
    assert loaded["tickets"].count() + loaded["tickets_quarantine"].count() == total and not loaded["tickets_quarantine"].isEmpty()
    assert {r.reason for r in loaded["tickets_quarantine"].select("reason").distinct().collect()} <= {"order_of_other_customer", "no_such_order"}
    again = snapshots.load_checked(spark, {"orders": m.orders, "tickets": loaded["tickets"]}, str(tmp_path / "b"), "v1", {}, gate=True)
    assert again.counts["tickets_quarantine"]["rows"] == 0 and again.tables["tickets"].count() == loaded["tickets"].count()
