"""Arrivals: repeats, late tickets, replays, and batches that died half-way."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketloom.plans.testmodel import Model
from ticketloom.sources import store
from ticketloom.streaming import intake

AT = datetime(2024, 6, 1, 12)


@pytest.fixture
def world(spark, small, tmp_path):
    m = Model(spark, small)
    sent = m.tickets.withColumn("sent_at", F.col("created_at")).withColumns(
        {c: F.lit(None).cast(t) for c, t in (("final_priority", "string"), ("rule_decision_at", "timestamp_ntz"))}
    ).cache()
    table, root = str(tmp_path / "table"), str(tmp_path / "intake")
    store.create(sent.drop("sent_at"), table, "loaded", ids_per_part=100)

    def take(rows, batch_id, **more):
        intake.take_batch(rows, batch_id, m.customers, m.orders, root, "2 DAY", table=table, run_at=AT, **more)

    return spark, sent, table, root, take


def decided(spark, table):
    return {r.ticket_id for r in store.read(spark, table).where("decision_path IS NOT NULL").collect()}


def test_repeats_within_the_delay_and_late_tickets(world):
    spark, sent, table, root, take = world
    early, later = sent.where("day(created_at) <= 10"), sent.where("day(created_at) BETWEEN 11 AND 20")
    newest = early.agg(F.max("sent_at")).first()[0]
    take(early.union(early.where("ticket_id % 3 = 0")), 0)
    late = sent.where("day(created_at) > 20 AND ticket_id % 5 = 0").withColumn("sent_at", F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 49 HOUR"))
    timeless = sent.where("day(created_at) > 20 AND ticket_id % 5 = 1").withColumn("sent_at", F.lit(None).cast("timestamp_ntz"))
    recent = early.where(F.col("sent_at") >= F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 2 DAY"))
    take(later.unionByName(late).unionByName(timeless).unionByName(recent), 1)
    assert decided(spark, table) == {r.ticket_id for r in early.union(later).collect()}
    out = {r.ticket_id for r in spark.read.schema(sent.schema).parquet(f"{root}/late/1").collect()}
    assert out == {r.ticket_id for r in late.union(timeless).collect()}
    rows = {r.batch_id: r for r in intake.ledger(spark, root).collect()}
    assert rows[0].repeated == early.where("ticket_id % 3 = 0").count() and rows[0].decided == early.count()
    assert (rows[1].late, rows[1].repeated, rows[1].decided) == (len(out), recent.count(), later.count())


def test_a_replayed_batch_changes_nothing(world):
    spark, sent, table, root, take = world
    take(sent.where("ticket_id % 2 = 0"), 0)
    before, version = decided(spark, table), store.current(spark, table)
    take(sent.where("ticket_id % 2 = 0"), 0)
    take(sent, 0)
    assert decided(spark, table) == before and store.current(spark, table) == version
    assert intake.ledger(spark, root).count() == 1


@pytest.mark.parametrize("step", ["late", "decisions", "write_back", "ledger"])
def test_a_batch_that_died_is_done_again(world, monkeypatch, step):
    spark, sent, table, root, take = world
    first, second = sent.where("day(created_at) <= 15"), sent.where("day(created_at) BETWEEN 14 AND 28")
    newest = first.agg(F.max("sent_at")).first()[0]
    second = second.where(F.col("sent_at") >= F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY"))
    take(first, 0)
    kept, back = intake._kept, store.write_back

    class Died(Exception):
        pass

    def dying_kept(frame, path):
        if f"/{step}/" in path:
            raise Died
        return kept(frame, path)

    def dying_back(*a):
        if step == "ledger":  # after the write-back
            back(*a)
        raise Died

    with monkeypatch.context() as patch:
        patch.setattr(intake, "_kept", dying_kept)
        if step in ("write_back", "ledger"):
            patch.setattr(intake.store, "write_back", dying_back)
        with pytest.raises(Died):
            take(second, 1)
    assert intake.ledger(spark, root).count() == 1
    take(second, 1)
    assert decided(spark, table) == {r.ticket_id for r in first.union(second).collect()}
    assert {r.batch_id: r.decided for r in intake.ledger(spark, root).collect()}[1] == second.join(first, "ticket_id", "left_anti").count()


def test_library_streams_do_not_know_the_test_model():
    import ticketloom.streaming.route as route

    for module in (route, intake):
        assert "testmodel" not in open(module.__file__).read()
