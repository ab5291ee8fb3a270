"""The gate, settled updates, and write-backs that rewrite only the ranges they touch."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketloom.operators.joins import quarantine_reasons, split_by_owner
from ticketloom.plans import runs
from ticketloom.plans.testmodel import Model
from ticketloom.sources import snapshots, store

OWNED = ["decision_path", "rule_decision_at"]


def run_at():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


@pytest.fixture
def tickets(spark):
    rows = [(i, 100 + i % 3, None if i % 5 == 0 else i, None, None, datetime(2024, 1, 1)) for i in range(50)]
    return spark.createDataFrame(rows, "ticket_id long, customer_id long, order_id long, decision_path string, rule_decision_at timestamp_ntz, updated_at timestamp_ntz")


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(i, 100 + i % 3) for i in range(45)] + [(3, 100), (7, 999), (13, 100)], "order_id long, customer_id long")


def updates(spark, *rows):
    return spark.createDataFrame([(i, p, None) for i, p in rows], "ticket_id long, decision_path string, rule_decision_at timestamp_ntz")


def files(root: str) -> dict[str, int]:
    return {str(f): f.stat().st_mtime_ns for f in Path(root).rglob("data/*/_part=*/*.parquet")}


def test_split_has_each_ticket_once(spark, tickets, orders):
    gated = split_by_owner(tickets, orders.union(orders))
    accepted, stopped = ([r.ticket_id for r in f.collect()] for f in (gated.accepted, gated.quarantine))
    assert sorted(accepted + stopped) == list(range(50)) and sorted(stopped) == [46, 47, 48, 49]
    foreign = tickets.withColumn("customer_id", F.when(F.col("ticket_id") == 4, None).when(F.col("ticket_id") == 6, 5).otherwise(F.col("customer_id")))
    reasons = quarantine_reasons(split_by_owner(foreign, orders).quarantine, orders)
    assert {r.ticket_id: r.reason for r in reasons.collect()} == {
        4: "order_of_other_customer", 6: "order_of_other_customer", **dict.fromkeys((46, 47, 48, 49), "no_such_order"),
    }
    assert split_by_owner(tickets.where("false"), orders).accepted.isEmpty()


def test_updates_that_contradict_each_other_are_not_settled(spark, tickets):
    made = updates(spark, (1, "Automated"), (1, "Automated"), (2, "Automated"), (2, None), (3, "Human Review"), (None, "Automated"))
    settled = snapshots.settle(made, OWNED)
    assert sorted((r.ticket_id, r._new.decision_path) for r in settled.clean.collect()) == [(1, "Automated"), (3, "Human Review")]
    clash = settled.clashing.collect()
    assert [(r.ticket_id, r.n, r.least, r.greatest) for r in clash] == [(2, 2, "{}", '{"decision_path":"Automated"}')]
    done = {r.ticket_id: r.decision_path for r in snapshots.apply_overlay(tickets, made, OWNED, run_at(), clashing="leave").collect()}
    assert len(done) == 50 and done[2] is None and done[1] == "Automated"


def test_the_gate_holds_for_an_overlay(spark, tickets, orders):
    made = updates(spark, (46, "Automated"), (45, "Automated"), (44, "Automated"))
    done = {r.ticket_id: r.decision_path for r in snapshots.apply_overlay(tickets, made, OWNED, run_at(), orders).collect()}
    assert (done[46], done[45], done[44], len(done)) == (None, "Automated", "Automated", 50)


def test_untouched_ranges_keep_their_files(spark, tickets, orders, tmp_path):
    root = str(tmp_path / "t")
    store.create(tickets, root, "loaded", ids_per_part=10)
    before = files(root)
    assert len(before) == 5
    made = updates(spark, (3, "Automated"), (4, "Human Review"), (23, "Automated"), (23, "Human Review"), (77, "Automated"), (None, "x"), (48, "Automated"))
    done = store.write_back(spark, root, made, OWNED, run_at(), "decided", orders)
    assert done.rewritten == [0] and done.version.number == 2
    after = files(root)
    assert {f: t for f, t in after.items() if f in before} == before and len(after) == 6
    assert {(r.ticket_id, r.reason) for r in done.rejected.collect()} == {
        (23, "clashing_updates"), (77, "no_such_ticket"), (None, "no_ticket_id"), (48, "no_such_order"),
    }
    rows = {r.ticket_id: r for r in store.read(spark, root).collect()}
    assert len(rows) == 50 and {i: r.decision_path for i, r in rows.items() if r.decision_path} == {3: "Automated", 4: "Human Review"}
    assert rows[3].updated_at == datetime(2024, 6, 1, 12) and rows[5].updated_at == datetime(2024, 1, 1)
    assert store.read(spark, root).columns == tickets.columns
    assert [r.ticket_id for r in store.read(spark, root, parts=[2]).orderBy("ticket_id").collect()] == list(range(20, 30))
    # A second write-back goes by the state that the first one left.
    again = store.write_back(spark, root, updates(spark, (4, None), (49, "Automated")), OWNED, run_at(), "third")
    assert again.rewritten == [0, 4]
    assert {r.ticket_id for r in store.read(spark, root).where("decision_path IS NOT NULL").collect()} == {3, 49}


def test_names_numbers_and_dead_attempts(spark, tickets, tmp_path):
    root = str(tmp_path / "t")
    store.create(tickets, root, "loaded", ids_per_part=20)
    with pytest.raises(store.VersionTaken):
        store.create(tickets, root, "again")
    with pytest.raises(store.VersionTaken):
        store.write_back(spark, root, updates(spark, (1, "Automated")), OWNED, run_at(), "loaded")
    (tmp_path / "t" / "claims" / "2").touch()  # another writer, which then dies
    with pytest.raises(store.VersionTaken):
        store.write_back(spark, root, updates(spark, (1, "Automated")), OWNED, run_at(), "decided")
    assert store.read(spark, root).where("decision_path IS NOT NULL").isEmpty()
    assert store.release_claims(spark, root) == [2]
    assert store.write_back(spark, root, updates(spark, (1, "Automated")), OWNED, run_at(), "decided").version.number == 2
    nothing = store.write_back(spark, root, updates(spark, (99, "Automated")), OWNED, run_at(), "nothing")
    assert nothing.rewritten == [] and nothing.version.number == 2 and nothing.rejected.count() == 1
    with pytest.raises(ValueError):
        store.write_back(spark, root, updates(spark, (1, "x")).withColumn("priority", F.lit("x")), OWNED, run_at(), "more")
    with pytest.raises(ValueError):
        store.create(tickets.where("false"), str(tmp_path / "none"), "loaded")


def test_a_run_published_in_place(spark, small, tmp_path):
    m = Model(spark, small)
    root, log = str(tmp_path / "t"), str(tmp_path / "log")
    store.create(m.gated_tickets, root, "loaded", ids_per_part=100)
    run = runs.run_rules(store.read(spark, root), m.customers, m.orders, run_at=run_at(), limit=40)
    assert runs.publish_run_in_place(run, spark, root, "v2", log, "2024-06-01", config_live=True, live=False, orders=m.orders) is None
    assert store.current(spark, root).number == 1
    done = runs.publish_run_in_place(run, spark, root, "v2", log, "2024-06-01", config_live=True, live=True, orders=m.orders)
    decided = store.read(spark, root).where("final_priority IS NOT NULL").count()
    assert decided + done.rejected.count() == run.updates.where("ticket_id IS NOT NULL").count() and 0 < decided
    assert len(done.rewritten) < len(done.version.parts)
    assert spark.read.json(log).count() == 40 * 2


def test_changes_are_joined_once_and_kept(spark, tickets, tmp_path):
    root = str(tmp_path / "t")
    store.create(tickets, root, "loaded", ids_per_part=10)
    done = store.write_back(spark, root, updates(spark, (3, "Automated"), (4, None), (23, "Human Review")), OWNED, run_at(), "decided")
    old, new = (store.read(spark, root, v).where("ticket_id IN (3, 4, 23)").withColumn("sign", F.lit(s)) for v, s in ((done.before, -1), (done.version, 1)))
    changed = store.changes(spark, root, done)
    assert changed.columns == [*tickets.columns, "sign"] and sorted(map(str, changed.collect())) == sorted(map(str, old.union(new).collect()))
    # What is computed from the changes reads neither version again.
    assert changed.inputFiles() and not any("/data/" in f for f in changed.inputFiles())
    some = store.changes(spark, root, done, ["decision_path", "order_id"])
    assert some.columns == ["decision_path", "order_id", "sign"]
    assert sorted(map(str, some.collect())) == sorted(map(str, changed.select(*some.columns).collect()))
    nothing = store.write_back(spark, root, updates(spark, (99, "Automated")), OWNED, run_at(), "nothing")
    assert store.changes(spark, root, nothing, ["decision_path"]).columns == ["decision_path", "sign"] and store.changes(spark, root, nothing).isEmpty()


def test_a_rewrite_shuffles_the_table_once(spark, tickets):
    twice = tickets.union(tickets.where("ticket_id % 7 = 3"))
    settled = snapshots.settle(updates(spark, (3, "Automated"), (4, None), (23, "Human Review"), (23, "Human Review")), OWNED).clean
    rows = store._rewritten(twice, settled, OWNED, run_at(), 10)
    expected = snapshots.overlaid(twice, settled, OWNED, run_at())
    assert rows.columns == [*expected.columns, store.PART]
    assert sorted(map(str, rows.drop(store.PART).collect())) == sorted(map(str, expected.collect()))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(_part") == 1
