"""Metrics kept up to date by signed changes against metrics computed again."""

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import maintained, views
from ticketloom.plans.testmodel import Model


@pytest.fixture(scope="module")
def stored(spark, small):
    frame = Model(spark, small).stored_tickets()
    return spark.createDataFrame(frame.collect(), frame.schema).cache()


def plain(frame):
    return frame.first().asDict(recursive=True)


def parts(state, tmp_path, name):
    return maintained.save(state, str(tmp_path / name))


@pytest.mark.parametrize("aggregate,form", [
    ("count(1)", "coalesce(sum(sign), 0)"), ("count(x)", "coalesce(sum(IF((x) IS NULL, 0, sign)), 0)"),
    ("count_if(a = b)", "coalesce(sum(IF(a = b, sign, 0)), 0)"), ("sum(f(x))", "coalesce(sum((f(x)) * sign), 0)"), ("min(x)", None), ("max(x)", None),
])
def test_signed_forms(aggregate, form):
    assert maintained.signed(aggregate) == form
    with pytest.raises(ValueError):
        maintained.signed("stddev(x)")


def test_every_aggregate_of_the_views_has_a_form():
    for v in views.all_views().values():
        assert all(maintained.signed(a) is not None or a[:3] in ("min", "max") for a in v.aggregates.values())


def test_a_state_gives_the_views(stored):
    assert plain(maintained.metrics(maintained.state_of(stored))) == plain(views.all_metrics(stored))


def test_a_state_needs_some_columns(stored):
    names = maintained.needed(stored.columns)
    assert len(names) < len(stored.columns) and "message_text" not in names
    assert plain(maintained.metrics(maintained.state_of(stored.select(*names)))) == plain(views.all_metrics(stored))


def test_changes_additions_and_removals(stored, tmp_path):
    before = stored.where("ticket_id % 10 <> 3")
    changed = before.where("ticket_id % 4 = 1")
    new = changed.withColumns({
        "classification_confidence": F.expr("CAST(IF(ticket_id % 8 = 1, 1.000, NULL) AS DECIMAL(4,3))"),
        "ai_predicted_category": F.lit(None).cast("string"),
        "decision_path": F.lit("Human Review"), "final_priority": F.lit("Urgent"), "response_status": F.lit("BLOCKED"),
        "resolved_at": F.expr("created_at + make_interval(0, 0, 0, 0, 0, CAST(ticket_id % 50 AS INT))"),
        "first_response_at": F.lit(None).cast("timestamp_ntz"),
    })
    added, removed = stored.where("ticket_id % 10 = 3"), before.where("ticket_id % 4 = 2")
    after = before.where("ticket_id % 4 NOT IN (1, 2)").unionByName(new).unionByName(added)
    signed = [(changed, -1), (new, 1), (added, 1), (removed, -1)]
    rows = [f.withColumn("sign", F.lit(s)) for f, s in signed]
    state = parts(maintained.state_of(before), tmp_path, "before")
    for i, r in enumerate(rows):
        state = parts(maintained.merged(state, maintained.state_of(r)), tmp_path, f"step{i}")
    assert plain(maintained.metrics(state)) == plain(views.all_metrics(after))
    # Differences add up in any order, and to nothing where they undo each other.
    whole = rows[3]
    for r in (rows[1], rows[0], rows[2]):
        whole = whole.unionByName(r)
    at_once = maintained.merged(maintained.state_of(whole), maintained.state_of(before))
    assert plain(at_once.counters) == plain(state.counters) and at_once.values.exceptAll(state.values).isEmpty()
    undone = maintained.merged(state, maintained.state_of(after.withColumn("sign", F.lit(-1))))
    assert set(undone.counters.first()) == {0} and undone.values.isEmpty()


def test_no_tickets(stored):
    empty = stored.where("false")
    assert plain(maintained.metrics(maintained.state_of(empty))) == plain(views.all_metrics(empty))
