"""Quantile sketches and bitmaps that merge, against exact answers."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import bitmaps, measures, quality, sketches


@pytest.fixture(scope="module")
def fact(spark):
    """One channel holds most rows, one value half of those; one channel has no resolution at all."""
    draw, rows = random.Random(8), []
    for i in range(20_000):
        channel = "hot" if i % 10 else draw.choice(["a", "b", "none"])
        hours = None if channel == "none" else 7.25 if i % 2 else round(draw.expovariate(0.01), 2)
        rows.append((i, channel, datetime(2024, 1, 1) + timedelta(minutes=i * 3), round(draw.uniform(0, 500), 2), hours))
    schema = "ticket_id long, channel string, created_at timestamp_ntz, first_response_minutes double, resolution_hours double"
    return spark.createDataFrame(rows, schema).repartition(6).cache()


def ranks(values, x):
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


@pytest.mark.parametrize("size", [100, 800])
def test_medians_of_merged_days(fact, size):
    days = sketches.daily_sketches(fact, size=size).cache()
    got = {r.channel: r for r in sketches.median_measures(days.where("created_date < DATE'2024-01-20'"), ["channel"]).collect()}
    bound = 3 * sketches.rank_error(size)
    rows = fact.where("created_at < TIMESTAMP_NTZ'2024-01-20 00:00:00'").collect()
    for channel in ("hot", "a", "b", "none"):
        own = [r for r in rows if r.channel == channel]
        assert got[channel].total_tickets == len(own)
        for name, column in measures.MEDIANS:
            values = [round(r[column] * 100) for r in own if r[column] is not None]
            if not values:
                assert got[channel][name] is None
                continue
            below, upto = ranks(values, round(got[channel][name] * 100))
            assert below <= 0.5 + bound and upto >= 0.5 - bound


def test_merging_in_parts_counts_all_rows_and_empty_slices_are_null(fact):
    days = sketches.daily_sketches(fact)
    whole = sketches.merged(sketches.merged(days, ["channel"])).first()
    assert whole.rows == fact.count()
    none = sketches.median_measures(days.where("false")).first()
    assert none.total_tickets == 0 and none.median_resolution_hours is None
    assert sketches.rank_error(800) < 0.004 < sketches.rank_error(200) < 0.014


def test_approx_option_has_the_columns_of_the_exact_one(fact):
    exact, approx = measures.median_measures(fact, ["channel"]), measures.median_measures(fact, ["channel"], approx=True)
    assert exact.columns == approx.columns
    assert dict(exact.select("channel", "total_tickets").collect()) == dict(approx.select("channel", "total_tickets").collect())


KEYS = [*range(-40, 40), 32768, 32769, 32767, -32768, -32769, 10**12, 10**12 + 1, 5, 5, 5, 10**12, -7, None, None]


def test_bitmaps_count_each_key_once(spark):
    frame = spark.createDataFrame([(k, i % 2) for i, k in enumerate(KEYS)], "k long, g int").repartition(4)
    one = bitmaps.distinct_counts(bitmaps.bitmaps(frame, "k")).first()
    known = [k for k in KEYS if k is not None]
    assert (one.rows, one.keys) == (len(known), len(set(known)))
    halves = bitmaps.bitmaps(frame, "k", ["g"])
    both = bitmaps.distinct_counts(bitmaps.merged(halves)).first()
    assert (both.rows, both.keys) == (len(known), len(set(known)))
    assert bitmaps.distinct_counts(bitmaps.bitmaps(frame.where("false"), "k")).first().keys == 0
    repeated = {r.key: r.n for r in bitmaps.repeated_keys(frame, "k").collect()}
    assert repeated == {k: n for k, n in Counter(KEYS).items() if n > 1}


def test_grain_by_bitmaps_finds_what_the_grouping_finds(spark):
    tickets = spark.createDataFrame([(i,) for i in range(100)], "ticket_id long")
    fact = tickets.where("ticket_id % 9 <> 0").union(tickets.where("ticket_id IN (4, 5, 5, 70)")).union(spark.createDataFrame([(None,), (None,)], "ticket_id long"))
    for seen in (fact, tickets, fact.where("false")):
        want = sorted(map(str, quality.view_grain(seen, tickets).collect()))
        assert sorted(map(str, bitmaps.fact_grain(seen, tickets).collect())) == want
