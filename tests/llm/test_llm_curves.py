"""Nearest neighbours by curves against comparing all rows."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import curves, queries

SCHEMA = "id long, v array<double>, q string, vec string, asks int, ids long, score double"


def plain(rows, asks, k):
    """Every query row against every other row."""
    fine = [
        (i, v) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    lengths = [len(v) for _, v in fine]
    dim = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if fine else 0
    fine = [(i, v) for i, v in fine if len(v) == dim]
    out = []
    for at, (i, v) in enumerate(fine):
        if asks(i):
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for other, (j, w) in enumerate(fine) if other != at)
            out += [(i, rank, j, round(d, 9)) for rank, (d, j) in enumerate(near[:k], 1)]
    return sorted(out)


def result(frame):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in frame.collect())


def test_keys_walk_through_neighbouring_cells():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(product(range(1 << bits), repeat=axes)))
        key = curves.hilbert_keys(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_codes_bring_rows_back():
    x = np.random.default_rng(1).normal(size=(50, 9)) * np.logspace(-6, 6, 50)[:, None]
    for kind, part in ((np.int8, 1 / 127), (np.int16, 1 / 32767)):
        codes, scale = curves.coded(x, np.dtype(kind))
        assert (np.abs(codes * scale[:, None] - x) <= 0.51 * part * np.abs(x).max(axis=1, keepdims=True)).all()


def test_odd_rows_copies_and_ties(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(150)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(200, 260)]  # one vector many times
    rows += [(260, [1.0, 2.0, -0.0, 0.0, 1.0]), (210, [1.0, 2.0, 0.0, 0.0, 1.0]), (211, [9.0, 9.0, 9.0, 9.0, 9.0])]  # repeated ids
    rows += [(300 + i, [float(x) for x in p] + [0.0] * 3) for i, p in enumerate(product((-1, 1), (-1, 1)))]  # equal distances
    rows += [(400, None), (401, []), (402, [0.0] * 5), (403, [1.0, None, 0.0, 0.0, 0.0]), (404, [math.nan] * 5), (405, [math.inf, 0.0, 0.0, 0.0, 0.0]), (406, [1.0]), (None, [1.0] * 5)]
    frame = spark.createDataFrame([(i, v, "q", "x", 1, 2, 0.5) for i, v in rows], SCHEMA).repartition(5)
    want = plain(rows, lambda i: i % 10 == 0, 7)
    assert result(curves.nearest(frame, "id", "v", F.col("id") % 10 == 0, k=7)) == want and len(want) > 100


def test_fewer_candidates_than_asked_for(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [3.0, 1.0])], "id int, v array<float>")
    assert result(curves.nearest(frame, "id", "v", F.col("id") == 0)) == plain([(0, [1, 0]), (5, [0, 1]), (7, [3, 1])], lambda i: i == 0, 10)
    assert result(curves.nearest(frame.where("id = 0"), "id", "v", F.lit(True))) == []
    assert result(curves.nearest(frame, "id", "v", F.lit(False))) == []
    assert result(curves.nearest(frame.where("false"), "id", "v", F.lit(True))) == []


def test_recall_where_the_windows_do_not_cover_the_table(spark):
    draw = np.random.default_rng(3)
    middle = draw.normal(size=(60, 24)) * 3
    x = middle[draw.integers(0, 60, 9000)] + draw.normal(size=(9000, 24))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    got = result(curves.nearest(frame, "id", "v", F.col("id") % 100 == 0, curves=4))
    hits = 0
    for q in range(0, 9000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = [(i, s) for a, _, i, s in got if a == q]
        assert len(mine) == 10 and all(abs(d[i] - s) < 1e-8 for i, s in mine)
        hits += len({i for i, _ in mine} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 900


def test_a_search_that_stays_poor_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(curves, "recall_of", lambda pairs, truth: 0.5)
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, v array<double>")
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        curves.nearest(frame, "id", "v", F.lit(True))


def test_query_columns(spark, small):
    assert queries.op13_nearest_neighbours(spark, small).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
