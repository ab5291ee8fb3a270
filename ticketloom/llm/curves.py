"""Nearest neighbours by shifted space-filling curves.

Every vector gets a place on several Hilbert curves, each over another random
projection with another shift. The rows of each curve are range-partitioned by
their key and packed into short blocks; a query looks at the blocks within a
window around its own on every curve, the finds of all curves merge, and the
best of them are compared again on the original vectors.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import column, stored
from ticketloom.llm.nndescent import usable

AXES, BITS = 8, 7
#: Rows of a packed block; blocks that one task searches at a time.
BLOCK, SPAN = 256, 256
LEAST_WINDOW = 4
ATTEMPTS = 3
BLOCKS = "curve int, part int, seq int, n int, ids binary, asks binary, scales binary, codes binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer cells (rows, axes); axes * bits must stay below 63."""
    x = cells.astype(np.int64)
    axes = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(axes):
            set_ = (x[:, i] & bit) != 0
            swapped = (x[:, 0] ^ x[:, i]) & low
            x[:, 0] ^= np.where(set_, low, swapped)
            x[:, i] ^= np.where(set_, 0, swapped)
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turned = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((x[:, -1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turned[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


@dataclass
class Curves:
    """Projections, shifts and cell sizes of the curves, fitted on a sample."""

    centre: np.ndarray
    axes: np.ndarray
    low: np.ndarray
    width: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, curves: int, seed: int) -> Curves:
        """Random orthonormal axes; cells reach from three deviations below the middle, less a random shift, to three above."""
        draw = np.random.default_rng(seed)
        dim = sample.shape[1]
        m = min(AXES, dim)
        centre = np.median(sample, axis=0)
        axes = np.stack([np.linalg.qr(draw.normal(size=(dim, dim)))[0][:, :m] for _ in range(curves)])
        placed = (sample - centre) @ axes
        spread = np.maximum(placed.std(axis=1), 1e-300)
        shift = draw.random(spread.shape)
        return cls(centre, axes, placed.mean(axis=1) - (3 + shift) * spread, (7 * spread) / (1 << BITS))

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        """Keys of centred rows on one curve; what lies outside the cells goes to the nearest one."""
        cells = np.clip(np.floor((x @ self.axes[curve] - self.low[curve]) / self.width[curve]), 0, (1 << BITS) - 1)
        return hilbert_keys(cells, BITS)


def matrix(column_: pa.Array, dim: int) -> np.ndarray:
    return column_.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def coded(x: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows as whole numbers and the factor that brings each back."""
    most = np.iinfo(kind).max
    scale = np.abs(x).max(axis=1) / most
    scale[scale == 0] = 1
    return np.rint(x / scale[:, None]).astype(kind), scale


def places(batches: Iterator[pa.RecordBatch], curves: Curves, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """One row per vector and curve: its key, and its code."""
    dim = len(curves.centre)
    for batch in batches:
        if not len(batch):
            continue
        x = matrix(batch.column("vec"), dim) - curves.centre
        codes, scale = coded(x, kind)
        data = np.ascontiguousarray(codes).tobytes()
        wide = dim * np.dtype(kind).itemsize
        code = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, len(data) + 1, wide, np.int32)), pa.py_buffer(data)])
        for c in range(len(curves.axes)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), c, np.int32)), pa.array(curves.keys(x, c)), batch.column("cls"), batch.column("asks"), pa.array(scale), code],
                names=["curve", "key", "cls", "asks", "scale", "code"],
            )


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a partition as blocks of neighbours on one curve."""
    part, seq = TaskContext.get().partitionId(), {}
    held: list[pa.RecordBatch] = []

    def blocks(rows: pa.Table, whole: bool) -> tuple[list[dict], pa.Table]:
        made, at = [], 0
        curve = rows.column("curve").to_numpy()
        while at < len(curve):
            end = min(at + BLOCK, int(np.searchsorted(curve, curve[at], "right")))
            if end == len(curve) and end - at < BLOCK and not whole:
                break
            own = rows.slice(at, end - at)
            c = int(curve[at])
            made.append({
                "curve": c, "part": part, "seq": seq.get(c, 0), "n": end - at, "ids": own.column("cls").to_numpy().tobytes(),
                "asks": own.column("asks").to_numpy().astype(np.uint8).tobytes(), "scales": own.column("scale").to_numpy().tobytes(),
                "codes": b"".join(own.column("code").to_pylist()),
            })
            seq[c] = seq.get(c, 0) + 1
            at = end
        return made, rows.slice(at)

    kinds = pa.schema([("curve", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), *[(n, pa.binary()) for n in ("ids", "asks", "scales", "codes")]])
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= 16 * BLOCK:
            made, rest = blocks(pa.Table.from_batches(held).combine_chunks(), False)
            held = rest.to_batches()
            yield from pa.Table.from_pylist(made, kinds).to_batches()
    if held:
        yield from pa.Table.from_pylist(blocks(pa.Table.from_batches(held).combine_chunks(), True)[0], kinds).to_batches()


def exact_nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Of each batch of rows, the k nearest to each asked vector, itself left out; for the audit, in blocks."""
    for batch in batches:
        own = batch.column("cls").to_numpy()
        x = matrix(batch.column("vec"), asked.shape[1])
        for at in range(0, len(own), 4096):
            rows, names = x[at : at + 4096], own[at : at + 4096]
            d = np.stack([np.sqrt(((rows - q) ** 2).sum(axis=1)) for q in asked])
            d[ids[:, None] == names[None, :]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            who = np.repeat(ids, best.shape[1])
            far = np.take_along_axis(d, best, 1).ravel()
            fine = np.isfinite(far)
            yield pa.RecordBatch.from_arrays([pa.array(who[fine]), pa.array(names[best].ravel()[fine]), pa.array(far[fine])], names=["q", "c", "d"])


def found_in(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks in which the wanted classes lie."""
    for batch in batches:
        out = []
        for curve, part, seq, ids in zip(*[batch.column(n).to_pylist() for n in ("curve", "part", "seq", "ids")], strict=True):
            own = np.frombuffer(ids, np.int64)
            out += [(curve, part, seq, int(i)) for i in own[np.isin(own, wanted)]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["curve", "part", "seq", "cls"])


def asking(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """The rows of the blocks that ask, one by one."""
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("curve", "ordinal", "n", "ids", "asks", "scales", "codes")]
        parts = []
        for curve, ordinal, n, ids, asks, scales, codes in zip(*cols, strict=True):
            at = np.flatnonzero(np.frombuffer(asks, np.uint8))
            wide = len(codes) // n
            parts += [(curve, ordinal, i, s, codes[j * wide : (j + 1) * wide]) for j, i, s in zip(at.tolist(), np.frombuffer(ids, np.int64)[at].tolist(), np.frombuffer(scales)[at].tolist(), strict=True)]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate(kinds)], names=["curve", "ordinal", "cls", "scale", "code"])


def searched(blocks: pd.DataFrame, queries: pd.DataFrame, window: int, keep: int, kind: np.dtype) -> pd.DataFrame:
    """The best ``keep`` rows of one span of blocks for each query whose window reaches into it."""
    none = pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "d": np.zeros(0)})
    if blocks.empty or queries.empty:
        return none
    work = np.float32 if np.dtype(kind).itemsize == 1 else np.float64

    def decoded(codes: bytes, scales: np.ndarray) -> np.ndarray:
        return np.frombuffer(codes, kind).reshape(len(scales), -1).astype(work) * scales[:, None].astype(work)

    names = np.frombuffer(b"".join(blocks["ids"]), np.int64)
    where = np.repeat(blocks["ordinal"].to_numpy(), blocks["n"].to_numpy())
    rows = decoded(b"".join(blocks["codes"]), np.frombuffer(b"".join(blocks["scales"])))
    size = np.einsum("ij,ij->i", rows, rows)
    out = []
    for at in range(0, len(queries), 128):
        part = queries.iloc[at : at + 128]
        q = decoded(b"".join(part["code"]), part["scale"].to_numpy())
        d = np.einsum("ij,ij->i", q, q)[:, None] + size[None, :] - 2 * (q @ rows.T)
        d[np.abs(part["ordinal"].to_numpy()[:, None] - where[None, :]) > window] = np.inf
        d[part["cls"].to_numpy()[:, None] == names[None, :]] = np.inf
        n = min(keep, d.shape[1])
        best = np.argpartition(d, n - 1, axis=1)[:, :n]
        far = np.take_along_axis(d, best, 1).ravel()
        fine = np.isfinite(far)
        out.append(pd.DataFrame({"q": np.repeat(part["cls"].to_numpy(), n)[fine], "c": names[best].ravel()[fine], "d": np.maximum(far[fine], 0).astype(float)}))
    return pd.concat(out)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """``cls, vec, asks, ids``: equal vectors as one class, named by its least id, with its k + 1 least ids.

    More are never among the k nearest of any query. Each task cuts a class to
    k + 1 ids before the shuffle, so a vector that a third of the rows share costs little.
    """
    least = Window.partitionBy("vec", "asks").orderBy("id")
    few = rows.withColumn("turn", F.row_number().over(least)).where(F.col("turn") <= k + 1)
    grouped = few.groupBy("vec").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    # Ids may repeat, also between classes: a class is known by a number of its own.
    return grouped.select(F.monotonically_increasing_id().alias("cls"), "vec", "ids", "asks")


def lowest(df: DataFrame, most: int, salt: str, rows: int) -> list:
    """About ``most`` rows, those with the lowest hash; at most three times as many, at every size."""
    order = F.pmod(F.xxhash64(F.lit(salt), "cls"), F.lit(1 << 30))
    share = min(1.0, most / max(1, rows))
    return df.where(order < int(share * (1 << 30))).limit(3 * most).collect()


def nearest(
    df: DataFrame, id_column: str, vector_column: str, asks: Column, k: int = 10, curves: int = 8, seed: int = 11,
    sample_rows: int = 4000, audit_queries: int = 100, target: float = 0.96, least_recall: float = 0.9,
) -> DataFrame:
    """``query_id, rank, id, score``: the k nearest rows found for each row where ``asks`` holds, by Euclidean distance.

    Score is the distance of the original vectors in double precision; ranks go
    from 1, ties to the smaller id. A query's own row is no candidate; all other
    rows are, those with an equal vector or a repeated id too. Fewer candidates
    than k: all of them.

    Rows without an id, and vectors that are null, empty, zero, hold null or
    non-finite components, or are of another length than most vectors (ties:
    the shorter) take no part, as queries or candidates. An empty table gives none.

    Fitted on about ``sample_rows`` vectors: centre, projections and cell sizes.
    Every vector is indexed. The window is the least that holds ``target`` of
    the true neighbours of about ``audit_queries`` sampled queries, which are
    compared with all rows; recall is then measured on as many others. If
    it is below ``least_recall`` the search runs again with a window twice as
    wide and finer codes; after three searches it is an error.
    """
    rows = df.select(
        column(id_column).cast("bigint").alias("id"), column(vector_column).alias("raw"), F.coalesce(asks, F.lit(False)).alias("asks")
    ).where(F.col("id").isNotNull() & usable(F.col("raw")))
    common = rows.groupBy(F.size("raw").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    result = "query_id bigint, rank int, id bigint, score double"
    if common is None:
        return df.sparkSession.createDataFrame([], result)
    # Adding 0 makes -0.0 a 0.0, so that equal vectors are equal values.
    rows = rows.where(F.size("raw") == common.dim).select("id", F.transform("raw", lambda x: x.cast("double") + F.lit(0.0)).alias("vec"), "asks")
    classes = stored(classes_of(rows, k), "curves-classes")
    total = classes.count()
    sample = np.array([r.vec for r in lowest(classes.select("cls", "vec"), sample_rows, "fit", total)] or [classes.first().vec])
    fitted = Curves.fit(sample, curves, seed)
    askers = classes.where("asks")
    judged = lowest(askers.select("cls", "vec"), 2 * audit_queries, "audit", askers.count())
    if not judged:
        judged = askers.select("cls", "vec").limit(1).collect()
    if not judged:
        return df.sparkSession.createDataFrame([], result)
    truth = true_neighbours(classes, judged, k)
    chosen = {r.cls for r in judged[::2]}
    checked = {r.cls for r in judged[1::2]} or chosen

    for attempt in range(ATTEMPTS):
        kind = np.dtype(np.int8 if attempt == 0 else np.int16)
        blocks = curve_blocks(classes, fitted, kind)
        window = max(LEAST_WINDOW, needed_window(blocks, {q: c for q, c in truth.items() if q in chosen}, target)) << attempt
        pairs = stored(candidates(blocks, window, 2 * k, kind), "curves-pairs")
        recall = recall_of(pairs, {q: c for q, c in truth.items() if q in checked})
        if recall >= least_recall:
            return answers(rows, classes, pairs, k)
        warnings.warn(f"recall {recall:.3f} with a window of {window} blocks; searching again", stacklevel=2)
    raise RuntimeError(f"recall {recall:.3f} stays below {least_recall}")


def true_neighbours(classes: DataFrame, judged: list, k: int) -> dict[int, list[int]]:
    """The k nearest classes of each sampled query, by comparing it with all of them."""
    ids, asked = np.array([r.cls for r in judged], np.int64), np.array([r.vec for r in judged])
    near = classes.select("cls", "vec").mapInArrow(lambda it: exact_nearest(it, ids, asked, k), "q bigint, c bigint, d double")
    best = near.withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).where(F.col("turn") <= k)
    out: dict[int, list[int]] = {}
    for r in best.select("q", "c").collect():
        out.setdefault(r.q, []).append(r.c)
    return out


def curve_blocks(classes: DataFrame, fitted: Curves, kind: np.dtype) -> DataFrame:
    """All curves as one table of blocks, numbered along each curve by ``ordinal``."""
    keyed = classes.select("cls", "vec", "asks").mapInArrow(
        lambda it: places(it, fitted, kind), "curve int, key bigint, cls bigint, asks boolean, scale double, code binary"
    )
    ranged = keyed.repartitionByRange("curve", "key", "cls").sortWithinPartitions("curve", "key", "cls")
    blocks = stored(ranged.mapInArrow(packed, BLOCKS), "curves-blocks")
    # One row per curve and range partition: as many as there are partitions, however many vectors.
    counts = blocks.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("blocks"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("curve", "part", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("offset"))
    return blocks.join(offsets, ["curve", "part"]).withColumn("ordinal", F.col("offset") + F.col("seq")).drop("offset")


def needed_window(blocks: DataFrame, truth: dict[int, list[int]], target: float) -> int:
    """The least distance in blocks that holds ``target`` of the true pairs on some curve."""
    wanted = np.unique([*truth, *[c for near in truth.values() for c in near]]).astype(np.int64)
    offsets = blocks.select("curve", "part", (F.col("ordinal") - F.col("seq")).alias("offset")).distinct()
    seen = blocks.select("curve", "part", "seq", "ids").mapInArrow(lambda it: found_in(it, wanted), "curve int, part int, seq int, cls bigint")
    at: dict[int, dict[int, int]] = {}
    for r in seen.join(offsets, ["curve", "part"]).select("curve", "cls", (F.col("offset") + F.col("seq")).alias("ordinal")).collect():
        at.setdefault(r.cls, {})[r.curve] = r.ordinal
    far = sorted(min(abs(at[q][c] - at[n][c]) for c in at[q]) for q, near in truth.items() for n in near)
    return far[min(len(far) - 1, int(np.ceil(target * len(far))) - 1)] if far else 0


def candidates(blocks: DataFrame, window: int, keep: int, kind: np.dtype) -> DataFrame:
    """``(q, c)``: the best ``keep`` classes of each query over all curves."""
    # A span is one task's work; a query travels to each span that its window reaches into.
    span = min(max(16, window), SPAN)
    asked = blocks.mapInArrow(lambda it: asking(it, kind), "curve int, ordinal bigint, cls bigint, scale double, code binary")
    reach = F.explode(F.sequence(F.floor((F.greatest(F.col("ordinal") - window, F.lit(0))) / span), F.floor((F.col("ordinal") + window) / span)))
    asked = asked.withColumn("span", reach)
    spans = blocks.select("curve", F.floor(F.col("ordinal") / span).alias("span"), "ordinal", "n", "ids", "scales", "codes")
    found = spans.groupBy("curve", "span").cogroup(asked.groupBy("curve", "span")).applyInPandas(
        lambda a, b: searched(a, b, window, keep, kind), "q bigint, c bigint, d double"
    )
    merged = found.groupBy("q", "c").agg(F.min("d").alias("d"))
    turn = F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))
    return merged.withColumn("turn", turn).where(F.col("turn") <= keep).select("q", "c")


def recall_of(pairs: DataFrame, truth: dict[int, list[int]]) -> float:
    """The share of true neighbours among the candidates."""
    want = {(q, c) for q, near in truth.items() for c in near}
    if not want:
        return 1.0
    got = pairs.where(F.col("q").isin(list(truth))).collect()
    return len(want & {(r.q, r.c) for r in got}) / len(want)


def answers(rows: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The candidates compared again on the original vectors, and the k nearest ids of each query row."""
    mine = classes.where("asks").select(F.col("cls").alias("q"), F.col("vec").alias("mine"), F.col("ids").alias("own"))
    others = classes.select(F.col("cls").alias("c"), F.col("vec").alias("theirs"), F.col("ids").alias("others"))
    both = pairs.join(mine.select("q", "mine"), "q").join(others, "c")
    squares = F.zip_with("mine", "theirs", lambda a, b: (a - b) * (a - b))
    score = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b))
    near = both.select("q", F.explode("others").alias("id"), score.alias("score"))
    few = near.withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("turn") <= k)
    listed = few.groupBy("q").agg(F.collect_list(F.struct("score", "id")).alias("near"))
    mine = mine.join(listed, "q", "left")
    asked = rows.where("asks").select(F.col("id").alias("query_id"), F.col("vec").alias("mine"))
    at = F.array_position("own", F.col("query_id")).cast("int")
    rest = F.when(at > 0, F.concat(F.slice("own", F.lit(1), at - 1), F.slice("own", at + 1, F.size("own")))).otherwise(F.col("own"))
    same = F.transform(rest, lambda i: F.struct(F.lit(0.0).alias("score"), i.alias("id")))
    none = F.expr("cast(array() as array<struct<score:double,id:bigint>>)")
    best = F.slice(F.sort_array(F.concat(same, F.coalesce("near", none))), 1, k)
    out = asked.join(mine, "mine").select("query_id", F.posexplode(best).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
