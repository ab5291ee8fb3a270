"""Substring dedup on bytes: a hash-compared suffix sort of the places where copies may begin or end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm import windows as W
from ticketloom.llm.common import stored
from ticketloom.llm.debruijn import blocks, keyed, per_document

KMER = 32
#: An anchor with more different surroundings than this is split by its windows' own hashes instead of being sorted in one task.
SORTED_TOGETHER = 4096


def anchored(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The stretches of all windows of ``width`` bytes, by anchor."""
    seen = W.Gathered()

    def rows() -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            for i, digest, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                yield i, digest, np.frombuffer(data, np.uint8)

    for units, piece, ids, digests, begin, base in blocks(rows(), width):
        s = W.segments(W.TABLE[units], piece, width, KMER)
        of = piece[s.start]
        seen.add(s.anchor, s.content, ids[of], W.pack(s.start - base[of] + begin[of], s.windows, digests[of]))
        if seen.rows >= W.FLUSH_ROWS:
            yield from seen.flush()
    yield from seen.flush()


class Suffixes:
    """Suffixes and prefixes at one point of each of many byte strings, compared by prefix hashes.

    Two of them are compared by a binary search for the length of their common
    extension, so by a number of hash comparisons logarithmic in their length.
    """

    def __init__(self, strings: list[bytes], point: np.ndarray):
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.base = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.hash = W.Hashes(W.TABLE[self.data])
        self.at = self.base + point
        self.reach = {True: size - point, False: point}

    def _same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray, right: bool, base: int = 0) -> np.ndarray:
        back = 0 if right else length
        return self.hash.of(self.at[i] - back, length, base) == self.hash.of(self.at[j] - back, length, base)

    def common(self, i: np.ndarray, j: np.ndarray, right: bool) -> np.ndarray:
        """Length of the common extension to the right or to the left; confirmed under a second hash, and byte by byte where they disagree."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.reach[right][i], self.reach[right][j])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self._same(i, j, middle, right)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        for k in np.flatnonzero(~self._same(i, j, low, right, 1)):
            a, b = (self._bytes(x, int(low[k]), right) for x in (i[k], j[k]))
            low[k] = np.append(np.flatnonzero(a != b), len(a))[0]
        return low

    def _bytes(self, i: int, length: int, right: bool) -> np.ndarray:
        at = self.at[i]
        return self.data[at : at + length] if right else self.data[at - length : at][::-1]

    def before(self, i: np.ndarray, j: np.ndarray, right: bool) -> np.ndarray:
        """Whether i sorts before j; equal ones by number."""
        n = self.common(i, j, right)
        ended_i, ended_j = n == self.reach[right][i], n == self.reach[right][j]
        last = len(self.data) - 1
        step = n if right else -n - 1
        a, b = (self.data[np.clip(self.at[x] + step, 0, last)] for x in (i, j))
        return np.where(ended_i & ended_j, i < j, np.where(ended_i, True, np.where(ended_j, False, a < b)))

    def order(self, group: np.ndarray, right: bool) -> np.ndarray:
        """All strings by (group, extension): bottom-up mergesort inside the groups, all of them at once. Groups must be in runs."""
        n = len(group)
        order = np.arange(n)
        new = np.concatenate([[True], group[1:] != group[:-1]])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
        rank = order - start
        width, longest = 1, int((end - start).max(initial=0))
        while width < longest:
            run = rank // width
            other = start + (run ^ 1) * width
            low, high = np.minimum(other, end), np.minimum(other + width, end)
            first = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                less = self.before(order[middle], order[open_], right)
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            merged = start + (run // 2) * 2 * width + rank % width + (low - first)
            sorted_ = np.empty(n, np.int64)
            sorted_[merged] = order
            order = sorted_
            width *= 2
        return order


def shared_windows(group: np.ndarray, strings: list[bytes], point: np.ndarray, width: int) -> np.ndarray:
    """For each string which of its windows of ``width`` bytes another string of its group has at the same distance from the point.

    Neighbours in the sorted orders of the suffixes and of the prefixes give the
    longest common extensions. What all neighbours share is marked; where that
    is less than the two longest extensions of a string would allow together,
    the windows in question are compared by hash within the group.
    """
    s = Suffixes(strings, point)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    n_windows = size - width + 1
    place = np.arange(int(n_windows.max()))
    longest = {right: np.full(len(strings), -1, np.int64) for right in (True, False)}
    edge = np.zeros((len(strings), len(place) + 1), np.int32)
    for right in (True, False):
        order = s.order(group, right)
        i, j = order[:-1], order[1:]
        pair = group[i] == group[j]
        i, j = i[pair], j[pair]
        reach = {right: s.common(i, j, right), (not right): s.common(i, j, not right)}
        least, most = np.maximum(0, width - reach[True]), reach[False]
        for x in (i, j):
            np.maximum.at(longest[right], x, reach[right])
            ok = least <= most
            np.add.at(edge, (x[ok], point[x[ok]] - most[ok]), 1)
            np.add.at(edge, (x[ok], point[x[ok]] - least[ok] + 1), -1)
    found = np.cumsum(edge, axis=1)[:, :-1] > 0
    first = (point - longest[False])[:, None]
    last = (point - np.maximum(0, width - longest[True]))[:, None]
    possible = (place >= first) & (place <= last) & (longest[True] >= 0)[:, None]
    unsure = np.isin(group, np.unique(group[(possible & ~found).any(axis=1)]))
    i, t = np.nonzero(possible & unsure[:, None])
    if len(i):
        at = s.base[i] + t
        key = (s.hash.of(at, width, 1), s.hash.of(at, width), point[i] - t, group[i])
        order = np.lexsort(key)
        equal = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in key])
        twice = np.zeros(len(i), bool)
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        found[i[twice], t[twice]] = True
    return found & (place < n_windows[:, None])


CONTEXTS = "key bigint, id bigint, place bigint, gone boolean, point int, context binary"


def contexts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes that the given stretches cover, with the anchor's place in them."""
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for i, _, data, marks in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            units = W.TABLE[np.frombuffer(data, np.uint8)]
            place = np.array([m["place"] for m in marks], np.int64)
            key = np.array([m["key"] for m in marks], np.int64).view(np.uint64)
            start, n, _ = W.unpack(place)
            for at in range(0, len(place), 4096):
                part = slice(at, at + 4096)
                low, high = int(start[part].min()), int((start[part] + n[part]).max()) + width
                h = W.Hashes(units[low:high], W.BASES[:1])
                kmers = W.mix(h.of(start[part][:, None] - low + np.arange(width - KMER + 1), KMER))
                point = np.argmax(kmers == key[part][:, None], axis=1)
                for m, a, c, p in zip(marks[part], start[part].tolist(), n[part].tolist(), point.tolist(), strict=True):
                    out.append((m["key"], i, m["place"], m["gone"], p, data[a : a + c - 1 + width]))
                    held += c + width
                if held > 8 << 20:
                    yield _context_rows(out)
                    out, held = [], 0
        if out:
            yield _context_rows(out)


def _context_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
    names = ["key", "id", "place", "gone", "point", "context"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def resolved(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of stretches not settled yet, from rows sorted by anchor; groups are read whole, several at once."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[:3]: r for r in rows}.values())  # a row that is there twice is one occurrence
        key = np.array([r[0] for r in rows], np.int64)
        found = shared_windows(key, [r[5] for r in rows], np.array([r[4] for r in rows], np.int64), width)
        found &= ~np.array([r[3] for r in rows], bool)[:, None]
        step = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, begin = np.nonzero(step == 1)
        end = np.nonzero(step == -1)[1]
        start, _, digest = W.unpack(np.array([r[2] for r in rows], np.int64)[i])
        ids = np.array([r[1] for r in rows], np.int64)[i]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(W.pack(start + begin, end - begin, digest))], names=["id", "place"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if len(rows) >= SORTED_TOGETHER and row[0] != rows[-1][0]:
                yield judged(rows)
                rows = []
            rows.append(row)
    if rows:
        yield judged(rows)


def single_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows of the given stretches one by one, under two independent hashes."""
    seen = W.Gathered()
    for batch in batches:
        for i, digest, data, marks in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            units = W.TABLE[np.frombuffer(data, np.uint8)]
            for m in marks:
                a, n, _ = W.unpack(np.array([m["place"]], np.int64))
                h = W.Hashes(units[a[0] : a[0] + n[0] - 1 + width])
                t = np.arange(n[0])
                seen.add(W.mix(h.of(t, width)), W.mix(h.of(t, width, 1)), np.full(len(t), i, np.int64), W.pack(a + t, np.ones_like(t), np.full(len(t), digest)))
                if seen.rows >= W.FLUSH_ROWS:
                    yield from seen.flush()
    yield from seen.flush()


def remaining(data: bytes, places: list[int] | None, width: int) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs, and the rest."""
    if not places:
        return len(data), 0, 0, data
    start, n, _ = W.unpack(np.array(places, np.int64))
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + n - 1 + width, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 200) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, n_spans, kept`` (binary, the remaining bytes concatenated).

    Every byte goes that lies in a string of ``width`` bytes which starts
    anywhere else too, in the same document or in another; matches never cross
    documents and are judged on the input.

    Windows travel in stretches by anchor (see ``windows``). Stretches that are
    there twice go whole. At an anchor with different stretches, one of each is
    sent with its bytes, and the suffixes at the anchor are sorted there: common
    extensions of neighbours to both sides tell which windows are repeated. An
    anchor with more than ``SORTED_TOGETHER`` different stretches is settled by
    the hashes of its single windows, which spread over all tasks.

    Null text: no bytes. Null id: kept null. Rows that repeat id and text are one
    document; they get one result and are no copies of each other.
    """
    W.check_width(width, KMER)
    rows = keyed(docs, id_column, text_column)
    class_rows = Window.partitionBy("key", "settled", "content").orderBy("id", "place")
    key_rows = Window.partitionBy("key", "settled").orderBy("content", "id", "place")
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    occurrence = F.struct("id", "place")
    met = (
        rows.mapInArrow(lambda it: anchored(it, width), W.ROWS)
        .withColumn("settled", F.col("kind") == W.REPEAT)
        .repartition("key")
        .withColumn("turn", F.rank().over(class_rows))
        .withColumn(
            "several",
            (F.max("kind").over(class_rows.rowsBetween(*everything)) == W.FIRST)
            | (F.min(occurrence).over(class_rows.rowsBetween(*everything)) != F.max(occurrence).over(class_rows.rowsBetween(*everything))),
        )
        .withColumn("classes", F.sum((F.col("turn") == 1).cast("int")).over(key_rows.rowsBetween(*everything)))
        .withColumn("undecided", F.max(~F.col("several")).over(key_rows.rowsBetween(*everything)))
        .withColumn("gone", F.col("settled") | F.col("several"))
        .withColumn("sent", ~F.col("settled") & (F.col("turn") == 1) & (F.col("classes") > 1) & F.col("undecided"))
        .where("gone OR sent")
    )
    met = stored(met.select("key", "id", "place", "gone", "sent", "classes"), "suffix-stretches")
    texts = rows.select("_id", "_digest", "_data")
    digest = F.col("place").bitwiseAND(F.lit(0xFFFFFF))

    def marked(which: str) -> DataFrame:
        marks = met.where("sent").where(which).groupBy(F.col("id").alias("_id"), digest.alias("_digest"))
        return texts.join(marks.agg(F.collect_list(F.struct("key", "place", "gone")).alias("marks")).hint("shuffle_hash"), ["_id", "_digest"])

    near = marked(f"classes <= {SORTED_TOGETHER}").mapInArrow(lambda it: contexts(it, width), CONTEXTS)
    near = near.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: resolved(it, width), "id bigint, place bigint")
    hot = marked(f"classes > {SORTED_TOGETHER}").mapInArrow(lambda it: single_windows(it, width), W.ROWS)
    one = Window.partitionBy("key", "settled", "content").orderBy("id", "place").rowsBetween(*everything)
    hot = (
        hot.withColumn("settled", F.col("kind") == W.REPEAT)
        .withColumn("several", (F.max("kind").over(one) == W.FIRST) | (F.min(occurrence).over(one) != F.max(occurrence).over(one)))
        .where("settled OR several")
    )
    gone = met.where("gone").select("id", "place").union(near).union(hot.select("id", "place"))

    @F.arrow_udf("struct<n:bigint,removed:bigint,spans:bigint,kept:binary>")
    def cleaned(data: pa.Array, places: pa.Array) -> pa.Array:
        made = [remaining(d.as_py(), p.as_py(), width) for d, p in zip(data, places, strict=True)]
        kinds = {"n": pa.int64(), "removed": pa.int64(), "spans": pa.int64(), "kept": pa.binary()}
        return pa.StructArray.from_arrays([pa.array([m[c] for m in made], k) for c, k in enumerate(kinds.values())], names=list(kinds))

    made = texts.join(per_document(gone, "places").hint("shuffle_hash"), ["_id", "_digest"], "left").withColumn("_made", cleaned("_data", "places"))
    return made.select(
        F.when(F.col("_id") != W.LEAST_ID, F.col("_id")).alias("id"), F.col("_made.n").alias("n_bytes"),
        F.col("_made.removed").alias("n_removed"), F.col("_made.spans").alias("n_spans"), F.col("_made.kept").alias("kept"),
    )
