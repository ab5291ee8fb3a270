"""Substring dedup on words by De Bruijn compaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm import windows as W
from ticketloom.llm.common import column, stored, utf8

KMER = 6
LONG_WORD = 256
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTES_AT_ONCE = 2 << 20


def _hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word of a byte string."""
    raw = np.frombuffer(data, np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, end = edge[0::2], edge[1::2]
    h = W.Hashes(W.TABLE[raw], W.BASES[:1])
    hashes = W.mix(h.of(start, end - start) ^ W.mix((end - start).astype(np.uint64)))
    # A polynomial modulo 2^64 is no hash of long strings: whatever the base, some of 1,024 bytes are known to collide.
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], 20)
    return start, hashes


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text; long texts are read in parts that end at white space."""
    out: list[np.ndarray] = []
    run: list[bytes] = []
    held = 0

    def read() -> None:
        if not run:
            return
        start, hashes = _hashed_words(b" ".join(run))
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1)
        out.extend(np.split(hashes, np.searchsorted(start, ends[:-1])))
        run.clear()

    for t in texts:
        if len(t) <= 2 * _BYTES_AT_ONCE:
            run.append(t)
            held += len(t)
            if held >= _BYTES_AT_ONCE:
                read()
                held = 0
            continue
        read()
        held, parts, begin = 0, [], 0
        spaces = np.flatnonzero(SPACE[np.frombuffer(t, np.uint8)])
        while begin < len(t):
            at = np.searchsorted(spaces, begin + _BYTES_AT_ONCE)
            end = int(spaces[at]) if at < len(spaces) else len(t)
            parts.append(_hashed_words(t[begin:end])[1])
            begin = max(end, begin + 1)
        out.append(np.concatenate(parts))
    read()
    return out


def blocks(rows: Iterator[tuple[int, int, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Units, piece numbers, and per piece its row's id and digest, its first unit there and in the block."""
    held: list[tuple[int, int, int, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        lengths = np.array([len(x[3]) for x in held])
        return (
            np.concatenate([x[3] for x in held]), np.repeat(np.arange(len(held)), lengths),
            *(np.array([x[i] for x in held], np.int64) for i in range(3)), np.cumsum(lengths) - lengths,
        )

    for i, digest, units in rows:
        for a, b in W.pieces(len(units), width):
            held.append((i, digest, a, units[a:b]))
            size += b - a
            if size >= W.BLOCK:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def compacted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Edges of the graph (windows of ``width`` words), compacted to the stretches between anchors."""
    seen = W.Gathered()

    def rows() -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            ids, digests, texts = (batch.column(i).to_pylist() for i in range(3))
            for at in range(0, len(texts), 512):
                part = slice(at, at + 512)
                yield from zip(ids[part], digests[part], word_hashes(texts[part]), strict=True)

    for units, piece, ids, digests, begin, base in blocks(rows(), width):
        s = W.segments(units, piece, width, KMER)
        of = piece[s.start]
        place = W.pack(s.start - base[of] + begin[of], s.windows, digests[of])
        seen.add(s.anchor, s.content, ids[of], place)
        if seen.rows >= W.FLUSH_ROWS:
            yield from seen.flush()
    yield from seen.flush()


def single_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows of the given stretches one by one, under two independent hashes."""
    seen = W.Gathered()
    for batch in batches:
        ids, digests, texts, places = (batch.column(i).to_pylist() for i in range(4))
        for at in range(0, len(texts), 64):
            part = slice(at, at + 64)
            for i, digest, units, own in zip(ids[part], digests[part], word_hashes(texts[part]), places[part], strict=True):
                h = W.Hashes(units)
                start, n, _ = W.unpack(np.unique(np.array(own, np.int64)))
                start = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                one = np.ones(len(start), np.int64)
                seen.add(
                    W.mix(h.of(start, width)), W.mix(h.of(start, width, 1)), np.full(len(start), i, np.int64),
                    W.pack(start, one, one * digest),
                )
                if seen.rows >= W.FLUSH_ROWS:
                    yield from seen.flush()
    yield from seen.flush()


def kept_text(data: bytes, places: list[int] | None, width: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the rest joined by one space."""
    words = data.split()
    if not places:
        return len(words), 0, b" ".join(words)
    start, n, _ = W.unpack(np.array(places, np.int64))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + n - 1 + width, -1)
    gone = np.cumsum(change[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([words[i] for i in np.flatnonzero(~gone)])


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``_id`` (null: the least bigint), 24 digest bits that keep rows of one id apart, and the text's bytes."""
    data = utf8(column(text_column))
    return docs.select(
        F.coalesce(column(id_column).cast("bigint"), F.lit(W.LEAST_ID)).alias("_id"),
        F.xxhash64(data).bitwiseAND(F.lit((1 << 24) - 1)).alias("_digest"), data.alias("_data"),
    )


def per_document(places: DataFrame, into: str) -> DataFrame:
    """The places of each document row as one array."""
    digest = F.col("place").bitwiseAND(F.lit(0xFFFFFF))
    return places.groupBy(F.col("id").alias("_id"), digest.alias("_digest")).agg(F.collect_list("place").alias(into))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 20) -> DataFrame:
    """One row per input row: ``id, n_words, n_removed, kept``.

    A word goes if a window of ``width`` words that covers it starts earlier
    too: in a document of smaller id, or at an earlier word of the same one.
    Words are split at ASCII white space and compared as they are; windows are
    judged on the input.

    Windows are the edges of a De Bruijn graph of word k-mers. Stretches of edges
    between neighbouring anchors are compacted at the source; the rows of one
    anchor meet in one shuffle. Where all rows of an anchor agree the path does
    not branch, and the stretch stands for all its edges: the first source keeps
    it. At a branch one source of each different stretch goes back to its text,
    and its edges are compared one by one, in a second shuffle.

    Null text: no words. Null id: the least of all. Rows that repeat id and text
    are one document and get one result; rows that repeat an id alone are
    documents of one rank, where only an earlier start counts.
    """
    W.check_width(width, KMER)
    rows = keyed(docs, id_column, text_column)
    stretches = rows.mapInArrow(lambda it: compacted(it, width), W.ROWS)
    whole = Window.partitionBy("key", "settled").orderBy("content", "id", "place")
    unbounded = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = (
        stretches.withColumn("settled", F.col("kind") == W.REPEAT)
        .repartition("key")
        .withColumn("branch", F.min("content").over(unbounded) != F.max("content").over(unbounded))
        .withColumn("turn", F.rank().over(Window.partitionBy("key", "settled", "content").orderBy("id", "place")))
        .withColumn("gone", F.col("settled") | (F.col("turn") > 1))
        .where("gone OR branch")
    )
    met = stored(met.select("id", "place", "gone"), "debruijn-stretches")
    texts = rows.select("_id", "_digest", "_data")
    sources = per_document(met.where("NOT gone"), "places")
    edges = texts.join(sources.hint("shuffle_hash"), ["_id", "_digest"]).mapInArrow(lambda it: single_windows(it, width), W.ROWS)
    edges = (
        edges.withColumn("settled", F.col("kind") == W.REPEAT)
        .withColumn("turn", F.rank().over(Window.partitionBy("key", "settled", "content").orderBy("id", "place")))
        .where("settled OR turn > 1")
    )
    gone = per_document(met.where("gone").select("id", "place").union(edges.select("id", "place")), "places")

    @F.arrow_udf("struct<n:bigint,removed:bigint,kept:string>")
    def cleaned(data: pa.Array, places: pa.Array) -> pa.Array:
        made = [kept_text(d.as_py(), p.as_py(), width) for d, p in zip(data, places, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2].decode() for m in made], pa.string())],
            names=["n", "removed", "kept"],
        )

    made = texts.join(gone.hint("shuffle_hash"), ["_id", "_digest"], "left").withColumn("_made", cleaned("_data", "places"))
    return made.select(
        F.when(F.col("_id") != W.LEAST_ID, F.col("_id")).alias("id"),
        F.col("_made.n").alias("n_words"), F.col("_made.removed").alias("n_removed"), F.col("_made.kept").alias("kept"),
    )
