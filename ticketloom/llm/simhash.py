"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import column, stored, utf8
from ticketloom.llm.components import components

SEED = 42
FREE_BLOCKS_BESIDE = 6
_AT_ONCE = 1 << 16


def fingerprint(data: bytes, shingle: int) -> int:
    """64-bit SimHash of one text.

    Words are split at ASCII white space after lower-casing A-Z; every shingle
    counts as often as it occurs. Fewer words than a shingle has: the whole
    sequence is the one shingle. No words: 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size) + np.arange(len(words))
    start = (end - size)[: len(words) - shingle + 1]
    end = end[shingle - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(start), _AT_ONCE):
        spans = zip(start[at : at + _AT_ONCE].tolist(), end[at : at + _AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * total > len(start))
    return int.from_bytes(majority.tobytes(), "big")


def with_fingerprints(df: DataFrame, text: str, into: str, shingle: int = 3) -> DataFrame:
    """The rows with their fingerprint as a bigint (the 64 bits, signed); a null text has no words."""

    @F.arrow_udf("bigint")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle) for x in batch], dtype=np.uint64)
            yield pa.array(values.view(np.int64))

    return df.withColumn(into, fingerprints(utf8(column(text))))


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks that keep all but ``distance`` of the blocks: a close pair agrees under one of them at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(m for i, m in enumerate(whole) if i not in free) for free in combinations(range(blocks), distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_within(values: np.ndarray, distance: int) -> np.ndarray:
    """For the distinct fingerprints of one block group: the least index reachable by links inside the group.

    The members differ in the free blocks alone, so a large group is searched by
    flipping up to ``distance`` of those bits, not by comparing all pairs.
    """
    n = len(values)
    if n <= 64:
        differing = np.bitwise_count(values[:, None] ^ values[None, :])
        left, right = np.nonzero(differing <= distance)
    else:
        varying = int(np.bitwise_or.reduce(values ^ values[0]))
        bits = [1 << i for i in range(64) if varying >> i & 1]
        order = np.argsort(values)
        ranked, found = values[order], []
        for r in range(1, distance + 1):
            for flip in combinations(bits, r):
                other = values ^ np.uint64(sum(flip))
                at = np.minimum(np.searchsorted(ranked, other), n - 1)
                hit = np.nonzero(ranked[at] == other)[0]
                found.append((hit, order[at[hit]]))
        left = np.concatenate([x for x, _ in found])
        right = np.concatenate([x for _, x in found])
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def fingerprint_links(fingerprints: DataFrame, distance: int = 2, blocks: int | None = None) -> DataFrame:
    """Links ``(a, b)`` whose closure joins every two fingerprints at ``distance`` or fewer differing bits.

    fingerprints: one bigint column, distinct. With ``distance + 6`` blocks a
    group agrees in all but ``distance`` blocks, so it has at most 2 to the
    free bits (65,536 by default) members however many rows the input has; each
    group's verified links are returned as a star, never as all pairs.
    """
    blocks = blocks or distance + FREE_BLOCKS_BESIDE
    (name,) = fingerprints.columns
    masks = [_signed(m) for m in block_masks(distance, blocks)]
    keyed = fingerprints.select(
        F.col(name).alias("fp"),
        F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in masks])).alias("which", "shared"),
    )
    groups = keyed.groupBy("which", "shared").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def verified(members: pa.Array) -> pa.Array:
        out = []
        for group in members:
            values = np.sort(group.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            label = linked_within(values, distance)
            moved = np.nonzero(label != np.arange(len(values)))[0]
            signed = values.view(np.int64)
            out.append([{"a": int(signed[i]), "b": int(signed[label[i]])} for i in moved])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return groups.select(F.explode(verified("members")).alias("link")).select("link.a", "link.b").distinct()


def near_duplicates(
    df: DataFrame, id_column: str, text_column: str, shingle: int = 3, distance: int = 2, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: ``id, fingerprint, component_id, first`` and the columns named in ``keep``.

    component_id is the smallest id reachable over fingerprints that differ in
    ``distance`` or fewer bits; ``first`` marks exactly one row of each
    component, one with that id (rows that repeat an id included). Null text:
    fingerprint 0, linked like any other. Null ids: never the smallest, unless a
    component has no other; such a component's id is null. Rows with one
    fingerprint are brought to one before the search, so a group of copies
    costs one row. Only ids, fingerprints and ``keep`` are stored.
    """
    rows = with_fingerprints(
        df.select(column(id_column).alias("id"), column(text_column).alias("_text"),
                  *[column(c).alias(f"_kept_{i}") for i, c in enumerate(keep)]),
        "_text", "fingerprint", shingle,
    )
    rows = stored(rows.drop("_text").withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("_row").alias("row"))
    classes = stored(rows.groupBy("fingerprint").agg(F.min(order).alias("least")), "simhash-classes")
    links = fingerprint_links(classes.select("fingerprint"), distance)
    found = components(links, "simhash-links").select(F.col("node").alias("fingerprint"), F.col("component").alias("root"))
    rooted = classes.join(found, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("top"))
    known = stored(rooted.join(least, "root").select("fingerprint", "top"), "simhash-components")
    return rows.join(known, "fingerprint").select(
        "id", "fingerprint", F.col("top.id").alias("component_id"), (F.col("_row") == F.col("top.row")).alias("first"),
        *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)],
    )


def hex_digits(fingerprint: str = "fingerprint"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fingerprint)), 16, "0"))
