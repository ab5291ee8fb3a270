"""Fixed-length windows of long sequences by their minimal k-mers: the arrays that the two exact substring operators share.

Every window of ``width`` units is assigned to its anchor, the k-mer in it with
the least hash (the leftmost of equals). Equal windows have equal anchors at
equal distances, and neighbouring windows mostly share one, so a run of windows
with one anchor travels as a single row instead of one row per window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PLACE_BITS = 28
BLOCK = 1 << 20
FLUSH_ROWS = 1 << 20
LEAST_ID = -(1 << 63)
TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Polynomial prefix hashes modulo 2^64: the hash of any span in constant time, for two bases."""

    def __init__(self, units: np.ndarray, bases: tuple[int, ...] = BASES):
        self.prefix, self.undo = [], []
        for base in bases:
            power = np.full(len(units) + 1, base, np.uint64)
            power[0] = 1
            power = np.cumprod(power)
            total = np.zeros(len(units) + 1, np.uint64)
            np.cumsum(units * power[:-1], out=total[1:])
            undo = np.full(len(units) + 1, pow(base, -1, 1 << 64), np.uint64)
            undo[0] = 1
            self.prefix.append(total)
            self.undo.append(np.cumprod(undo))

    def of(self, start: np.ndarray, length: np.ndarray | int, base: int = 0) -> np.ndarray:
        return (self.prefix[base][start + length] - self.prefix[base][start]) * self.undo[base][start]


@dataclass
class Segments:
    """Runs of neighbouring windows with one anchor, in unit numbers of the block."""

    anchor: np.ndarray
    content: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    offset: np.ndarray


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments(units: np.ndarray, piece: np.ndarray, width: int, k: int) -> Segments:
    """The segments of a block; no window crosses from one piece into the next.

    ``anchor`` hashes the k-mer. ``content`` hashes, with another base, all that
    the run's windows cover, together with the anchor's place in it and the
    number of windows.
    """
    if len(units) < width:
        none = np.zeros(0, np.int64)
        return Segments(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    h = Hashes(units)
    kmer = mix(h.of(np.arange(len(units) - k + 1), k))
    low = np.uint64((1 << PLACE_BITS) - 1)
    at = (sliding_minimum((kmer & ~low) | np.arange(len(kmer), dtype=np.uint64), width - k + 1) & low).astype(np.int64)
    inside = piece[: len(at)] == piece[width - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (piece[1 : len(at)] != piece[: len(at) - 1])
    start = np.flatnonzero(new)
    n = np.add.reduceat(inside, start).astype(np.int64) if len(start) else start
    p = at[start]
    shape = mix(((p - start) * 65536 + n).astype(np.uint64))
    return Segments(kmer[p], mix(h.of(start, n + width - 1, 1) ^ shape), start, n, p - start)


def pieces(length: int, width: int, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Spans of a long sequence that overlap so that each window lies in exactly one as a start."""
    for begin in range(0, max(length - width + 1, 0), block):
        yield begin, min(length, begin + block + width - 1)


def check_width(width: int, k: int) -> None:
    """A stretch has at most width - k + 1 windows, which ``pack`` writes in 8 bits."""
    if not k <= width < 256 + k:
        raise ValueError(f"windows must have {k} to {255 + k} units, not {width}")


def pack(start: np.ndarray, windows: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """First window, number of windows and 24 bits of the row's digest in one number, ordered by the first window."""
    return (start.astype(np.int64) << 32) | (windows.astype(np.int64) << 24) | digest.astype(np.int64)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, (place >> 24) & 255, place & 0xFFFFFF


ROWS = "key bigint, content bigint, id bigint, place bigint, kind int"
ONLY, FIRST, REPEAT = 0, 1, 2


class Gathered:
    """Rows (key, content, id, place) of a task; equal ones meet here before the shuffle.

    Of the occurrences of one (key, content) the earliest goes on under its key,
    as ONLY or as FIRST of several; the others are settled as REPEAT and go on
    under keys of their own. So however hot a passage is, a task sends one row
    of it. Flushed at a fixed number of rows.
    """

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, key: np.ndarray, content: np.ndarray, ids: np.ndarray, place: np.ndarray) -> None:
        self.parts.append((key, content, ids, place))
        self.rows += len(key)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        key, content, ids, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        order = np.lexsort((place, ids, content, key))
        key, content, ids, place = key[order], content[order], ids[order], place[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        other = first.copy()
        other[1:] |= (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])  # a row that is there twice is one occurrence
        key, content, ids, place, first = key[other], content[other], ids[other], place[other], first[other]
        several = first.copy()
        several[:-1] &= ~first[1:]
        several[-1] = False
        kind = np.where(first, np.where(several, FIRST, ONLY), REPEAT).astype(np.int32)
        key = np.where(first, key, mix(ids.view(np.uint64) ^ mix(place.view(np.uint64))))
        for i in range(0, len(key), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[part].view(np.int64)), pa.array(content[part].view(np.int64)), pa.array(ids[part]), pa.array(place[part]), pa.array(kind[part])],
                names=["key", "content", "id", "place", "kind"],
            )
