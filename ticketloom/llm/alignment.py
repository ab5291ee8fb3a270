"""Alignment of two tokenizers over a corpus, with inverted bitmaps of documents per linked id pair."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.common import column, stored
from ticketloom.llm.pieces import MARK, slices

#: Documents of a block: an offset fits 16 bits, a plain bitmap is BLOCK / 8 bytes.
BLOCK = 1 << 12
BITMAP = BLOCK // 8
#: A block also ends after so many postings; a slice of texts, and the segments that a worker remembers.
POSTINGS = 2 << 20
SLICE_CHARS = 1 << 20
TABLE_SEGMENTS = 300_000
#: Segments that go through a tokenizer as one text.
TOGETHER = 256
BUCKET_BYTES = 8 << 20
_CUT = re.compile(r"(?<=\S)(?= )")
_RUN = re.compile(r"\s\s")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def segments_of(text: str) -> list[str]:
    """A text behind one space, cut before each space that follows no white space; each segment without its first space.

    No token of either kind crosses such a cut, and neither tokenizer looks
    across it, so equal segments have equal tokens wherever they stand.
    """
    if not _RUN.search(text) and text[0] != " ":
        return text.split(" ")
    return [s[1:] for s in _CUT.split(" " + text)]


class Tokenizers:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = byte_letters()
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [bytes(letters.get(c, 0x3F) for c in self.a.id_to_token(i) or "") for i in range(size_a)]
        self.bytes_b = [self._piece(i) for i in range(size_b)]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.mark = self.b.piece_to_id(MARK)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(_BYTE_PIECE.fullmatch(piece)[1], 16)])
        return piece.replace(MARK, " ").encode()

    def encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of A and how many each segment has, and the same of B."""
        a, size_a = self._joined([" " + s for s in segments])
        b, size_b = _flat([x if s else [self.mark] for s, x in zip(segments, self.b.encode(segments, num_threads=1), strict=True)])
        return a, size_a, b, size_b

    def _joined(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids, many segments at a call.

        Segments that end in no white space may stand behind each other: each
        begins with a space, which is where texts are cut. Others go alone.
        """
        open_ = [i for i, s in enumerate(segments) if s[-1].isspace()]
        alone = set(open_)
        order = [i for i in range(len(segments)) if i not in alone] + open_
        runs = [order[i : i + TOGETHER] for i in range(0, len(order) - len(open_), TOGETHER)]
        if runs:
            runs[-1] = [i for i in runs[-1] if i not in alone]
        found = self.a.encode_batch_fast(["".join([segments[i] for i in r]) for r in runs] + [segments[i] for i in open_], add_special_tokens=False)
        ids = [np.array(e.ids, np.int64) for e in found]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        length = np.fromiter((len(segments[i].encode()) for i in order), np.int64, len(order))
        # Tokens end where segments do; only the bytes of ids that fit no byte (none here) could hide that.
        ends = np.searchsorted(np.cumsum(self.length_a[flat]), np.cumsum(length)) + 1
        size = np.diff(np.r_[0, ends])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        start = (ends - size)[place]
        size = size[place]
        return flat[np.repeat(start, size) + _within(size)], size


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each of the runs of these sizes."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _whole(flat: np.ndarray, size: np.ndarray, length: np.ndarray, names: list[bytes], raw: list[bytes]) -> np.ndarray:
    """Which segments their tokens' bytes join to exactly."""
    of = np.repeat(np.arange(len(size)), size)
    same = np.bincount(of, length[flat], len(size)).astype(np.int64) == np.fromiter(map(len, raw), np.int64, len(raw))
    if same.all() and b"".join([names[i] for i in flat.tolist()]) == b"".join(raw):
        return same
    ends = np.cumsum(size)
    return np.array([b"".join([names[i] for i in flat[e - n : e].tolist()]) == r for e, n, r in zip(ends, size, raw, strict=True)], bool)


def _links(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, groups: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, pair, times)``: distinct ids of each side of a group with their counts, and the product of both sides."""

    def counted(ids: np.ndarray, group: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, times = np.unique(group * base + ids, return_counts=True)
        return key // base, key % base, times

    ga, ia, ta = counted(a, group_a, 1 << 24)
    gb, ib, tb = counted(b, group_b, 1 << 24)
    nb = np.bincount(gb, minlength=groups)
    first = np.cumsum(nb) - nb
    each = nb[ga]
    left = np.repeat(np.arange(len(ga)), each)
    right = np.repeat(first[ga], each) + _within(each)
    return ga[left], ia[left] * width + ib[right], ta[left] * tb[right]


class SegmentTable:
    """What each distinct segment holds: numbers of tokens and groups, groups as text, and linked pairs with their counts."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.width = len(tokenizers.bytes_b)
        self.shown_a = [str(i) for i in range(len(tokenizers.bytes_a))]
        self.shown_b = [str(i) for i in range(self.width)]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def learn(self, segments: set[str]) -> None:
        new = [s for s in segments if s not in self.index]
        if not new:
            return
        a, size_a, b, size_b = self.t.encoded(new)
        raw = [b" " + s.encode() for s in new]
        fine = _whole(a, size_a, self.t.length_a, self.t.bytes_a, raw) & _whole(b, size_b, self.t.length_b, self.t.bytes_b, raw)
        of_a, of_b = np.repeat(np.arange(len(new)), size_a), np.repeat(np.arange(len(new)), size_b)
        a, of_a, b, of_b = a[fine[of_a]], of_a[fine[of_a]], b[fine[of_b]], of_b[fine[of_b]]
        end_a, end_b = np.cumsum(self.t.length_a[a]), np.cumsum(self.t.length_b[b])  # the same bytes on both sides
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        of_group = np.zeros(len(shared), np.int64)
        of_group[group_a] = of_a
        self.text.extend(self._shown(a, group_a, b, group_b, of_group, len(new)))
        group, pair, times = _links(a, group_a, b, group_b, len(shared), self.width)
        for s in new:
            self.index[s] = len(self.index)
        count = lambda x: np.bincount(x, minlength=len(new))
        self.parts.append((fine, count(of_a), count(of_b), count(of_group), count(of_group[group]), pair, times))

    def _shown(self, a, group_a, b, group_b, of_group, segments: int) -> list[str]:
        """The groups of each segment as text: ``a1,a2|b1;a3|b2``."""
        group, side = np.r_[group_a, group_b], np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * group + side, kind="stable")
        group, side = group[order], side[order]
        last = np.ones(len(group), bool)
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        closes = last & (side == 1)
        ends = closes.copy()
        ends[:-1] &= of_group[group[1:]] != of_group[group[:-1]]
        mark = np.where(ends, 3, np.where(closes, 2, last.astype(np.int64))).tolist()
        shown_a, shown_b = self.shown_a, self.shown_b
        names = [shown_a[i] for i in a.tolist()] + [shown_b[i] for i in b.tolist()]
        line = "".join([names[i] + ",|;\n"[m] for i, m in zip(order.tolist(), mark, strict=True)])
        out = [""] * segments
        for i, x in zip(np.unique(of_group).tolist(), line.split("\n"), strict=False):
            out[i] = x
        return out

    def arrays(self) -> tuple[np.ndarray, ...]:
        """All columns over the table's segments, then the pairs and their counts in segment order."""
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
        return self.parts[0]


@dataclass
class Slice:
    """The counts of each text, and its postings: one per text and pair, with how often the text links the pair."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str | None]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def aligned(table: SegmentTable, texts: list[str]) -> Slice:
    """A slice of texts through the table of distinct segments; an empty text has no tokens."""
    if len(table.index) > TABLE_SEGMENTS:
        table.clear()
    cut = [segments_of(t) if t else [] for t in texts]
    table.learn(set().union(*cut))
    place = table.index.__getitem__
    at = [list(map(place, c)) for c in cut]
    n = len(texts)
    if not any(at):
        none = np.zeros(0, np.int64)
        return Slice(*[np.zeros(n, np.int64) for _ in range(4)], [None] * n, none, none, none)
    seg, size = _flat(at)
    doc = np.repeat(np.arange(n), size)
    fine, n_a, n_b, n_groups, n_pairs, pair, times = table.arrays()
    whole = (np.bincount(doc, ~fine[seg], n) == 0) & (size > 0)
    seg, doc = seg[whole[doc]], doc[whole[doc]]
    total = lambda x: np.bincount(doc, x[seg], n).astype(np.int64)
    first = np.cumsum(n_pairs) - n_pairs
    each = n_pairs[seg]
    entry = np.repeat(first[seg], each) + _within(each)
    key = np.repeat(doc, each) + n * pair[entry]
    order = np.argsort(key)
    key, many = key[order], times[entry][order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    many, key = (np.add.reduceat(many, start), key[start]) if len(key) else (many, key)
    shown = table.text
    groups = [";".join([shown[i] for i in x]) if w else None for x, w in zip(at, whole.tolist(), strict=True)]
    links = np.bincount(key % n, many, n).astype(np.int64)
    return Slice(total(n_a), total(n_b), total(n_groups), links, groups, key % n, key // n, many)


def containers(pair: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Each pair's bitmap of documents, for postings sorted by pair and offset: pairs, sizes in bytes, and the bytes.

    The compressed form is the offsets of the set bits as 16-bit numbers; from
    the size on at which that is no shorter, the plain bits.
    """
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(pair)])
    dense = np.flatnonzero(2 * count >= BITMAP)
    short = offset.astype("<u2")
    if not len(dense):
        return pair[start], 2 * count, short.tobytes()
    out, at = [], 0
    for i in dense.tolist():
        s, e = int(start[i]), int(start[i] + count[i])
        bits = np.zeros(BLOCK, np.uint8)
        bits[offset[s:e]] = 1
        out += [short[at:s].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
        at = e
    size = 2 * count
    size[dense] = BITMAP
    return pair[start], size, b"".join([*out, short[at:].tobytes()])


def set_bits(size: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The number of set bits of each container, and the offsets of them all."""
    count = size // 2
    ends = np.cumsum(size)
    dense = np.flatnonzero(size == BITMAP)
    if not len(dense):
        return count, np.frombuffer(data, "<u2").astype(np.int64)
    out, at = [], 0
    count = count.copy()
    for i in dense.tolist():
        s, e = int(ends[i] - BITMAP), int(ends[i])
        bits = np.frombuffer(data[s:e], np.uint8)
        count[i] = int(np.bitwise_count(bits).sum())
        out += [np.frombuffer(data[at:s], "<u2").astype(np.int64), np.flatnonzero(np.unpackbits(bits, bitorder="little"))]
        at = e
    return count, np.concatenate([*out, np.frombuffer(data[at:], "<u2").astype(np.int64)])


class Block:
    """The inverted bitmaps of a block of documents.

    Slices add their postings. ``merged`` ORs them into one bitmap per pair:
    plane 0 has the documents that hold the pair linked, plane p + 1 those whose
    number of further links of it has bit p.
    """

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.postings = 0

    def add(self, made: Slice, begin: int, end: int) -> None:
        chosen = slice(None) if begin == 0 and end == len(made.groups) else (made.text >= begin) & (made.text < end)
        self.parts.append((made.pair[chosen], made.text[chosen] - begin + self.docs, made.times[chosen]))
        self.docs += end - begin
        self.postings += len(self.parts[-1][0])

    def merged(self) -> tuple[bytes, bytes, bytes, bytes]:
        pair, offset, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(pair * BLOCK + offset)
        pair, offset, further = pair[order], offset[order], times[order] - 1
        planes, plane = [(0, *containers(pair, offset))], 1
        while further.any():
            on = (further & 1) == 1
            planes.append((plane, *containers(pair[on], offset[on])))
            further >>= 1
            plane += 1
        pairs = np.concatenate([p[1] for p in planes])
        number = np.concatenate([np.full(len(p[1]), p[0], np.uint8) for p in planes])
        size = np.concatenate([p[2] for p in planes]).astype(np.int32)
        return pairs.tobytes(), number.tobytes(), size.tobytes(), b"".join([p[3] for p in planes])


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
PARTS = ["pairs", "planes", "sizes", "data"]


def inverted(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """A row per document with its counts, and a row per block with its bitmaps; both carry the block's number."""
    table = SegmentTable(Tokenizers(byte_path, piece_path))
    block, number = Block(), -1

    def rows(n: int, **given: pa.Array) -> pa.RecordBatch:
        kinds = {"block": pa.int64(), "at": pa.int32(), "id": ids.type, **dict.fromkeys(COUNTS, pa.int64()), "sha": pa.string(), "groups": pa.string(), **dict.fromkeys(PARTS, pa.binary())}
        return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(n, t)).cast(t) for k, t in kinds.items()], names=list(kinds))

    def closed() -> Iterator[pa.RecordBatch]:
        if block.postings:
            yield rows(1, block=pa.array([number]), **{k: pa.array([v], pa.binary()) for k, v in zip(PARTS, block.merged(), strict=True)})

    ids = pa.nulls(0)
    for batch in batches:
        row = 0
        ids = batch.column("id")
        place = batch.column("place").to_numpy()
        for texts in slices([x or "" for x in batch.column("text").to_pylist()], SLICE_CHARS):
            made = aligned(table, texts)
            begin = 0
            while begin < len(texts):
                if block.docs == BLOCK or block.postings >= POSTINGS or number < 0:
                    yield from closed()
                    block, number = Block(), int(place[row])  # a block goes by the place of its first document
                end = min(len(texts), begin + BLOCK - block.docs)
                at = np.arange(block.docs, block.docs + end - begin)
                block.add(made, begin, end)
                shown = made.groups[begin:end]
                part = slice(begin, end)
                yield rows(
                    end - begin, block=pa.array(np.full(end - begin, number)), at=pa.array(at), id=ids.slice(row, end - begin),
                    **{c: pa.array(getattr(made, c)[part]) for c in COUNTS},
                    sha=pa.array(["" if g is None else hashlib.sha256(g.encode()).hexdigest() for g in shown]),
                    **({"groups": pa.array([g or "" for g in shown])} if with_groups else {}),
                )
                row += end - begin
                begin = end
    yield from closed()


def _numbers(row: pd.Series | dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["planes"], np.uint8), np.frombuffer(row["sizes"], np.int32).astype(np.int64)


def popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(pair, docs, links)`` of a task's blocks: set bits of plane 0, and of all planes by their weight."""
    held: list[tuple[np.ndarray, ...]] = []

    def summed() -> pa.RecordBatch:
        pair, docs, links = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(pair[start]), *[pa.array(np.add.reduceat(x[order], start)) for x in (docs, links)]], names=["pair", "docs", "links"])

    for batch in batches:
        for row in batch.to_pylist():
            pair, plane, size = _numbers(row)
            count, _ = set_bits(size, row["data"])
            worth = np.where(plane == 0, 1, np.left_shift(1, np.maximum(plane.astype(np.int64) - 1, 0)))
            held.append((pair, np.where(plane == 0, count, 0), count * worth))
            if sum(len(x[0]) for x in held) > POSTINGS:
                yield summed()
    if held:
        yield summed()


def dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The pairs of each block, dealt to buckets by a hash; a block has at most as many rows as pairs, however many buckets there are."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            pair, plane, _ = _numbers(row | {"sizes": b""})
            pair = pair[plane == 0]
            bucket = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[start[1:], len(bucket)]
            out += [(int(bucket[s]), row["block"], pair[order[s:e]].tobytes()) for s, e in zip(start.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "block", "asked"])


def with_scores(asked: pa.Table, known: pa.Table) -> pa.Table:
    """What a bucket's scores say of the pairs that blocks ask for, in the order asked."""
    order = np.argsort(known.column("pair").to_numpy())
    pair, docs, best = (known.column(c).to_numpy()[order] for c in ("pair", "docs", "best"))
    told = []
    for want in asked.column("asked").to_pylist():
        at = np.searchsorted(pair, np.frombuffer(want, np.int64))
        told.append((docs[at] * 2 + best[at]).tobytes())
    return pa.table({"block": asked.column("block"), "asked": asked.column("asked"), "told": pa.array(told, pa.binary())})


def scored(postings: pa.Table, told: pa.Table) -> pa.Table:
    """The scores of a block's pairs, returned through its bitmaps to its documents."""
    best, total = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    block = None
    pair = np.frombuffer(b"".join(told.column("asked").to_pylist()), np.int64)
    score = np.frombuffer(b"".join(told.column("told").to_pylist()), np.int64)
    order = np.argsort(pair)
    pair, score = pair[order], score[order]
    for row in postings.to_pylist():
        block = row["block"]
        own, plane, size = _numbers(row)
        count, offset = set_bits(size, row["data"])
        mine = score[np.searchsorted(pair, own)]
        worth = np.where(plane == 0, 1, np.left_shift(1, np.maximum(plane.astype(np.int64) - 1, 0)))
        np.add.at(best, offset, np.repeat(worth * (mine & 1), count))
        np.add.at(total, offset, np.repeat(worth * (mine >> 1), count))
    at = np.flatnonzero(total)
    return pa.table({"block": pa.array([block] * len(at), pa.int64()), "at": pa.array(at, pa.int32()), "n_best": pa.array(best[at]), "count_sum": pa.array(total[at])})


@dataclass
class Alignment:
    """documents: one row per input row. pairs: one row per linked id pair of the corpus."""

    documents: DataFrame
    pairs: DataFrame


def align(
    df: DataFrame, id_column: str, text_column: str, byte_path: str, piece_path: str, with_groups: bool = False
) -> Alignment:
    """How a byte-level tokenizer (A) and a SentencePiece one (B) cut the same texts, and which of their ids go together.

    Both read the text behind one space, without special tokens. Offsets where
    tokens of both end cut a text into groups; ids of A and B in one group are
    linked, once per pair of occurrences.

    ``documents``: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, on request, ``groups``
    (``a1,a2|b1;a3|b2,b3``). ``count_sum`` adds up, over the links, the number of
    documents that hold the pair linked; ``n_best`` counts the links whose
    number is the highest of their A id (ties included).
    ``pairs``: ``a, b, docs, links, best``.

    Null and empty texts, and texts that the joined tokens of A or B don't
    give back byte for byte, have no tokens: zeros and an empty digest. Each row
    is a document, rows that repeat an id or a text too; null ids come back as
    null. An empty table gives none. Texts of any length are read whole.
    Columns other than the two named are never read.
    """
    rows = df.select(column(id_column).alias("id"), column(text_column).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    kinds = {
        "block": T.LongType(), "at": T.IntegerType(), "id": rows.schema["id"].dataType, **dict.fromkeys(COUNTS, T.LongType()),
        "sha": T.StringType(), "groups": T.StringType(), **dict.fromkeys(PARTS, T.BinaryType()),
    }
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    made = stored(rows.mapInArrow(lambda it: inverted(it, byte_path, piece_path, with_groups), schema), "alignment")
    docs = made.where("at IS NOT NULL").select("block", "at", "id", *COUNTS, "sha", "groups")
    bitmaps = made.where("at IS NULL").select("block", *PARTS)

    width = len(Tokenizers(byte_path, piece_path).bytes_b)
    counts = bitmaps.mapInArrow(popcounts, "pair bigint, docs bigint, links bigint").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    counts = counts.select("pair", F.floor(F.col("pair") / width).alias("a"), F.pmod("pair", F.lit(width)).alias("b"), "docs", "links")
    counts = stored(counts, "alignment-counts")
    top = counts.groupBy("a").agg(F.max("docs").alias("most"))
    pairs = stored(counts.join(top, "a").withColumn("best", F.col("docs") == F.col("most")).drop("most"), "alignment-pairs")

    # As many buckets as keep one task's share of asked pairs, and of scores, near a fixed size.
    size = bitmaps.agg(F.sum(F.octet_length("pairs"))).first()[0] or 0
    buckets = int(max(8, -(-size // BUCKET_BYTES), -(-24 * pairs.count() // BUCKET_BYTES)))
    asked = bitmaps.select("block", "pairs", "planes").mapInArrow(lambda it: dealt(it, buckets), "bucket bigint, block bigint, asked binary")
    deal = F.arrow_udf(lambda p: pa.array((p.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets), "bigint")
    known = pairs.select(deal("pair").alias("bucket"), "pair", "docs", F.col("best").cast("bigint").alias("best"))
    told = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(lambda a, k: with_scores(a, k), "block bigint, asked binary, told binary")
    scores = bitmaps.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda p, t: scored(p, t), "block bigint, at int, n_best bigint, count_sum bigint")
    joined = docs.join(scores, ["block", "at"], "left")
    some = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    shown = ["groups"] if with_groups else []
    return Alignment(joined.select("id", *COUNTS, some("n_best"), some("count_sum"), F.col("sha").alias("groups_sha256"), *shown), pairs.drop("pair"))
