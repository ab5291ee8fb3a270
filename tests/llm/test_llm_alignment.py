"""Tokenizer alignment against whole texts through both libraries, offsets found token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ticketloom.llm import alignment, queries

ODD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "a\n b", "a\n  b", "a \n b", "a \n \n b", "\n", "\n\n", "\t x\t\ty", "x  y", "x  y",
    "x\x1c y", "x \x1cy", "x\x85 z", "mark ▁ inside", "▁", "<|endoftext|> plain <s> </s> <unk> <0x0A>", "naïve façade — “quoted” 日本語 テキスト 🙂🙂 é",
    "don't we'll I'm THE'S", "0123456789 3.14 1e-05", "a" * 5000, " " * 3000 + "x" + " " * 17, "\n" * 400 + " " * 400, "ab" * 2000 + " " + "🙂" * 700,
    "﻿bom", "nul\x00byte", "word word word " * 300, "ＡＢＣ full", "　wide 　 wide", "x​y z",
]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(queries.tokenizer("byte_bpe_50k.json"), queries.piece_model())


def plain(t, text):
    """Tokens of A, of B, and the groups; None where there are none."""
    if not text:
        return None
    a = t.a.encode(" " + text, add_special_tokens=False).ids
    b = t.b.encode(text, num_threads=1)
    raw = (" " + text).encode()
    if b"".join(t.bytes_a[i] for i in a) != raw or b"".join(t.bytes_b[i] for i in b) != raw:
        return None
    groups, at, left, right = [], [0, 0], [], []
    a, b = list(a), list(b)
    n_a, n_b = len(a), len(b)
    while a or b:
        if at[0] <= at[1]:
            left.append(a.pop(0))
            at[0] += len(t.bytes_a[left[-1]])
        else:
            right.append(b.pop(0))
            at[1] += len(t.bytes_b[right[-1]])
        if at[0] == at[1]:
            groups.append((left, right))
            left, right = [], []
    return n_a, n_b, groups


def expected(t, rows):
    made = [plain(t, text) for _, text in rows]
    links = [Counter((x, y) for g in m[2] for x in g[0] for y in g[1]) if m else Counter() for m in made]
    docs = Counter(p for c in links for p in c)
    top = {a: max(n for (x, _), n in docs.items() if x == a) for a, _ in docs}
    out = []
    for (i, _), m, c in zip(rows, made, links, strict=True):
        if m is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in m[2])
        best = sum(n for p, n in c.items() if docs[p] == top[p[0]])
        out.append((i, m[0], m[1], len(m[2]), sum(c.values()), best, sum(n * docs[p] for p, n in c.items()), hashlib.sha256(shown.encode()).hexdigest(), shown))
    pairs = {(a, b, n, sum(c[a, b] for c in links), n == top[a]) for (a, b), n in docs.items()}
    return sorted(out, key=str), pairs


def test_odd_texts_repeats_and_clashing_names(spark, tokenizers):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(3, "a"), (3, "a"), (None, "a b c"), (None, None)]
    frame = spark.createDataFrame([(i, x, 1, "k", 2) for i, x in rows], "doc_id int, text string, block int, pairs string, at int").repartition(3)
    found = alignment.align(frame, "doc_id", "text", queries.tokenizer("byte_bpe_50k.json"), queries.piece_model(), with_groups=True)
    want, pairs = expected(tokenizers, rows)
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert sorted(map(tuple, found.documents.select(names).collect()), key=str) == want
    assert {(r.a, r.b, r.docs, r.links, r.best) for r in found.pairs.collect()} == pairs
    none = alignment.align(frame.where("false"), "doc_id", "text", queries.tokenizer("byte_bpe_50k.json"), queries.piece_model())
    assert none.documents.collect() == [] and none.pairs.collect() == []


def test_query_with_small_blocks_and_slices(spark, small, tokenizers, monkeypatch):
    for name, value in (("SLICE_CHARS", 3000), ("POSTINGS", 1500), ("TABLE_SEGMENTS", 200), ("BUCKET_BYTES", 20_000)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = expected(tokenizers, rows)
    got = queries.op12_tokenizer_alignment(spark, small)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == [w[:8] for w in want]


def test_cuts_are_token_boundaries(tokenizers):
    draw = random.Random(5)
    letters = ["a", "b", "é", "日", "🙂", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", " ", ".", "'s", "7", "​"]
    for _ in range(400):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 30)))
        parts = alignment.segments_of(text)
        assert "".join(" " + p for p in parts) == " " + text
        a, size_a, b, size_b = tokenizers.encoded(parts)
        assert a.tolist() == tokenizers.a.encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == list(tokenizers.b.encode(text, num_threads=1))
        for part, n, m in zip(parts, size_a, size_b, strict=True):
            assert n == len(tokenizers.a.encode(" " + part, add_special_tokens=False).ids)
            assert m == len(tokenizers.b.encode(part, num_threads=1)) or not part


def test_bitmaps_of_both_forms_come_back():
    draw = np.random.default_rng(6)
    postings = {(p, o) for p, n in ((3, 1), (5, 255), (8, 256), (9, 4096), (11, 700)) for o in draw.permutation(alignment.BLOCK)[:n].tolist()}
    pair, offset = np.array(sorted(postings)).T
    pairs, size, data = alignment.containers(pair, offset)
    count, back = alignment.set_bits(size, data)
    assert pairs.tolist() == [3, 5, 8, 9, 11] and count.tolist() == [1, 255, 256, 4096, 700] and size.max() == alignment.BITMAP
    assert back.tolist() == offset.tolist()


def test_planes_hold_how_often_a_document_links_a_pair():
    none = np.zeros(3, np.int64)
    block = alignment.Block()
    times = np.array([1, 2, 7, 300], np.int64)
    block.add(alignment.Slice(none, none, none, none, [None] * 3, np.array([0, 1, 1, 2]), np.array([4, 4, 9, 9]), times), 0, 3)
    pair, plane, size = alignment._numbers(dict(zip(alignment.PARTS, block.merged(), strict=True)))
    count, offset = alignment.set_bits(size, block.merged()[3])
    got = Counter()
    for p, n, o in zip(np.repeat(pair, count), np.repeat(plane, count), offset, strict=True):
        got[int(p), int(o)] += 1 if n == 0 else 1 << (int(n) - 1)
    assert got == {(4, 0): 1, (4, 1): 2, (9, 1): 7, (9, 2): 300}
