"""Spelling variants against a plain version: every pair of words compared."""

import random
import re
import zlib
from collections import Counter

from ticketloom.llm import variants


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point, by trying all of them."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows) -> dict[str, int]:
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def plain_groups(n: dict[str, int]) -> list[tuple]:
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def result(frame) -> list[tuple]:
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_words_of_few_letters_all_near_each_other(spark):
    draw = random.Random(4)
    n = {}
    for _ in range(400):
        word = "".join(draw.choice("abé") for _ in range(draw.randint(4, 8)))
        n[word] = draw.choice([5, 6, 25, 30, 160, 900, 5000])
    n |= {"aaaaaaa": 7, "aaaaaa": 35, "abababab": 175, "a" * 40: 9, "a" * 41: 50, "x\U0001f600yyyy": 5, "x\U0001f601yyyy": 25}
    assert result(variants.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_groups(n)


def test_a_chain_goes_to_its_last_form(spark):
    n = {"abcdefgh"[: 8 - i] + "z" * i: 5 ** (i + 1) for i in range(8)}
    got = {r.word: r.root for r in variants.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == {w: "a" + "z" * 7 for w in n}


def test_whole_texts_with_odd_rows(spark):
    common, rare = "Straße letters ", "straàe LETTERS strase lettrs "
    rows = [(i, common * 40 + rare * 3, "k", 1) for i in range(30)] + [(1, common, "k", 1)] * 9
    rows += [(None, "lettérs " * 30, "k", 2), (5, None, "k", 3), (6, "", None, 4), (7, "letters" * 30_000 + " letters", "k", 5), (8, "a" * 90_000, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    want = plain_groups(plain_counts([(r[0], r[1]) for r in rows]))
    assert result(variants.spelling_variants(docs)) == want and any(r[1] for r in want)
    assert result(variants.spelling_variants(docs.where("false"))) == []
    assert result(variants.variant_groups(spark.createDataFrame([("abcdef", 2), ("abcdef", 3), (None, 9)], "word string, n int"))) == [
        ("abcdef", None, "abcdef", 5, 0, None)
    ]
