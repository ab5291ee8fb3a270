"""Each operator against its plain version on odd texts; columns with clashing names, nulls, ties and empty tables included."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_brute import (
    base_spans, contamination as plain_contamination, odd_texts, simhash as plain_simhash, smallest_reachable,
    without_byte_windows, without_word_windows,
)
from ticketloom.llm import boosting, components, debruijn, decontam, langid, nndescent, pieces, pii, quality, queries, shards, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, shard int, n_words int, _id int, key string"


@pytest.fixture(scope="module")
def texts():
    made = odd_texts()
    return {(i * 37) % 1009: t for i, t in enumerate(made)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else None, None, None, 0.5, "s", 1, 2, 3, "k") for k, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40, 80)] + [(7, i) for i in range(100, 130)] + [(5, 5)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    nodes = {n for link in links for n in link} - {5}
    assert got == {n: c for n, c in smallest_reachable(nodes, [x for x in links if x != (5, 5)]).items()}


def test_simhash(docs, texts, empty):
    got = {r.id: r for r in simhash.near_duplicates(docs, "doc_id", "text", keep=("lang",)).collect()}
    prints = {k: plain_simhash(t) for k, t in texts.items()}
    assert {k: r.fingerprint % (1 << 64) for k, r in got.items()} == prints
    links = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {k: r.component_id for k, r in got.items()} == smallest_reachable(texts, links)
    assert all(r.first == (k == r.component_id) for k, r in got.items())
    assert simhash.near_duplicates(empty, "doc_id", "text").count() == 0


def test_simhash_repeated_and_null_ids(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, None), (9, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()
    assert sorted((r.id is None, r.id or 0, r.component_id, r.first) for r in got) == [
        (False, 4, 4, False), (False, 4, 4, True), (False, 9, 9, True), (True, 0, 4, False), (True, 0, 9, False),
    ]


def test_large_block_groups_find_every_link():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 14, 3000, dtype=np.uint64))
    label = simhash.linked_within(values, 2)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    want = smallest_reachable(range(len(values)), list(zip(*np.nonzero(np.triu(near, 1)), strict=True)))
    assert label.tolist() == [want[i] for i in range(len(values))]


def test_words_and_bytes_without_repeats(docs, texts, empty, monkeypatch):
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in debruijn.without_repeats(docs).collect()}
    assert got == without_word_windows(texts)
    want = without_byte_windows(texts)
    for together in (4096, 3):
        monkeypatch.setattr(suffixes, "SORTED_TOGETHER", together)
        made = suffixes.without_copies(docs).collect()
        assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in made} == want
    assert debruijn.without_repeats(empty).count() == 0
    assert suffixes.without_copies(empty).count() == 0


def test_wholly_equal_rows_are_one_document(spark):
    line = " ".join(f"w{i}" for i in range(90))
    df = spark.createDataFrame([(1, line), (1, line), (None, line)], "doc_id long, text string")
    assert sorted((r.id or 0, r.n_removed) for r in debruijn.without_repeats(df).collect()) == [(0, 0), (1, 90), (1, 90)]
    once = spark.createDataFrame([(1, line), (1, line)], "doc_id long, text string")
    assert [r.n_removed for r in suffixes.without_copies(once).collect()] == [0, 0]


def test_decontamination(spark, docs, texts, empty):
    items = [(1, texts[37]), (10, "THE é a"), (2, None), (3, "!!"), (10, "THE é a"), (5, " ".join(f"w{i}" for i in range(8)))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in decontam.contamination(docs, table).collect()}
    assert got == {k: plain_contamination(t, items) for k, t in texts.items()}
    assert any(n for _, n, _ in got.values())
    assert decontam.contamination(empty, table).count() == 0
    none = decontam.contamination(docs, table.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(texts)


def test_personal_data(docs, texts, empty):
    found = pii.personal_data(docs)
    rows = found.collect()
    for r in rows:
        assert [(s.start, s.no, s.end, s.kind) for s in r.spans if s.base] == base_spans(texts[r.doc_id])
    for r in pii.redacted(found).collect():
        spans, at, parts = next(x.spans for x in rows if x.doc_id == r.doc_id), 0, []
        for head in [s for s in spans if s.head]:
            parts += [texts[r.doc_id][at : head.start], f"[{head.kind.upper()}]"]
            at = head.run_end
        assert r.text == (texts[r.doc_id] if not spans else "".join(parts) + texts[r.doc_id][at:])
    assert pii.personal_data(empty).count() == 0


def test_secret_is_added_and_version_is_not(spark):
    rows = [(i, f'see token = "{i:06d}ab12cd34ef56ab12cd34ef56" now') for i in range(60)] + [(100, "plain words only")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("secret" in got[i] or "hex_token" in got[i] for i in range(60)) and got[100] == []


def test_boosting_learns_and_its_sql_agrees(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x, y)
    p = model.probability(x)
    assert ((p > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    assert np.allclose([r.p for r in df.selectExpr(f"{model.sql(['a', 'b'])} AS p").collect()], p, atol=1e-6)
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((1, 2)))[0] == 0.5


def test_shards(docs, texts, empty):
    rows = shards.shuffle_into_shards(docs, "doc_id", "text", shards=5, bucket_bytes=2000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for k in range(5):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    more = {r.doc_id: r.shard for r in shards.shuffle_into_shards(docs, "doc_id", "text", shards=6).collect()}
    assert all(more[r.doc_id] == r.grown_shard and r.grown_shard in (r.shard, 5) for r in rows)
    assert all(r.size == len((r.text or "").encode()) + 1 and r.lang == ("en" if r.doc_id % 2 else None) for r in rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] != sorted(texts)
    assert shards.shuffle_into_shards(empty, "doc_id", "text").count() == 0


def test_written_shards(spark, docs, texts, tmp_path):
    shards.write_shards(shards.shuffle_into_shards(docs, "doc_id", "text", shards=3), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").select("doc_id", "shard").distinct().count() == len(texts)


def test_pieces_are_the_library_s(spark, empty):
    model = pieces.processor(queries.piece_model())
    odd = ["", None, " ", "  a", "a  ", "▁a b▁▁c ", "\n\n x", "日本 語𝔘\x00", "a\tb <s> <0x0A> </s>", "x" * 5000 + "   " + "é" * 300]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").withColumnRenamed("doc_id", "ids2")
    for r in pieces.with_pieces(df, "text", queries.piece_model()).collect():
        assert list(r.ids) == model.encode(r.text or "") and r.decoded == model.decode(model.encode(r.text or ""))
    assert pieces.with_pieces(empty, "text", queries.piece_model()).count() == 0


def test_network_gradients_match_differences():
    net = langid.initial(["x", "y", "z"], hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(3)
    seq, lang = rng.integers(97, 101, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = langid.gradients(net, seq, lang)
    for name in net.w:
        at = tuple(int(rng.integers(0, n)) for n in net.w[name].shape) if not name.startswith("x") else (98, 5)
        kept, step = net.w[name][at], 1e-5
        losses = []
        for d in (step, -step):
            net.w[name][at] = kept + d
            losses.append(langid.gradients(net, seq, lang)[0])
        net.w[name][at] = kept
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][at]) < 1e-6


def test_language(spark, empty):
    words = {"aa": "lala mala kala nala", "bb": "zorg torg borg dorg"}
    rows = [(i, words["aa" if i % 2 else "bb"] * (1 + i % 3), "aa" if i % 2 else "bb") for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", None), (902, "", None), (None, "mala", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.with_language(df, langid.fit(df)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert langid.with_language(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.with_language(df, langid.fit(empty)).collect()} == {"und"}


def test_quality(spark, small, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.with_score(docs, model).join(labels, "doc_id").collect()
    scores = {c: [r.score for r in rows if r.quality == c] for c in (0, 1)}
    assert np.median(scores[1]) > np.median(scores[0]) and all(0 <= s <= 1 for c in scores.values() for s in c)
    assert quality.with_score(empty, quality.fit(empty, labels.limit(0))).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.with_score(docs, nothing).collect()} == {0.5}


def test_embeddings(spark):
    rng, vectors = np.random.default_rng(1), []
    for _ in range(25):
        c = rng.normal(size=16)
        vectors += [(c + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.2])).tolist() for _ in range(rng.integers(1, 30))]
    n = len(vectors)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate([*vectors, *odd])), "vec_id long, embedding array<double>")
    got = {r.id: r for r in nndescent.near_duplicates(df).collect()}
    x = nndescent.unit(np.array(vectors))
    near = x @ x.T >= 0.95
    want = smallest_reachable(range(n + len(odd)), list(zip(*np.nonzero(np.triu(near, 1)), strict=True)))
    assert {k: r.component_id for k, r in got.items()} == want
    assert [got[i].n_links for i in range(n)] == (near.sum(axis=1) - 1).tolist()
    assert all(got[n + i].n_links == 0 and got[n + i].kept for i in range(len(odd)))
    assert nndescent.near_duplicates(df.limit(0)).count() == 0


def test_links_counted_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    path = [[np.cos(a), np.sin(a)] for a in np.sort(rng.uniform(0, 2.4, 60))] + [[1.0, rng.normal() * 0.01] for _ in range(40)]
    rows = [(0, i, list(map(float, v)), 1 + i % 3) for i, v in enumerate(path)] + [(1, 100 + i, [0.0, 1.0 + i], 2) for i in range(9)]
    members = spark.createDataFrame(rows, "component long, node long, vec array<double>, weight long")
    got = dict(nndescent.link_counts(members, 0.95, block=7).collect())
    x, part, weight = nndescent.unit(np.array([r[2] for r in rows])), np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    near = (x @ x.T >= 0.95) & (part[:, None] == part[None, :]) & ~np.eye(len(rows), dtype=bool)
    assert got == {r[1]: int(n) for r, n in zip(rows, near @ weight, strict=True)}


def test_capital_sigma_is_found_whatever_follows(spark):
    docs = spark.createDataFrame([(1, "x ΑΣ'Β y"), (2, "ΑΣ Β")], "doc_id long, text string")
    items = spark.createDataFrame([("s", "ΑΣ Β")], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontam.contamination(docs, items).collect()} == {1: 2, 2: 2}


def test_documents_that_share_an_id_teach_once(spark):
    rows = [(i % 3, "good words here " * 40 if i % 3 else "zzq 19 zzq ") for i in range(200)]
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert len(model.good) + len(model.bad) < 3 * quality.TRAINING_BYTES


def test_full_lists_do_not_part_linked_groups(spark):
    """Two groups of near copies that fill each other's lists, cosine about 0.96 between them, among many groups that pass the audit."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x)
    near = lambda c: (unit(c) + rng.normal(size=32) * 0.002).tolist()
    vectors = [near(c) for c in rng.normal(size=(200, 32)) for _ in range(5)]
    a, b = unit(rng.normal(size=32)), rng.normal(size=32)
    b = 0.96 * a + np.sqrt(1 - 0.96**2) * unit(b - (b @ a) * a)
    vectors += [near(c) for c in (a, b) for _ in range(12)]
    got = {r.id: r for r in nndescent.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    assert {(got[i].component_id, got[i].n_links) for i in range(1000, 1024)} == {(1000, 23)}
    assert all(got[i].component_id == i // 5 * 5 for i in range(1000))


def test_recall_below_the_bound_is_no_result(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 7)]) for i in range(60)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        nndescent.near_duplicates(df, least_recall=1.01, attempts=1).count()


def test_pairs_at_the_threshold_share_a_cell_however_many_bits(spark, monkeypatch):
    """Cells of 8, so that 3,000 vectors need 9 bits."""
    monkeypatch.setattr(nndescent, "CELL", 8)
    rng = np.random.default_rng(3)
    a, b = nndescent.unit(rng.normal(size=(1500, 48))), rng.normal(size=(1500, 48))
    b = nndescent.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.stack([a, b], axis=1).reshape(-1, 48))]
    nodes = spark.createDataFrame(rows, "node long, vec array<double>").cache()
    found = nndescent.first_lists(nodes, len(rows), 0.95, 3, seed=5).where("link").select(F.least("u", "v").alias("u")).distinct()
    assert found.count() >= 0.97 * len(rows) / 2


def test_calibration_reads_whole_texts_and_length_alone_moves_no_score(spark):
    rng = np.random.default_rng(6)
    words = {c: [f"{c}{i:02d}" for i in range(60)] for c in "gb"}
    made = {i: " ".join(rng.choice(words["gb"[i % 2]], 40 + 9 * (i % 5) + 60 * (i % 2))) for i in range(120)}
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in made], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(list(made.items()), "doc_id long, text string"), labels)
    page = " ".join(rng.choice(words["g"], 300))[: quality.PIECE]
    rows = quality.with_score(spark.createDataFrame([(1, page), (2, page * 400)], "doc_id long, text string"), model).collect()
    assert abs(rows[0].score - rows[1].score) < 0.05
    tail = [(i, "a" * 65536 + rng.bytes(32768).hex()) for i in made]
    long = quality.fit(spark.createDataFrame(tail, "doc_id long, text string"), labels)
    assert long.mean[1] > 0.2


def test_secrets_behind_a_keyword_need_no_digits(spark):
    words = ["hunter2secret", "correcthorse", "open-sesame-now", "QwertyUiopAs"]
    rows = [(i, f"the password = {words[i % 4]} is set") for i in range(80)] + [(100 + i, f"password: {'x' * 9} here 12") for i in range(80)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["secret"] and not got[100 + i] for i in range(80))


def test_values_behind_a_keyword_go_whole_and_prose_stays(spark, small):
    said = {
        "so the secret: internationalization of words": "so the secret: internationalization of words",
        "token: understanding of the matter": "token: understanding of the matter",
        "password = Ab!cd#ef9$gh": "[SECRET]",
        "here password: p@ss!w0rd#2024x, then": "here [SECRET], then",
        "api_key = sk_live_abcdefgh1234!rest": "[SECRET]",
        'x "password": "two words" and token="04dbebab91ab85687d33eeaa" y': 'x "password": "two words" and [SECRET]" y',
        "call 314-555-0123 or 014-555-0123": "call [LOCAL_PHONE] or 014-555-0123",
        "id 219-09-9999 not 666-09-9999": "id [NATIONAL_ID] not 666-09-9999",
    }
    corpus = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for base in (corpus, corpus.where("false")):
        rows = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(said)], "doc_id long, text string")
        got = pii.redacted(pii.personal_data(base.unionByName(rows))).where("doc_id >= 1000000000").orderBy("doc_id").collect()
        assert [r.text for r in got] == list(said.values())


def test_thresholds_hold_on_sentences_that_were_held_out(spark, small):
    corpus = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    quality_of = pii.fit_model(spark, *pii.letter_levels(corpus, "text")).quality
    assert set(quality_of) == {"secret", "hex_token", "local_phone", "national_id", "iban"}
    assert all(precision >= 0.95 and recall >= 0.9 for precision, recall in quality_of.values()), quality_of


def test_letter_levels_count_every_text(spark):
    """Pairs that one of 4,026 texts holds each: a share of the texts would miss most of them."""
    plain = spark.range(4000).selectExpr("id AS doc_id", "'abab baba' AS text")
    rare = [(4000 + i, chr(97 + i) * 4) for i in range(26)]
    levels, words = pii.letter_levels(plain.unionByName(spark.createDataFrame(rare, "doc_id long, text string")), "text")
    assert [levels[i * 26 + i] for i in range(2, 26)] == ["3"] * 24  # 3 of 3 pairs: log2(29 / 4)
    assert levels[2 * 26 + 3] == "5"  # none of 3: log2(29)
    assert set(words) == {"abab", "baba"} | {w for _, w in rare}


def test_long_words_that_every_polynomial_takes_for_equal(spark):
    """The Thue-Morse word and its complement: their polynomial hashes modulo 2^64 agree whatever the base."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    other = morse.translate(str.maketrans("ab", "ba"))
    lines = [" ".join([f"w{i}" for i in range(19)] + [w]) for w in (morse, other, morse)]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_removed) for r in debruijn.without_repeats(frame).collect()}
    assert got == {0: (20, 0), 1: (20, 0), 2: (20, 20)}


def test_widths_that_do_not_fit_are_refused(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for width in (3, 262):
        with pytest.raises(ValueError):
            debruijn.without_repeats(frame, width=width)
    for width in (20, 288):
        with pytest.raises(ValueError):
            suffixes.without_copies(frame, width=width)
    shared = "".join(chr(97 + (i * i * 7 + i // 9) % 26) for i in range(900))
    texts = {1: "x" + shared + "1234", 2: "y9" + shared + "zz"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: (r.n_removed, bytes(r.kept)) for r in suffixes.without_copies(rows, width=280).collect()}
    assert got == {1: (900, b"x1234"), 2: (900, b"y9zz")}


def test_long_runs_are_read_with_their_neighbours_and_every_byte_counts_once():
    for text in ("日本語テキスト" * 40, "ab🙂" * 50, "x" * 23, "x" * 24, "y" * 500, "é" * 12 + "z"):
        run = b" " + text.encode()
        parts = [langid.reading(w) for w in langid.words_of(text.encode())]
        assert b"".join(p[a:b] for p, a, b in parts) == run
        assert all(p[a:b].decode() and p.decode() for p, a, b in parts)  # cut between characters
        inner = parts[1:-1]
        assert all(a > 0 and b < len(p) and len(p) <= langid.WORD_BYTES + 2 * langid.CONTEXT_BYTES + 8 for p, a, b in inner)


def test_training_words_come_from_the_whole_text(spark):
    rows = [(i, " ".join([f"{'ab'[i % 2]}{'cd'[i % 2]}"] * 3000 + ["ef" * 3, "gh" * 3][i % 2 : i % 2 + 1] * 3000), "xy"[i % 2]) for i in range(40)]
    drawn = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(langid.drawn_words("text", 200).alias("w")).collect()
    for r in drawn:
        late = sum(len(w) == 6 for w in r.w.split(" "))
        assert len(r.w.split(" ")) == 200 and 60 < late < 140


def test_order_of_shards_goes_by_the_seed_not_by_the_input(docs):
    def order(frame, **more):
        rows = shards.shuffle_into_shards(frame, "doc_id", "text", shards=3, bucket_bytes=3000, **more).collect()
        return [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]

    first = order(docs)
    assert order(docs.repartition(7)) == first == order(docs.orderBy(F.desc("doc_id")).coalesce(1))
    assert order(docs, seed=8) != first and sorted(order(docs, seed=8)) == sorted(first)


def test_rows_that_repeat_spread_over_the_buckets(spark):
    rows = [(5, "same text " * 50)] * 600 + [(i, f"text {i}") for i in range(100)] + [(None, None)] * 3
    frame = spark.createDataFrame(rows, "i long, t string")
    got = shards.shuffle_into_shards(frame, "i", "t", shards=2, bucket_bytes=20_000).collect()
    assert sorted((r.i is None, r.i or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    for k in (0, 1):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    hot = next(r.shard for r in got if r.i == 5)
    slots = [r.slot for r in got if r.shard == hot and r.i != 5]
    assert max(slots) - min(slots) > 300  # the others lie among the copies


def test_query_of_shards_against_the_law_in_sql(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    documents.createOrReplaceTempView("law_docs")
    law = spark.sql(
        "SELECT doc_id, max_by(i, struct(h, i)) FILTER (WHERE i < 8) AS shard, max_by(i, struct(h, i)) AS grown FROM (SELECT doc_id, i, "
        "xxhash64(7, i, CAST(doc_id AS STRING)) AS h FROM (SELECT DISTINCT doc_id FROM law_docs) CROSS JOIN (SELECT CAST(id AS INT) AS i FROM range(9))) GROUP BY 1"
    )
    want = {r.doc_id: (r.shard, r.grown) for r in law.collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    got = queries.op7_sharding(spark, small).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == want
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "key" for r in got)
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
