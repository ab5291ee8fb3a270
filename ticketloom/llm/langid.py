"""Language identification: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import column, free_name
from ticketloom.llm.quality import in_fold

WORD_BYTES = 24
HIDDEN = 16
UNKNOWN = "und"
TABLE_WORDS = 300_000
SLICE_CHARS = 4 << 20
CONTEXT_BYTES = 8
#: Bytes that count toward a document: ASCII letters and all parts of other characters.
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


@dataclass
class Network:
    """Weights by name; suffix f reads left to right, b right to left. Gates in the order update, reset, new."""

    langs: list[str]
    w: dict[str, np.ndarray]


def initial(langs: list[str], hidden: int = HIDDEN, seed: int = 11) -> Network:
    rng, w = np.random.default_rng(seed), {}
    for d in "fb":
        w["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
        w["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w["n" + d] = np.zeros(hidden)
        w["o" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, len(langs)))
    w["bias"] = np.zeros(len(langs))
    return Network(langs, {k: v.astype(np.float32) for k, v in w.items()})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(w: dict[str, np.ndarray], d: str, seq: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states of one direction over byte sequences of one length: (positions, sequences, hidden)."""
    size = w["u" + d].shape[0]
    h = np.zeros((len(seq), size), w["u" + d].dtype)
    out = np.empty((seq.shape[1], len(seq), size), h.dtype)
    for t in range(seq.shape[1]):
        x, u = w["x" + d][seq[:, t]], h @ w["u" + d]
        zr = _sigmoid(x[:, : 2 * size] + u[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        inner = u[:, 2 * size :] + w["n" + d]
        n = np.tanh(x[:, 2 * size :] + r * inner)
        if trace is not None:
            trace.append((h, z, r, inner, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def position_probabilities(net: Network, seq: np.ndarray) -> np.ndarray:
    """Every position's label probabilities: (positions, sequences, languages)."""
    w = net.w
    score = _read(w, "f", seq) @ w["of"] + _read(w, "b", seq[:, ::-1])[::-1] @ w["ob"] + w["bias"]
    e = np.exp(score - score.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def gradients(net: Network, seq: np.ndarray, lang: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    w, g = net.w, {k: np.zeros_like(v) for k, v in net.w.items()}
    traces: dict[str, list] = {"f": [], "b": []}
    states = {"f": _read(w, "f", seq, traces["f"]), "b": _read(w, "b", seq[:, ::-1], traces["b"])}
    score = states["f"] @ w["of"] + states["b"][::-1] @ w["ob"] + w["bias"]
    score -= score.max(axis=2, keepdims=True)
    p = np.exp(score)
    p /= p.sum(axis=2, keepdims=True)
    rows, count = np.arange(len(seq)), seq.size
    loss = -float(np.log(np.maximum(p[:, rows, lang], 1e-12)).mean())
    p[:, rows, lang] -= 1
    p /= count
    g["bias"] += p.sum(axis=(0, 1))
    for d, bytes_, due in (("f", seq, p), ("b", seq[:, ::-1], p[::-1])):
        g["o" + d] += np.einsum("tnh,tnk->hk", states[d], due)
        size = w["u" + d].shape[0]
        back = np.zeros((len(seq), size), w["u" + d].dtype)
        for t in range(seq.shape[1] - 1, -1, -1):
            h, z, r, inner, n = traces[d][t]
            dh = back + due[t] @ w["o" + d].T
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            into = np.concatenate([dz, dr, dn * r], axis=1)
            g["u" + d] += h.T @ into
            g["n" + d] += (dn * r).sum(axis=0)
            np.add.at(g["x" + d], bytes_[:, t], np.concatenate([dz, dr, dn], axis=1))
            back = dh * z + into @ w["u" + d].T
    return loss, g


#: What the network reads at once, and which of its positions count: a word behind a space, or a stretch of a longer run.
Reading = tuple[bytes, int, int]


def stretches(run: bytes) -> list[Reading]:
    """A run of more than WORD_BYTES in stretches that end between characters, each read with some bytes of its neighbours.

    Every byte counts in one stretch; the states do not start anew at its edge.
    """

    def edge(i: int) -> int:
        while 0 < i < len(run) and run[i] & 0xC0 == 0x80:
            i -= 1
        return i

    out, at = [], 0
    while at < len(run):
        end = edge(min(len(run), at + WORD_BYTES)) if at + WORD_BYTES < len(run) else len(run)
        end = end if end > at else min(len(run), at + WORD_BYTES)
        begin, upto = edge(max(0, at - CONTEXT_BYTES)), edge(min(len(run), end + CONTEXT_BYTES))
        upto = max(upto, end)
        out.append((run[begin:upto], at - begin, end - begin))
        at = end
    return out


def words_of(data: bytes) -> list[bytes | Reading]:
    """The words of a text, split at ASCII white space; of long ones their stretches. See ``reading``."""
    words: list[bytes | Reading] = data.split()
    if max(map(len, words), default=0) < WORD_BYTES:
        return words
    return [x for w in words for x in ([w] if len(w) < WORD_BYTES else stretches(b" " + w))]


def reading(word: bytes | Reading) -> Reading:
    """A word is read with one white space before it, so that white space has a label too."""
    return (b" " + word, 0, len(word) + 1) if isinstance(word, bytes) else word


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and bytes of the words of each length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        at = np.nonzero(size == n)[0]
        yield at, np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), n)


def train(texts: list[tuple[str, bytes]], steps: int = 500, batch: int = 512, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam over batches of words of one length; a word's bytes all carry its document's language."""
    langs = sorted({lang for lang, _ in texts})
    net = initial(langs, seed=seed)
    pairs = [(w, langs.index(lang)) for lang, data in texts for w, _, _ in map(reading, words_of(data)) if LETTER[np.frombuffer(w, np.uint8)].any()]
    if len(langs) < 2 or not pairs:
        return net
    lang = np.array([k for _, k in pairs])
    buckets = [(seq, lang[at]) for at, seq in by_length([w for w, _ in pairs])]
    weight = np.array([seq.size for seq, _ in buckets], dtype=float)
    each = [[np.nonzero(of == k)[0] for k in range(len(langs))] for _, of in buckets]
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        k = rng.choice(len(buckets), p=weight / weight.sum())
        seq, of = buckets[k]
        there = [i for i in each[k] if len(i)]
        at = np.concatenate([rng.choice(i, max(1, batch // len(there))) for i in there])
        _, g = gradients(net, seq[at], of[at])
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, x in g.items():
            m[name] = 0.9 * m[name] + 0.1 * x
            v[name] = 0.999 * v[name] + 0.001 * x * x
            net.w[name] -= (pace * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class WordTable:
    """For each distinct word the summed label log-probabilities of its letter positions, their summed probabilities and their number."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes | Reading, int] = {}
        self.rows = np.zeros((0, 2 * len(self.net.langs) + 1))

    def learn(self, words: set[bytes | Reading]) -> None:
        new = [w for w in words if w not in self.index]
        k = len(self.net.langs)
        made = np.zeros((len(new), 2 * k + 1))
        read = [reading(w) for w in new]
        begin, end = (np.array([r[i] for r in read], np.int64) for i in (1, 2))
        for at, seq in by_length([r[0] for r in read]):
            place = np.arange(seq.shape[1])[:, None]
            for i in range(0, len(at), 4096):
                part, own = seq[i : i + 4096], at[i : i + 4096]
                p = position_probabilities(self.net, part)
                keep = (LETTER[part].T & (place >= begin[own]) & (place < end[own]))[:, :, None]
                made[at[i : i + 4096], :k] = (np.log(np.maximum(p, 1e-9)) * keep).sum(axis=0)
                made[at[i : i + 4096], k : 2 * k] = (p * keep).sum(axis=0)
                made[at[i : i + 4096], 2 * k] = keep.sum(axis=(0, 2))
        for w in new:
            self.index[w] = len(self.index)
        self.rows = np.concatenate([self.rows, made])


def identify(table: WordTable, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text: position log-probabilities pooled over the whole text; no letters: ``und``, 0.

    Positions of one text depend on each other, so the mean of their
    log-probabilities counts as that of a few independent ones.
    """
    if not table.net.langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    if len(table.index) > TABLE_WORDS:
        table.clear()
    words = [words_of((t or "").encode("utf-8", "replace")) for t in texts]
    table.learn(set().union(*words))
    place, k = table.index.__getitem__, len(table.net.langs)
    langs, scores = [], []
    for t, own in zip(texts, words, strict=True):
        if not own or not any(map(str.isalpha, t or "")):
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        total = table.rows[np.fromiter(map(place, own), np.int64, len(own))].sum(axis=0)
        mean = 8 * total[:k] / max(1.0, total[2 * k])
        p = np.exp(mean - mean.max())
        p /= p.sum()
        best = int(np.argmax(p))
        langs.append(table.net.langs[best])
        scores.append(float(p[best]))
    return langs, scores


def drawn_words(text: str, most: int) -> Column:
    """Up to ``most`` words of the whole text, those with the lowest hash of word and place, joined by spaces."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    ordered = F.array_sort(F.transform(words, lambda w, i: F.struct(F.xxhash64(w, i).alias("h"), w.alias("w"))))
    return F.array_join(F.transform(F.slice(ordered, 1, most), lambda x: x["w"]), " ")


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fold: int = 2, folds: int = 4, sample_rows: int = 300, sample_words: int = 300) -> Network:
    """A network from at most about ``sample_rows`` texts of each language outside the held-out fold.

    The rows with the lowest id hash are taken, and ``sample_words`` words of
    each, drawn from the whole text by a hash; the driver gets one count per
    language and these words. No labelled text: no languages, and every text is ``und``.
    """
    known = docs.where(column(lang_column).isNotNull() & column(text_column).isNotNull() & ~in_fold(id_column, fold, folds))
    known = known.select(column(id_column).cast("string").alias("id"), column(lang_column).cast("string").alias("lang"), column(text_column).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return initial([])
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, 1.2 * sample_rows / n) * (1 << 20)) + 1).otherwise(share)
    order = F.pmod(F.xxhash64(F.lit("langid"), F.coalesce("id", F.lit(""))), F.lit(1 << 20))
    chosen = known.where(order < share).select("lang", order.alias("at"), drawn_words("text", sample_words).alias("text"))
    rows = sorted(chosen.limit(2 * sample_rows * len(counts)).collect(), key=lambda r: (r["lang"], r["at"], r["text"]))
    taken: dict[str, int] = {}
    texts = []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= sample_rows:
            texts.append((r["lang"], r["text"].encode("utf-8", "replace")))
    return train(texts)


def with_language(df: DataFrame, net: Network, text_column: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with predicted language and its probability. Columns named like the results are replaced.

    Null, empty and letterless texts: ``und``, 0. Ties go to the language that
    sorts first. Whole texts of any length are read, slice by slice; rows that repeat get the same answer.

    A word's positions depend on the word's bytes alone, so each distinct word of
    a slice of texts runs through the network once.
    """

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordTable(net)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            texts, run, held = batch.to_pylist(), [], 0
            for i, t in enumerate(texts):
                run.append(t)
                held += len(t or "")
                if held >= SLICE_CHARS or i == len(texts) - 1:
                    a, b = identify(table, run)
                    langs += a
                    scores += b
                    run, held = [], 0
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    others = [column(c) for c in df.columns if c.lower() not in (lang.lower(), score.lower())]
    held = free_name(df, "_found")
    made = df.select(*others, predicted(column(text_column).cast("string")).alias(held))
    return made.select(*others, F.col(f"{held}.lang").alias(lang), F.col(f"{held}.score").alias(score))
