"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds; DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.llm import boosting, planted
from ticketloom.llm.common import column, free_name, materialized, row_key, same_row, stored

KEYWORDS = r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)"
INTRODUCED = KEYWORDS + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
#: Base kinds in their listed order, then the added ones. Possessive repeats and look-behinds find the same leftmost
#: matches as the plain patterns, without trying every start in a long run and without deep recursion.
GENERATORS: dict[str, str] = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?i)(?<![a-z0-9]){INTRODUCED}[^\s\"']{{6,}}?(?=[.,;:)\]}}>]*(?:[\s\"']|\z))",
    "hex_token": r"(?<![A-Za-z0-9])[0-9a-fA-F]{24,}+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = list(GENERATORS)
BASE = ("email", "ip", "card", "phone")
CUES = r"(?i)(mail|contact|call|tel|phone|mobile|fax|card|visa|pay|account|iban|bank|ssn|social|token|key|secret|password|login|server|host|addr)"
VERSIONS = r"(?i)(version|release|section|chapter|\bv)\.?\s*$"
CONTEXT = 24
#: What the same score may differ by between numpy and SQL.
ROUNDING = 1e-9


def _luhn(digits: Column) -> Column:
    """Sum over a string of at most 19 digits, every second from the right doubled."""
    each = F.split(F.reverse(digits), "")
    worth = F.transform(
        each,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(worth, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _octets(hit: Column) -> Column:
    """No part above 255, leading zeros aside."""
    return hit.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def letter_levels(docs: DataFrame, text_column: str) -> tuple[str, list[str]]:
    """How rare each pair of letters is in all texts, and 2,000 words, drawn from all, to fill planted sentences.

    One digit for each of the 676 pairs a-z, in order: bits of surprise at the
    second letter, 9 at most. A corpus without words gives 5 for all. Every
    text is counted whole, its words map-side first; the driver gets the pairs'
    counts and the drawn words (all, if there are fewer).
    """
    text = F.lower(F.coalesce(column(text_column).cast("string"), F.lit("")))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit("(?<![a-z])[a-z]{4,40}(?![a-z])"), F.lit(0))).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = stored(words, "pii-words")
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"), "n")
    counts = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    # A keyword among the filling words would introduce values that the sentence does not mean.
    filling = words.where(~F.col("word").rlike(KEYWORDS))
    some = [r.word for r in filling.orderBy(F.xxhash64("word"), "word").limit(2000).collect()]
    letters = "abcdefghijklmnopqrstuvwxyz"
    levels = []
    for a in letters:
        total = sum(counts.get(a + b, 0) for b in letters)
        levels += [min(9, round(np.log2((total + 26) / (counts.get(a + b, 0) + 1)))) if counts else 5 for b in letters]
    return "".join(map(str, levels)), some


def surprise(value: Column, levels: str) -> Column:
    """Mean rarity of the neighbouring letters of a value, times ten; marks and digits between them are passed over."""
    letters = F.regexp_replace(F.lower(value), "[^a-z]", "")

    def level(i: Column) -> Column:
        at = (F.ascii(F.substring(letters, i, F.lit(1))) - 97) * 26 + F.ascii(F.substring(letters, i + 1, F.lit(1))) - 97
        return F.substring(F.lit(levels), at + 1, F.lit(1)).cast("int")

    total = F.aggregate(F.sequence(F.lit(1), F.length(letters) - 1), F.lit(0), lambda a, i: a + level(i))
    return F.when(F.length(letters) > 1, F.floor(10 * total / (F.length(letters) - 1)).cast("int")).otherwise(90)


def candidates(docs: DataFrame, id_column: str, text_column: str, levels: str) -> DataFrame:
    """One row per proposed span: row key, kind, start and end in code points, whether the base rule takes it, features.

    Each generator's matches and the text between them alternate, so a running
    sum of their lengths over one document gives the places. Only documents that
    have a match, and of those only lengths and short contexts, are shuffled.
    """
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    rows = docs.select(*row_key(id_column, text_column), text.alias("text"))
    digit, at = F.col("text").rlike("[0-9]"), F.col("text").contains("@")
    needs = {"email": at, "secret": F.col("text").rlike(f"(?i){KEYWORDS}")}
    found = rows.where(digit | at | needs["secret"]).select(
        "*",
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("no"), F.when(needs.get(kind, digit), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("hits"))
            for k, (kind, p) in enumerate(GENERATORS.items())
        ])).alias("g"),
    ).where("size(g.hits) > 0")
    between = F.lit(None)
    for k, p in enumerate(GENERATORS.values()):
        between = F.when(F.col("g.no") == k, F.split("text", p, -1)).otherwise(between)
    parts = found.select("_id", "_digest", F.col("g.no").alias("no"), F.posexplode(F.arrays_zip(between.alias("gap"), F.col("g.hits").alias("hit"))).alias("at", "z"))
    parts = parts.select(
        "_id", "_digest", "no", "at", F.col("z.hit").alias("hit"), F.length("z.gap").alias("gap"),
        F.right("z.gap", F.lit(CONTEXT)).alias("before"), F.left("z.gap", F.lit(CONTEXT)).alias("head"),
    )
    # Rows that repeat id and text give the same parts; one of each stays.
    parts = parts.dropDuplicates(["_id", "_digest", "no", "at"])
    line = Window.partitionBy("_id", "_digest", "no").orderBy("at")
    upto = F.sum(F.col("gap") + F.coalesce(F.length("hit"), F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    spans = parts.select("*", upto.alias("end"), F.lead("head").over(line).alias("after")).where("hit IS NOT NULL")
    hit, digits = F.col("hit"), F.regexp_replace("hit", "[^0-9]", "")
    spans = materialized(spans, digits=digits, n_digits=F.length(digits))
    short_number = F.col("n_digits").between(12, 19)
    spans = materialized(
        spans,
        f_luhn=F.coalesce(F.when(short_number, _luhn(F.col("digits"))), F.lit(False)).cast("int"),
        f_octets=F.coalesce(F.when(F.col("no") == 1, _octets(hit)), F.lit(False)).cast("int"),
    )
    base = (
        F.when(F.col("no") == 0, True).when(F.col("no") == 1, F.col("f_octets") == 1)
        .when(F.col("no") == 2, F.col("f_luhn") == 1).when(F.col("no") == 3, F.col("n_digits").between(9, 15)).otherwise(False)
    )
    letters = F.length(F.regexp_replace("hit", "[^A-Za-z]", ""))
    secret = F.col("no") == KINDS.index("secret")
    spans = materialized(spans, value=F.when(secret, F.regexp_replace("hit", f"(?i)^{INTRODUCED}", "")))

    def of_value(x: Column) -> Column:
        return F.coalesce(F.when(secret, x.cast("int")), F.lit(0))

    return spans.select(
        "_id", "_digest", F.col("no").cast("int").alias("no"),
        (F.col("end") - F.length("hit")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), base.alias("base"),
        F.length("hit").alias("f_length"), F.col("n_digits").alias("f_digits"), letters.alias("f_letters"), "f_luhn", "f_octets",
        F.size(F.array_distinct(F.split("hit", ""))).alias("f_distinct"),
        of_value(F.size(F.array_distinct(F.split("value", "")))).alias("f_value"),
        of_value(F.col("value").rlike("^[A-Za-z]?[a-z]+$")).alias("f_word"),
        of_value(surprise(F.col("value"), levels)).alias("f_surprise"),
        of_value(hit.rlike(f"(?i)^{KEYWORDS}[\"']?\\s{{0,3}}(?:=|[:]\\s{{0,3}}[\"'])")).alias("f_assigned"),
        F.coalesce(F.col("after").rlike(r"^[.,;:]?\s+[a-z]"), F.lit(False)).cast("int").alias("f_prose"),
        (F.length("hit") - F.col("n_digits") - letters).alias("f_marks"),
        F.col("before").rlike(r"[A-Za-z0-9]$").cast("int").alias("f_joined_left"),
        F.coalesce(F.col("after").rlike(r"^[A-Za-z0-9]"), F.lit(False)).cast("int").alias("f_joined_right"),
        (F.col("before").rlike(CUES) | hit.rlike(CUES)).cast("int").alias("f_cue"),
        F.col("before").rlike(VERSIONS).cast("int").alias("f_version"),
        F.when(F.col("no") == KINDS.index("national_id"), hit.rlike("^(?:000|666|9)|-00-|-0000$")).otherwise(hit.rlike(r"^\(?[01]")).cast("int").alias("f_unassigned"),
        *[(F.col("no") == k).cast("int").alias(f"f_{kind}") for k, kind in enumerate(KINDS)],
    )


FEATURES = [
    "f_length", "f_digits", "f_letters", "f_luhn", "f_octets", "f_distinct", "f_value", "f_word", "f_surprise", "f_assigned", "f_prose",
    "f_marks", "f_joined_left", "f_joined_right",
    "f_cue", "f_version", "f_unassigned", *[f"f_{k}" for k in KINDS],
]


@dataclass
class Detector:
    """Trees, a threshold per kind, and on the held-out sentences (precision, recall) per kind."""

    model: boosting.Boosted
    cuts: dict[int, float]
    quality: dict[str, tuple[float, float]]


def fit_model(spark: SparkSession, levels: str, words: list[str], precision: float = 0.97) -> Detector:
    """Trees and thresholds from planted texts whose answers are known.

    Planted values are made of the corpus's words or drawn, and stand in
    sentences of its words. A candidate is personal data if it covers a planted
    value that is; all others are not. Trees grow on one half of the sentences;
    on the other half, which has none of them, each kind's threshold is the
    least score that holds ``precision``. A kind without examples takes 0.5.
    """
    rows = planted.texts(words)
    truth = {i: (start, end, personal, held) for i, _, start, end, personal, held in rows}
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = candidates(frame, "doc_id", "text", levels).select("_id", "no", "start", "end", *[F.col(f).cast("double") for f in FEATURES]).collect()
    x = np.array([r[4:] for r in found], dtype=float).reshape(-1, len(FEATURES))
    no = np.array([r.no for r in found], int)
    place = [truth[r._id] for r in found]
    y = np.array([p[2] and r.start <= p[0] and p[1] <= r.end <= p[1] + 1 for r, p in zip(found, place, strict=True)], float)
    held = np.array([p[3] for p in place], bool)
    model = boosting.fit(x[~held], y[~held])
    scores = model.probability(x)
    cuts, quality = {}, {}
    for k, kind in enumerate(KINDS):
        own = held & (no == k)
        cuts[k] = boosting.threshold(scores[own], y[own], precision) - ROUNDING if own.any() else 0.5
        chosen = own & (scores >= cuts[k])
        if own.any() and kind not in BASE:
            quality[kind] = (float(y[chosen].mean()) if chosen.any() else 1.0, float(y[chosen].sum() / max(1.0, y[own].sum())))
    return Detector(model, cuts, quality)


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with ``spans``: an array of (start, no, end, kind, base, score) by start and kind, in code points, end exclusive.

    ``head`` marks the first span of each run of overlapping spans, ``run_end`` is where its run ends.

    Spans that the base rules take always stay. Others stay if the trees score
    them at their kind's threshold and no base span covers them. Spans may
    overlap. Null or empty text: no spans. Rows that repeat id and text get the
    same spans. An input column ``spans`` is replaced. Texts of any length are
    searched whole, and letter statistics come from all of them.
    """
    own = [c for c in docs.columns if c.lower() != "spans"]
    levels, words = letter_levels(docs, text_column)
    detector = fit_model(docs.sparkSession, levels, words)
    found = stored(candidates(docs, id_column, text_column, levels), "pii-candidates")
    model, cuts = detector.model, detector.cuts
    cut = F.element_at(F.array(*[F.lit(cuts[k]) for k in range(len(KINDS))]), F.col("no") + 1)
    scored = found.withColumn("score", F.expr(model.sql(FEATURES)))
    line = Window.partitionBy("_id", "_digest").orderBy("start", F.col("base").desc(), "no").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(line) >= F.col("end"), F.lit(False))
    chosen = scored.where(F.col("base") | (F.col("score") >= cut)).withColumn("covered", covered).where("base OR NOT covered")
    place = Window.partitionBy("_id", "_digest").orderBy("start", "no")
    head = F.coalesce(F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    chosen = chosen.withColumn("head", head)
    chosen = chosen.withColumn("run", F.sum(F.col("head").cast("int")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = chosen.withColumn("run_end", F.max("end").over(Window.partitionBy("_id", "_digest", "run")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("no") + 1)
    spans = chosen.groupBy("_id", "_digest").agg(
        F.sort_array(F.collect_list(F.struct("start", "no", "end", kind.alias("kind"), "base", "score", "head", "run_end"))).alias("spans")
    )
    held = [f"_own_{i}" for i in range(len(own))]
    keyed = docs.select(*[column(c).alias(h) for c, h in zip(own, held, strict=True)], *row_key(id_column, text_column))
    empty = F.expr("cast(array() as array<struct<start:int,no:int,end:int,kind:string,base:boolean,score:double,head:boolean,run_end:int>>)")
    # By shuffling at every size: what is broadcast would grow with the documents that have spans.
    return keyed.join(spans.hint("shuffle_hash"), same_row(keyed, spans), "left").select(
        *[F.col(h).alias(c) for c, h in zip(own, held, strict=True)], F.coalesce(spans["spans"], empty).alias("spans")
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans(spans: Column, kind: str | None = None) -> Column:
    """The spans that the base rules take, of one kind or of all."""
    return F.filter(spans, lambda s: s["base"] if kind is None else s["base"] & (s["kind"] == kind))


def redacted(docs: DataFrame, text_column: str = "text", spans: str = "spans") -> DataFrame:
    """The text with each run of overlapping spans replaced by its first span's kind in brackets."""
    text, some = column(text_column), F.size(spans) > 0
    runs, ends = free_name(docs, "_runs"), free_name(docs, "_ends")
    held = materialized(docs, **{runs: F.when(some, F.filter(spans, lambda s: s["head"]))})
    held = materialized(held, **{ends: F.when(some, F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["run_end"])))})
    parts = F.transform(
        runs, lambda r, i: F.concat(F.substring(text, F.col(ends)[i] + 1, r["start"] - F.col(ends)[i]), F.lit("["), F.upper(r["kind"]), F.lit("]"))
    )
    tail = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
    new = F.when(some, F.concat(F.array_join(parts, ""), tail)).otherwise(text)
    return held.select(*[new.alias(c) if c == text_column else column(c) for c in docs.columns])
