"""Spelling variants: words one edit apart, found by pivotal bigrams; DataFrame functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import column, forget, sized, stored

LETTERS = "A-Za-zÀ-ÿ"
#: Three bigrams hold two disjoint ones, and one edit spoils at most one of two disjoint bigrams.
PREFIX = 3
#: Letters at either end of a word that two words share unless the edit lies there.
END = 2


def runs_of(docs: DataFrame, id_column: str, text_column: str, least_length: int, every: int) -> DataFrame:
    """One row ``word`` per run of letters, A-Z lower-cased, with one code point taken out where the crc32 rule says so.

    The rule: if ``every`` divides h = crc32("<id>:<lower-cased run>"), the code
    point at h modulo the run's length goes. Runs shorter than ``least_length``
    cannot give a word and are left out at once.
    """
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    rows = docs.select(F.coalesce(column(id_column).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("raw"))
    rows = rows.select("id", F.translate("raw", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    thinned = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % every == 0, thinned).otherwise(F.col("run")).alias("word"))


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = 6, least_count: int = 5, every: int = 199
) -> DataFrame:
    """``(word, n)`` of the words of at least ``least_length`` code points that occur ``least_count`` times or more in all."""
    words = runs_of(docs, id_column, text_column, least_length, every).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def pivots(prefix: Column) -> Column:
    """The two disjoint grams of a prefix with the least summed frequency, as an array; by dynamic programming over places.

    The state of the pass: the best pair so far, the best gram that cannot
    overlap the next one, and the gram just seen.
    """
    gram = "struct<f:bigint,gram:string,at:int>"
    pair = f"struct<cost:bigint,a:{gram},b:{gram}>"
    nothing = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("best", pair), ("ready", gram), ("seen", gram))])

    def step(state: Column, x: Column) -> Column:
        free = F.least(state["ready"], state["seen"])
        before = F.when(state["seen"]["at"] <= x["at"] - 2, free).otherwise(state["ready"])
        both = F.struct((before["f"] + x["f"]).alias("cost"), before.alias("a"), x.alias("b"))
        best = F.least(state["best"], F.when(before.isNotNull(), both))
        return F.struct(best.alias("best"), free.alias("ready"), x.alias("seen"))

    by_place = F.array_sort(prefix, lambda a, b: a["at"] - b["at"])
    return F.aggregate(by_place, nothing, step, lambda state: F.array(state["best"]["a"], state["best"]["b"]))


def indexed(words: DataFrame) -> DataFrame:
    """Each word with ``prefix``, its rarest grams ``(f, gram, at)``, and its two ``pivots`` among them.

    Grams are ordered by the number of places that hold them, then by
    themselves. The prefix is every gram up to the third in that order, ties
    included. Words of fewer than four letters have no three grams and are left out.
    """
    letters = words.select("word", F.split("word", "").alias("letters")).where(F.size("letters") > PREFIX)
    grams = F.transform(F.sequence(F.lit(0), F.size("letters") - 2), lambda i: F.concat(F.col("letters")[i], F.col("letters")[i + 1]))
    places = letters.select("word", F.posexplode(grams).alias("at", "gram"))
    frequency = stored(places.groupBy("gram").agg(F.count(F.lit(1)).alias("f")), "variants-grams")
    known = places.join(sized(frequency), "gram")
    every = known.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("f", "gram", "at"))).alias("grams"))
    every = every.withColumn("last", F.struct(F.col("grams")[PREFIX - 1]["f"].alias("f"), F.col("grams")[PREFIX - 1]["gram"].alias("gram")))
    prefix = F.filter("grams", lambda g: F.struct(g["f"].alias("f"), g["gram"].alias("gram")) <= F.col("last"))
    return every.select("word", "last", prefix.alias("prefix")).select("word", "prefix", pivots(F.col("prefix")).alias("pivots"))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near)`` in both directions: pairs that differ by exactly one inserted, deleted or replaced code point.

    words: one column ``word``, distinct. Of two near words, the one whose
    prefix ends earlier in the order of grams has a pivot that the edit spares,
    and the other has that gram in its prefix, at most one place further on. An
    edit before the second pivot leaves that pivot and all behind it alone, any
    other one leaves the first pivot and all before it. Words meet on gram,
    length, place, the text of that side and both ends; near words whose ends
    differ were edited there, and meet on all the rest. Each pair that meets is
    compared; a hash of what they meet on only saves room.
    """
    index = stored(indexed(words), "variants-index")
    word, size = F.col("word"), F.length("word")
    ends = F.concat(F.left(word, F.lit(END)), F.right(word, F.lit(END)))

    def before(at: Column) -> Column:
        return F.substring(word, F.lit(1), at)

    def after(at: Column) -> Column:
        return F.substring(word, at + 3, size)

    def met(side: str, gram: Column, at: Column, length: Column, text: Column) -> Column:
        return F.xxhash64(F.lit(side), gram, at, length, text, ends)

    def cut(side: str, length: Column, kept: Column) -> Column:
        return F.xxhash64(F.lit(side), length, F.left(word, kept) if side == "tail" else F.right(word, kept))

    first, second, g = F.col("pivots")[0], F.col("pivots")[1], F.col("g")
    pivot = index.select("word", F.explode(F.array(
        *[met("before", first["gram"], first["at"], size + l, before(first["at"])) for l in (-1, 0, 1)],
        *[met("after", second["gram"], second["at"] + l, size + l, after(second["at"])) for l in (-1, 0, 1)],
        *[cut(side, size, size - END) for side in ("head", "tail")],
    )).alias("meet"))
    prefix = index.select("word", F.explode("prefix").alias("g")).select("word", F.explode(F.array(
        met("before", g["gram"], g["at"], size, before(g["at"])), met("after", g["gram"], g["at"], size, after(g["at"])),
    )).alias("meet"))
    edges = index.select("word", F.explode(F.array(*[cut(side, size + l, size + l - END) for side in ("head", "tail") for l in (-1, 0, 1)])).alias("meet"))
    near = prefix.union(edges).distinct().withColumnRenamed("word", "near")
    found = pivot.join(near, "meet").where(word != F.col("near")).where(F.levenshtein("word", "near", 1) == 1).select("word", "near")
    return found.union(found.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def followed(links: DataFrame) -> DataFrame:
    """``(word, root)``: from each word along its form to the last; by doubling the steps until nothing moves.

    links: ``(word, form)``, at most one row a word, without circles (a form
    here is at least five times as frequent as its word). The rounds grow with
    the logarithm of the longest chain; each round's result is a stored table.
    """
    now = stored(links.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(further, "root", "left_semi").isEmpty():
            return now
        last = now
        now = stored(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "variants-roots")
        forget(last)


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table ``(word, n)``, one row a word.

    n_near counts the words one edit away. form is the most frequent of them
    (ties: the smallest in code-point order) if its n is at least ``ratio``
    times the word's own n, else null; root follows forms to the last. Null
    words are left out; rows that repeat a word are added up; other columns are
    left out. An empty table gives none. Words of fewer than four letters have
    no near words here.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words, or chains may be circles")
    words = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    words = stored(words, "variants-words")
    pairs = near_words(words.select("word")).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("top")
    )
    best = words.join(best, "word", "left").withColumn("form_n", -F.col("top.less"))
    follows = F.col("form_n") >= ratio * F.col("n")
    known = best.select(
        "word", F.when(follows, F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(follows, F.col("form_n")).alias("form_n"),
    )
    known = stored(known, "variants-forms")
    roots = followed(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``variant_groups`` of the words of whole texts.

    Null text: no words. A null id counts as an empty one in the crc32 rule.
    Rows that repeat an id or a text count each. Texts of any length: a run
    costs one row, counted before it is shuffled, so a hot word is one row a
    task. Columns other than the two named are never read.
    """
    return variant_groups(word_counts(docs, id_column, text_column))
