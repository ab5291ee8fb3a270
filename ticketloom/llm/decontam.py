"""Benchmark decontamination: prefix-filtered join of item windows with document words, by DataFrame functions alone."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import column, materialized, row_key, same_row, sized, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def exact_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased. The first and the last may be empty, where the text has separators there."""
    return F.split(F.translate(text, ascii_uppercase, ascii_lowercase), SEPARATORS, -1)


def folded_words(text: Column) -> Column:
    """The same words, all letters lower-cased: equal words stay equal, each keeps its place, and it is much cheaper.

    The capital sigma alone is lower-cased by what stands around it, so it goes first.
    """
    return F.split(F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3"))), SEPARATORS, -1)


def _count(words: Column) -> Column:
    ends = F.when(F.size(words) == 1, (words[0] == "").cast("int")).otherwise(
        (words[0] == "").cast("int") + (F.element_at(words, -1) == "").cast("int")
    )
    return (F.size(words) - ends).cast("bigint")


def item_windows(items: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """Distinct windows ``window_text, folded, len, items``: every run of ``window`` words of an item, or all its words if fewer."""
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    words = items.select(
        column(id_column).cast("string").alias("item"),
        F.filter(exact_words(text), lambda w: w != "").alias("words"),
        F.filter(folded_words(text), lambda w: w != "").alias("folded"),
    ).where(F.size("words") > 0)
    starts = words.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))).alias("at"))
    cut = starts.select(
        "item", F.slice("words", F.col("at"), window).alias("words"), F.slice("folded", F.col("at"), window).alias("folded")
    )
    return cut.groupBy("words").agg(
        F.first("folded").alias("folded"), F.sort_array(F.collect_set("item")).alias("items")
    ).select(F.array_join("words", " ").alias("window_text"), "folded", F.size("words").alias("len"), "items")


def contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = 10,
) -> DataFrame:
    """One row per document row: its columns and ``n_words, n_hit, hit_items, hits``.

    A window is contained only if all its words are, so its rarest word by
    corpus count is a sufficient prefix: documents are joined with windows on
    that word alone. The word's place in the window bounds the start, the
    window's length bounds the end, and the words there are compared with the
    window's. ``hits``: start (in words, from 0) and length of each occurrence;
    ``n_hit``: words inside any; ``hit_items``: sorted ids of items with one.

    Null or empty text: no words, no hits. Items without words have no windows;
    an item with a null id marks words but is not listed. Repeated items and
    rows count once or each for itself, as they come. Input columns named like
    the results are replaced. The window tables are broadcast behind a check of
    their size; beyond it they are joined by shuffling.
    """
    made = ("n_words", "n_hit", "hit_items", "hits")
    own = [c for c in docs.columns if c.lower() not in made]
    windows = stored(item_windows(items, item_id, item_text, window), "decontam-windows")
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    keys = row_key(id_column, text_column)

    vocabulary = windows.select(F.explode("folded").alias("word")).distinct()
    occurring = docs.select(F.explode(folded_words(text)).alias("word")).join(sized(stored(vocabulary, "decontam-words")), "word")
    counts = stored(occurring.groupBy("word").count(), "decontam-counts")

    placed = windows.select("*", F.posexplode("folded").alias("offset", "word")).join(sized(counts), "word")
    rarest = F.min(F.struct("count", "word", "offset"))
    whole = placed.groupBy("window_text").agg(
        rarest.alias("p"), F.first("len").alias("len"), F.first("items").alias("items"), F.count(F.lit(1)).alias("found")
    ).where("found = len")
    anchors = stored(
        whole.select("p.word", F.struct(F.col("p.offset"), "len", "window_text", "items").alias("w"))
        .groupBy("word").agg(F.collect_list("w").alias("windows")),
        "decontam-anchors",
    )
    words = docs.select(*keys, F.posexplode(folded_words(text)).alias("at", "word"))
    starts = (
        words.join(sized(anchors), "word")
        .select("_id", "_digest", "at", F.explode("windows").alias("w"))
        .select("_id", "_digest", F.struct((F.col("at") - F.col("w.offset")).alias("start"), "w.len", "w.window_text", "w.items").alias("c"))
        .where("c.start >= 0")
    )
    candidates = starts.groupBy("_id", "_digest").agg(F.collect_set("c").alias("candidates"))

    held = [f"_own_{i}" for i in range(len(own))]
    keyed = docs.select(*[column(c).alias(h) for c, h in zip(own, held, strict=True)], text.alias("_text"), *keys)
    joined = keyed.join(candidates, same_row(keyed, candidates), "left").select(*held, "_text", "candidates")
    text = F.col("_text")
    some = F.col("candidates").isNotNull()
    read = materialized(joined, _words=F.when(some, exact_words(text)).otherwise(folded_words(text)))
    inside = F.filter(
        F.coalesce("candidates", F.expr("array()")),
        lambda c: (c["start"] + c["len"] <= F.size("_words"))
        & (F.array_join(F.slice("_words", c["start"] + 1, c["len"]), " ") == c["window_text"]),
    )
    read = materialized(read, _inside=F.when(some, inside).otherwise(F.slice("candidates", 1, 0)))
    lead = (F.col("_words")[0] == "").cast("int")
    positions = F.flatten(F.transform("_inside", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1)))
    return read.select(
        *[F.col(h).alias(c) for c, h in zip(own, held, strict=True)],
        _count(F.col("_words")).alias("n_words"),
        F.coalesce(F.size(F.array_distinct(positions)), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.transform("_inside", lambda c: c["items"])))), F.expr("cast(array() as array<string>)")).alias("hit_items"),
        F.transform("_inside", lambda c: F.struct((c["start"] - lead).alias("start"), c["len"].alias("len"))).alias("hits"),
    )
