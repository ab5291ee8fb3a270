"""Quality classifier by compression with dictionaries built from good and bad labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import column, stored, utf8

PIECE = 1024
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
TRAINING_BYTES = 4 << 10
FOLDS = 5


def in_fold(id_column: str, fold: int = 0, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(column(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Model:
    """Two dictionaries and the calibration: weights of the scaled features, the last for the constant."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where the texts are too few to train one, their ends as plain content."""
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


class Compressors:
    """Compressed sizes of a text under the good, the bad and no dictionary, piece by piece, so long texts keep the contrast."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.each = []
        for d in (good, bad, b""):
            if len(d) < 8:
                self.each.append(zstandard.ZstdCompressor(**plain))
                continue
            dictionary = zstandard.ZstdCompressionDict(d)
            dictionary.precompute_compress(LEVEL)
            self.each.append(zstandard.ZstdCompressor(dict_data=dictionary, **plain))

    def features(self, data: bytes) -> list[float]:
        """The normalised difference of the two sizes, and the size without dictionary per byte; neither grows with the text."""
        pieces = _pieces(data)
        good, bad, alone = (sum(len(c.compress(p)) for p in pieces) for c in self.each)
        return [(bad - good) / (bad + good), alone / (len(data) + 20)]


def calibrate(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by damped Newton steps; the constant alone where there are no rows or one class."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(2), np.ones(2))
    w = np.zeros(3)
    share = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return mean, scale, w
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    ridge = penalty * np.eye(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step / max(1.0, float(np.abs(step).max()) / 2)
    return mean, scale, w


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))] @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "quality", sample_rows: int = 6000, piece_bytes: int = TRAINING_BYTES,
) -> Model:
    """Dictionaries and calibration from at most ``sample_rows`` labelled rows outside fold 0, those with the lowest id hash.

    One half of the sample builds the dictionaries (of each text ``piece_bytes``
    from a drawn place), the other
    (whole texts, as they are scored) calibrates; it is compressed where it lies, and only its
    features come to the driver. Null labels, ids and texts teach nothing, and
    documents that share an id teach once, by the least text. No labelled rows:
    every text scores one half.
    """
    known = labels.select(column(id_column).alias("_id"), column(label_column).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.where(~in_fold("_id")).distinct()
    order = F.xxhash64(F.lit("quality"), F.col("_id").cast("string"))
    share = min(1.0, 1.5 * sample_rows / max(1, known.count()))
    chosen = known.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).withColumn("_order", order)
    chosen = chosen.orderBy("_order", "_id", "_y").limit(sample_rows)
    texts = docs.select(column(id_column).alias("_id"), utf8(column(text_column)).alias("_text"))
    found = texts.where(F.octet_length("_text") > 0).join(F.broadcast(chosen), "_id")
    sample = stored(found.groupBy("_order", "_id", "_y").agg(F.min("_text").alias("_text")), "quality-sample")
    building = F.shiftright("_order", 20).bitwiseAND(F.lit(1)) == 0
    room = F.greatest(F.octet_length("_text") - piece_bytes + 1, F.lit(1))
    drawn = F.substring("_text", F.pmod(F.xxhash64(F.lit("piece"), "_id"), room).cast("int") + 1, F.lit(piece_bytes))
    built = sample.where(building).select("_order", "_y", drawn.alias("_text")).collect()
    built.sort(key=lambda r: (r["_order"], r["_y"], bytes(r["_text"])))
    good, bad = (build_dictionary([bytes(r["_text"]) for r in built if r["_y"] == c]) for c in (1, 0))

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Compressors(good, bad)
        for batch in batches:
            yield pa.array([sizes.features(t.as_py()) for t in batch], pa.list_(pa.float64()))

    held = sorted(sample.where(~building).select("_order", "_y", features("_text").alias("x")).collect())
    x = np.array([r["x"] for r in held]).reshape(-1, 2)
    return Model(good, bad, *calibrate(x, np.array([r["_y"] for r in held], dtype=float)))


def with_score(df: DataFrame, model: Model, text_column: str = "text", into: str = "score") -> DataFrame:
    """The rows with the probability that their whole text is good; a null text is scored as an empty one.

    A column of the result's name is replaced.
    """

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Compressors(model.good, model.bad)
        for batch in batches:
            x = np.array([sizes.features(t.as_py()) for t in batch]).reshape(-1, 2)
            yield pa.array(probability(model, x), pa.float64())

    return df.withColumn(into, scores(utf8(column(text_column))))
