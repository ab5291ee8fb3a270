"""SentencePiece encoding and decoding with a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import column, free_name

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_CHARS = 8 << 20
SLICE_CHARS = 1 << 20


def processor(model_path: str) -> sentencepiece.SentencePieceProcessor:
    """The model; refused unless its pieces cannot cross a white-space marker and its text is taken as it is."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    crossing = re.compile(f"[^{MARK}]{MARK}")
    if any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("pieces of this model cross white-space markers; words can't be segmented one by one")
    probe = "  Ａ  b "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("this model changes its input; words can't be segmented one by one")
    return model


class ChunkTable:
    """Ids and decoded text of each distinct chunk: a run of markers and the word behind it, less the first marker."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        self.model = model
        self.mark = model.piece_to_id(MARK)
        self.lead = model.encode("a")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.flat: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.chars = 0

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.index]
        if not new:
            return
        found = [x if c else [self.mark] for c, x in zip(new, self.model.encode(new, num_threads=1), strict=True)]
        for c in new:
            self.index[c] = len(self.index)
        self.text.extend(x[1:] for x in self.model.decode([[*self.lead, *x] for x in found], num_threads=1))
        self.size.append(np.fromiter(map(len, found), np.int64, len(found)))
        self.flat.append(np.concatenate([np.asarray(x, np.int32) for x in found]))
        self.chars += sum(map(len, new)) + 8 * len(new)


def chunks_of(text: str) -> list[str]:
    """The marked words of a text in order, each without its first marker; an empty text has none."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    words = marked.split(MARK)
    if "" not in words:
        return words
    return [c[1:] for c in _CHUNK.findall(MARK + marked)]


def encode_slice(table: ChunkTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Ids of all texts in one array, the ends of each text's ids, and the decoded texts."""
    if table.chars > TABLE_CHARS:
        table.clear()
    words = [chunks_of(t) for t in texts]
    table.learn(set().union(*words))
    place, shown = table.index.__getitem__, table.text.__getitem__
    at = [list(map(place, w)) for w in words]
    decoded = ["".join(map(shown, a))[1:] for a in at]
    counts = np.fromiter(map(len, at), np.int64, len(at))
    every = np.concatenate([np.asarray(a, np.int64) for a in at]) if at else np.zeros(0, np.int64)
    flat = np.concatenate(table.flat) if table.flat else np.zeros(0, np.int32)
    size = np.concatenate(table.size) if table.size else np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    n = size[every]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    ids = flat[np.repeat(begin[every] - (ends - n), n) + np.arange(total)]
    last = np.concatenate([[0], ends])[np.cumsum(counts)]
    return ids, last, decoded


def slices(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of neighbouring texts of about ``most`` characters."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def with_pieces(df: DataFrame, text_column: str, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the ids of their text (array of int) and the text that decode(ids) gives.

    Exactly the library's encoding without begin or end ids and without
    sampling. Pieces never cross a marker, so each distinct marked word of a
    slice of texts is segmented once, and the ids join back by the word's
    position in the text. The table of words is held by a worker for the next
    slices and emptied past a size bound; that costs time, not results. Null
    text: no ids, empty text. Columns named like the results are replaced.
    """

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(processor(model_path))
        for batch in batches:
            # Each slice goes out by itself: a whole batch's ids and texts beside its input would be the worker's peak.
            for texts in slices([x or "" for x in batch.to_pylist()], SLICE_CHARS):
                flat, last, shown = encode_slice(table, texts)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], last]).astype(np.int32), pa.array(flat, pa.int32()))
                yield pa.StructArray.from_arrays([lists, pa.array(shown, pa.string())], names=["ids", "decoded"])

    others = [column(c) for c in df.columns if c.lower() not in (ids.lower(), decoded.lower())]
    held = free_name(df, "_pieces")
    made = df.select(*others, pieces(column(text_column).cast("string")).alias(held))
    return made.select(*others, F.col(f"{held}.ids").alias(ids), F.col(f"{held}.decoded").alias(decoded))
