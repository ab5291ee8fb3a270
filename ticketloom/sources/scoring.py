"""The model-call stage: a user-supplied scorer over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RESULT_FIELDS = [
    T.StructField("tool_input_json", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("model", T.StringType()),
]

Scorer = Callable[[list[str]], Iterable[dict[str, Any]]]


def score_batches(prompts: DataFrame, make_scorer: Callable[[], Scorer], carry: list[str] | None = None) -> DataFrame:
    """Prompts with the scorer's results: ``(ticket_id, *carry, tool_input_json, error_type, ...)``.

    ``make_scorer`` runs once per task and returns a function from a list of
    prompt texts to one result dict each (keys as in ``RESULT_FIELDS``, absent
    ones NULL); client, retries and rate limits live in it. A scorer that
    raises fails the task, and Spark retries it. ``carry`` passes columns
    through, so the result needs no join back. Model calls are not
    repeatable: write this frame out (or checkpoint it) before using it twice.
    """
    carried = ["ticket_id", *(carry or [])]
    names = [f.name for f in RESULT_FIELDS]
    schema = T.StructType([prompts.schema[c] for c in carried] + RESULT_FIELDS)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        scorer = make_scorer()
        for batch in batches:
            results = list(scorer(batch["prompt"].tolist()))
            if len(results) != len(batch):
                raise ValueError("the scorer must return one result per prompt")
            out = batch[carried].reset_index(drop=True)
            for name in names:
                out[name] = pd.Series([r.get(name) for r in results], dtype="object")
            yield out

    return prompts.select(*carried, "prompt").mapInPandas(run, schema)
