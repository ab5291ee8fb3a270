"""The registered queries against their statements, and the pipeline against plain versions of its stages."""

import pytest
from pyspark.sql import functions as F
from llm_brute import contamination, simhash, smallest_reachable
from compare import difference, open_tables

import corpus_pipeline
from ticketloom.llm import oracle, pieces, queries


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_statement(spark, small, name):
    assert difference(queries.QUERIES[name](spark, small), open_tables(small), oracle.STATEMENTS[name]) is None


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, small)
    kept = {r.doc_id for r in queries.op9_quality_classifier(spark, small).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in good.collect()}
    assert set(texts) == kept and good.columns == docs.columns
    prints = {k: simhash(t) for k, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    first = {k for k, c in smallest_reachable(texts, links).items() if k == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {k for k in first if not contamination(texts[k], items)[1]}
    out = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in out} == clean and len(out) == len(clean)
    model = pieces.processor(queries.piece_model())
    assert all(r.n_tokens == len(r.ids) and model.encode(r.decoded) == list(r.ids) for r in out)


def test_pipeline_gives_back_columns_of_any_name(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    extra = ["id", "first", "fingerprint", "hits", "n_hit", "n_words", "hit_items", "spans", "score", "_text", "_id", "component_id", "ids", "a.b"]
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), (None, "a b c", None, None, 5)], docs.schema)
    wide = docs.unionByName(odd).select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in extra])
    for stage in (s for _, s in corpus_pipeline.STAGES[:-1]):
        out = stage(spark, wide, small)
        assert out.columns == wide.columns and out.dtypes == wide.dtypes
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in extra)
        narrow = stage(spark, docs.unionByName(odd), small)
        assert sorted(map(str, narrow.collect())) == sorted(str(r) for r in out.select(*docs.columns).collect())
    last = corpus_pipeline.STAGES[-1][1](spark, wide, small).collect()
    assert len(last) == 63 and {(r.n_tokens, r.decoded) for r in last if r.doc_id in (10**6, 10**6 + 1)} == {(0, "")}


def test_pipeline_of_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.collect() == []
        docs = out if out.columns == docs.columns else docs
