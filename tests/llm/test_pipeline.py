"""The pipeline's stages on small tables, and its result against the stages' brute force."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from retensa.llm import byte_bpe, quality_rules

from ..conftest import SF_SMALL
from . import brute


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select(
        "item_id", "text").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).where("kept").collect()}
    alive = [(d, t) for d, t in rows.items() if d in kept]
    alive = [(d, rows[d]) for d, n, c in brute.components(alive) if n == 0 or d == c]
    alive = [(b[0], rows[b[0]]) for b in brute.contamination(alive, items) if not b[-1]]
    expected = {d: t for d, t in alive}

    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF_SMALL)
        assert seen.columns == docs.columns and seen.dtypes == docs.dtypes
        seen = seen.cache()
    got = {r["doc_id"]: r for r in seen.collect()}
    assert got.keys() == expected.keys()
    base = {b[0]: b[6] for b in brute.spans(alive)}
    codec = byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for d, r in got.items():
        assert r["n_chars"] == len(r["text"])
        if not base[d] and "<" not in r["text"].replace(rows[d], ""):
            assert r["text"] == rows[d]
        for span in base[d]:
            kind, lo, hi = span.split(":")
            assert rows[d][int(lo):int(hi)] not in r["text"] and f"<{kind.upper()}>" in r["text"]
    last = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in last} == {
        d: codec.encode(r["text"]) for d, r in got.items()}


def test_clean_documents_pass_untouched(spark):
    seen = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(F.length("text") > 2000)
    assert corpus_pipeline.personal_data(spark, seen, SF_SMALL).count() == seen.count()
