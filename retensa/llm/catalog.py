"""Queries of the training-data operators and their DuckDB SQL, where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, collocations, decontaminate, line_dedup, packing, partenum, pii,
               quality_classifier, quality_rules, sharding, sql, token_files, warc, whitening)
from .common import read_table
from .files import read_tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

END_ID = 2


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn
    return add


@query(sql.WARC)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


@query(sql.DECONTAMINATION)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"),
                                             read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"),
                               read_table(spark, sf_dir, "labels"))


@query()
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query()
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(read_table(spark, sf_dir, "documents"),
                                          public_tokenizers.path("word_bpe_49k.json"), END_ID)
    index = token_files.build_index(files)
    found = token_files.find(index, files.documents.select("doc_id", "repeat"))
    ids, documents = files.documents.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    return token_files.read_documents(files.folder, found, files.item_bytes,
                                      read_tasks(ids * files.item_bytes, documents))


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(read_table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(read_table(spark, sf_dir, "documents"),
                                              read_table(spark, sf_dir, "labels"))


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(read_table(spark, sf_dir, "documents"))


@query()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


@query(sql.LINE_DEDUP)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeat_digests(read_table(spark, sf_dir, "documents"))


@query()
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)
    return packed.places.drop("part", "rank")


@query(sql.COLLOCATIONS)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a deviation beyond 64 bits (over about 2 million distinct vectors) is null here; the
    # operator's own column is a decimal of 38 digits
    return whitening.whiten(read_table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.expr("try_cast(deviation AS bigint)"))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
