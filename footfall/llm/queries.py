"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (
    bpe,
    exact_dedup,
    hard_negatives,
    language,
    line_dedup,
    packing,
    passages,
    prefix_trie,
    simhash,
    sketches,
    token_files,
    transducer,
    warc,
)
from footfall.llm.common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return warc.store_and_index(table(spark, folder, "pages"), Scratch(spark, "warc"))


@query
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact duplicates of ``documents``; the digest column is asked for all rows."""
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"), digest_all=True)


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return transducer.token_counts(table(spark, folder, "documents"), path, limit=4096)


@query
def op4_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, folder, "documents"), path, end_id=0)


@query
def op5_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    target = Scratch(spark, "token-orc").path
    return token_files.store_and_locate(table(spark, folder, "documents"), path, end_id=2, folder=target)


@query
def op6_scaled_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.edited_likeness(table(spark, folder, "documents"))


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.deduplicate_lines(table(spark, folder, "documents"))


@query
def op8_bpe_backtracking(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_language_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict_held_out(table(spark, folder, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.grafted_trie(table(spark, folder, "conversations"))


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh vector first gets the next label of ten, as if it had been labelled wrongly."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", moved))
    return found.withColumn("rank", F.col("rank").cast("int"))


@query
def op13_passage_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return passages.kept_digests(table(spark, folder, "documents"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
