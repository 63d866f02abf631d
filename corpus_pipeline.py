"""Corpus pipeline over documents: language ID, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Nulls, empty and
long texts, repeated rows and empty tables follow the operators' own rules.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import jaccard, langid, packing, suffix
from tidegauge.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language that fits; the model learns from the labelled ones."""
    return langid.accepted(docs, langid.train(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, keeps the one with the least id (of
    several texts with that id, one); of rows that repeat with id and text, one. Documents without words stay."""
    found = written(jaccard.classes(docs, n=5, percent=80), "found")
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    first = found.where("label IS NOT NULL").groupBy("label").agg(F.min(own).alias("x")).select("x.doc_id", "x.text_hash")
    kept = written(first.unionByName(found.where("label IS NULL").select("doc_id", "text_hash").distinct()), "kept")
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    rows = keyed.join(kept.toDF("_id", "_kept"), keyed["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_kept")), "left_semi").drop("_h")
    again = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return rows.dropDuplicates(["doc_id", "text"]) if again else rows


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that start anywhere else, too; documents stay, with what is left of their text."""
    return suffix.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with the sequence and offset where they stand."""
    # A smaller cache of chunks than for packing alone, as executors also hold what earlier stages left; the ids are the same.
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, entries=300_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Models, set joins over words and tokenizers have no form in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
