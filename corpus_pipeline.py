"""A corpus pipeline of five stages, each one operator of cairn.llm over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs.  All stages but the last return the columns of documents.

Defined results of every stage: a null, empty or blank text fails the quality rules and goes; of repeated
rows, equal or nearly so, one stays, the one with the least id, nulls first; a null id stays null; ties
and very long texts have no rules of their own; nulls in other columns and columns that documents lacks are
kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, near_dup, pieces, quality, secrets
from cairn.llm.common import cut, discard, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    small_batches(spark)
    return quality.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard 0.8 or more on five-word shingles connect: the one with the least id."""
    small_batches(spark)
    return near_dup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no verbatim window of eight words of a benchmark item, nor two short items."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and n_chars counted anew."""
    small_batches(spark)
    return secrets.redact(docs, length="n_chars")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_ids and whether the ids decode to the text."""
    small_batches(spark)
    out = pieces.encode(docs, "doc_id", "lang", "source")
    return out.selectExpr("doc_id", "lang", "source", "ids", "cast(size(ids) AS bigint) AS n_ids", "lossless")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the Jaccard join's whole groups, the forest or the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
