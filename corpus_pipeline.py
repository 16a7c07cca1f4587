"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing.

Each stage reads what its predecessor kept, written as Parquet to the shared folder. A stage's own scratch tables are
deleted when the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesmith.llm import jaccard, line_dedup, mixing, packing, quality
from seriesmith.llm.common import read_table, scratch_path, stage_scratch
from seriesmith.llm.queries import tokenizer_path

#: Words that a generation of the tokenizer remembers here, where workers also hold what earlier stages left.
WORDS_KEPT = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and whose host passes."""
    with stage_scratch():
        return quality.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated runs of lines."""
    with stage_scratch():
        return line_dedup.clean(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a similarity of 0.8 or more by 5-word shingles."""
    with stage_scratch():
        return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once or twice."""
    with stage_scratch():
        return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence."""
    with stage_scratch():
        return packing.pack(docs.select("doc_id", "text"), tokenizer_path(), words_kept=WORDS_KEPT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokens, and the places of hashed documents in sequences, are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
