"""From raw documents to packed training sequences, stage by stage.

Every stage works on all that its predecessor kept, and all but the last return the columns of
`documents`. The first and third judge each row by its own text, so of rows that share an id, or have
none, only those go that are toxic or hold a benchmark item.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from flowsieve.llm import decontaminate, minhash, packing, toxicity  # noqa: E402
from flowsieve.operators.joins import is_small  # noqa: E402
from flowsieve.sources.scratch import materialise  # noqa: E402


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from the labelled documents of its input.

    Null and empty texts are scored like any other; of repeated rows all stay or all go.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group stays, the one with the smallest id.

    Five-word shingles and a similarity of 0.8 or more. Rows with one doc_id are one document, of which
    one row stays; rows without an id, and texts without words, are in no group and stay.
    """
    groups = minhash.near_duplicates(docs)
    removed = groups.where("NOT kept").select("doc_id").distinct()
    kept = docs.join(removed, "doc_id", "left_anti").select(*docs.columns)
    repeated = materialise(groups.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated_ids")
    if not repeated.count():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return once.unionByName(again)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay."""
    # a row is known by its id and text; equal rows stay or go together
    key, name = F.xxhash64(F.col("doc_id"), F.col("text")), "row_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.select("text", key.alias(name))
    found = decontaminate.find_contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id=name)
    gone = materialise(found.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    # few documents hold an item; only if they are too many for a broadcast are the texts shuffled
    other = F.broadcast(gone) if is_small(gone) else gone
    return docs.join(other, key == F.col(name), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of the remaining documents goes in sequences of 2048 tokens.

    A null or empty text still has its end; repeated rows are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
# trees, hashes and tokenizers are beyond SQL; tests compare every stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
