"""Queries of this package: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import decontaminate, hamming, lattice_lm, lexical, minhash, packing, phrases, preference, sharding, substring, token_output, toxicity, warc
from flowsieve.sources.scratch import materialise, new_scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_preferences(*preference.swapped_answers(table(spark, sf_dir, "conversations")))


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest binary codes of every vector whose id is divisible by 100."""
    coded = materialise(hamming.codes(table(spark, sf_dir, "embeddings")), "vector_codes")
    wanted = coded.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("code").alias("query_code"))
    return hamming.nearest(coded, wanted, k=10)


def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written matrices read back: per row its documents, segments and a checksum of its ids."""
    path = new_scratch_path(spark, "token_matrices")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    token_output.write_matrices(table(spark, sf_dir, "documents"), path, ranks, public_tokenizers.PATTERN)
    return token_output.read_matrices(spark, path).select(
        "row_id", "n_ids", "doc_ids", "pieces", "starts", "cu_seqlens", "position_resets", F.crc32("ids").alias("ids_crc32"))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "archives")
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    return warc.page_captures(warc.assemble(warc.read_records(spark, path, payloads=False), payloads=False))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.find_collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_minhash_near_dedup, op2_lattice_likelihood, op3_best_fit_packing, op4_sampled_splitter_sharding, op5_preference_formatting, op6_hamming_top_k,
        op7_toxicity_trees, op8_token_matrices, op9_template_decontamination, op10_warc_captures, op11_substring_dedup, op12_ranked_lexical_search,
        op13_phrase_collocations,
    )
    return {query.__name__: query for query in found}
