"""The operators over the test tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, covertree, lines, merkle, mixing, neighbours, packing, personal, reputation, simhash, tokens, toxicity, wrapper

URL_RULES = [
    reputation.Rule("allow", "com/"),
    reputation.Rule("block", "example.com/en/"),
    reputation.Rule("allow", "www.example.com/en/"),
    reputation.Rule("block", "net/es/"),
    reputation.Rule("block", "net/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), bits=2, words_per_shingle=3)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", "dropped", "text")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = reputation.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score_documents(documents, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_amounts(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of base spans."""
    found = personal.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in personal.KINDS]
    digest = F.sha2(personal.shown(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, personal.shown(F.col("spans")).alias("spans"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document, by its checksum, claims one character more than it was recorded with."""
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + F.when(altered, 1).otherwise(0)
    proved = merkle.prove(table(spark, sf_dir, "documents"), changed={"n_chars": more})
    found = merkle.folded(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    rows = proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), found.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_documents(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and "_" in name}
