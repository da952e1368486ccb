"""The contract-shaped queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimo.llm import lattice, lines, mixing, oracles, packing, secrets, sharding, simhash, substrings, topk, toxicity
from sedimo.llm.shared import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, radius=2)
    word = F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0"))
    return found.select("doc_id", word.alias("fingerprint"), "component_id")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products for every twentieth vector, against all rows."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without windows of 20 words that occurred earlier."""
    found = substrings.remove_repeats(read_table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def vocabulary() -> dict[str, str]:
    """The public vocabulary's files and the pattern that parts text before its merges."""
    import public_tokenizers

    return {
        "vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), **vocabulary(), window=2048, end_id=1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the lines that ten or more documents have."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    found = mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), repeats=3)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secrets in every document."""
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal row counts."""
    found = sharding.shard(read_table(spark, sf_dir, "documents"), shards=8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the vectors with a cosine of 0.93 or more within a label."""
    return lattice.near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.93)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_topk": op2_topk,
    "op3_substrings": op3_substrings,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_lines": op6_lines,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_sharding": op9_sharding,
    "op10_lattice": op10_lattice,
}
ORACLE_SQL: dict[str, str] = oracles.SQL
