"""The corpus pipeline: stages over ``documents``, each one an operator of ``sedimo.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``; other
columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimo.llm import lines, mixing, packing, simhash, toxicity
from sedimo.llm.queries import vocabulary
from sedimo.llm.shared import made, read_table, release, save

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go; null and empty texts stay."""
    return toxicity.drop_toxic(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents have go from all of them.

    No document goes; ``n_chars`` follows a text that lost lines, and a null
    text becomes empty.
    """
    cut = lines.drop_frequent_lines(docs.select(COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id.

    Shingles are five words, and documents link from a similarity of 0.8.
    Texts without words are one group; rows without an id stay.
    """
    return simhash.drop_near_duplicates(docs.select(COLUMNS), width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times; a part is its first words.

    Null and blank texts have no words, so they go; a null source is one source.
    """
    return mixing.mixed_texts(docs, COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a row for each piece.  A null or empty text is its end id alone."""
    return packing.pack(docs, **vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_frequent_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokenizing, learning and fingerprints are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again; what a stage made besides is deleted."""
    docs, before = read_table(spark, sf_dir, "documents"), made()
    for i, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"stage{i}")
        release(spark, before, keep=[docs])
    return docs
