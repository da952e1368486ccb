"""Sharding by a Feistel permutation of global row numbers, in SQL expressions only.

Row numbers run over the rows in an order that only their content decides.  A
Feistel network over a grid of ``a * b >= n`` cells permutes them; a result
outside ``[0, n)`` is permuted again until it falls inside (cycle walking),
which leaves a permutation of ``[0, n)``.  Place p lies in shard ``p % shards``
at slot ``p div shards``: shard counts differ by one at most, slots have no
gaps, and either can be computed from the row number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimo.llm.shared import save

SHARDS = 8
SEED = 20_231
ROUNDS = 6
#: Rows of a bucket, within which one task numbers the rows.
BUCKET = 4096
#: Buckets of a group, within which one task adds up what lies before each.
GROUP = 4096


def grid(n: int) -> tuple[int, int]:
    """Sides with ``n <= a * b < n + a``."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _div(x: Column, y: int) -> Column:
    return F.call_function("div", x, F.lit(y))


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass: each half in turn is shifted by a hash of the other."""
    left, right = _div(x, b), F.pmod(x, F.lit(b))
    for k in range(0, ROUNDS, 2):
        left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(k)), F.lit(a)), F.lit(a))
        right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(k + 1)), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def permuted(rows: DataFrame, number: str, n: int, seed: int = SEED) -> DataFrame:
    """Add ``place``, the permutation's value for row number ``number``."""
    a, b = grid(n)
    placed = rows.withColumn("place", _network(F.col(number), a, b, seed))
    # A walk visits the cells outside once each, so it is over after as many steps; few rows take any.
    outside = a * b - n
    if not outside:
        return placed
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), F.col("place"), lambda p, _: F.when(p < n, p).otherwise(_network(p, a, b, seed)))
    return placed.withColumn("place", F.when(F.col("place") < n, F.col("place")).otherwise(walk))


def number_rows(rows: DataFrame, order: list[str], bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """Add ``row_number``, from 0 without gaps, and return the number of rows.

    Rows are dealt to buckets by a hash of ``order`` and numbered within each,
    after the rows of the buckets before; no task sorts more than some buckets.
    Rows equal in all of ``order`` are interchangeable.  ``rows`` is read twice,
    so it should be a written table.
    """
    n = rows.count()
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(max(1, -(-n // bucket)))))
    # What lies before a bucket is added up within its group of buckets, and over the groups.
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("of", _div(F.col("bucket"), GROUP))
    inner, outer = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.partitionBy("of").orderBy("bucket"), Window.orderBy("of")))
    groups = sizes.groupBy("of").agg(F.sum("n").alias("n")).select("of", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(groups, "of").select("bucket", (F.col("base") + F.col("start")).alias("start"))
    inside = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    numbered = dealt.join(starts, "bucket").withColumn("row_number", F.col("start") + F.row_number().over(inside) - 1)
    return numbered.drop("bucket", "start"), n


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, a row for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has none, and the
    checksum of no bytes.  The law is by rows: shard counts are at most one
    apart, whatever texts are equal, so a group of copies is spread and not kept
    together.  Equal rows may swap places with each other only; a null doc_id
    is numbered like any other.  A text's length plays no part but in its size.
    Other columns, whatever their names, are left out.  No rows give no rows.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32")
    )
    numbered, n = number_rows(save(sized, "sizes"), ["doc_id", "size", "text_crc32"])
    placed = permuted(numbered, "row_number", n, seed)
    return placed.select("doc_id", "size", "text_crc32", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), _div(F.col("place"), shards).alias("slot"))
