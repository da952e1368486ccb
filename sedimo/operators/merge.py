"""Last-write-wins merging, as an aggregate that Spark distributes freely."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimo.schema import DEL, MAX_FIELD, MEMTABLE_ENTRY_OVERHEAD, PUT


def normalise(df: DataFrame, seq: Column, key: Column, value: Column, deleted: Column) -> DataFrame:
    """A mutation log ``(seq, op, key, value)`` from any table; a deletion has no value."""
    return df.select(
        seq.cast("long").alias("seq"),
        F.when(deleted, DEL).otherwise(PUT).alias("op"),
        key.alias("key"),
        F.when(~deleted, value).alias("value"),
    )


def validated(log: DataFrame) -> DataFrame:
    """The log, failing at run time on a null key, an unknown op or a field that is too long."""
    bad = (
        F.col("key").isNull()
        | F.col("seq").isNull()
        | ~F.coalesce(F.col("op").isin(PUT, DEL), F.lit(False))
        | (F.octet_length("key") > MAX_FIELD)
        | F.coalesce(F.octet_length("value") > MAX_FIELD, F.lit(False))
    )
    fail = F.raise_error(F.concat(F.lit("bad mutation at seq "), F.coalesce(F.col("seq").cast("string"), F.lit("null"))))
    return log.withColumn("op", F.when(bad, fail.cast("string")).otherwise(F.col("op")))


def lww(versions: DataFrame, order: str | Sequence[str] = "seq", payload: Sequence[str] = ("deleted", "value")) -> DataFrame:
    """The newest version of each key, tombstones included: ``key``, the order columns, the payload.

    One partial aggregate before the exchange and one after; a key with very
    many versions is a single row from each task.
    """
    order = [order] if isinstance(order, str) else list(order)
    newest = F.max_by(F.struct(*order, *payload), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return versions.groupBy("key").agg(newest.alias("v")).select("key", *[f"v.{c}" for c in (*order, *payload)])


def as_versions(log: DataFrame) -> DataFrame:
    """A log's rows as versions ``(seq, key, deleted, value)``; a put without a value holds an empty one."""
    deleted = F.col("op") == DEL
    empty = F.lit("").cast(log.schema["value"].dataType)
    return log.select("seq", "key", deleted.alias("deleted"), F.when(~deleted, F.coalesce("value", empty)).alias("value"))


def memtable_state(log: DataFrame) -> DataFrame:
    """One version of each key: the newest, tombstones kept."""
    return lww(as_versions(log))


def live(state: DataFrame) -> DataFrame:
    """``(key, value)`` of what is visible.

    Only after merging: a tombstone that is dropped earlier brings the version
    it hides back to life.
    """
    return state.where(~F.col("deleted")).select("key", "value")


def tombstones(state: DataFrame) -> DataFrame:
    """The keys whose newest version is a deletion."""
    return state.where("deleted").select("key")


def memtable_bytes(state: DataFrame) -> DataFrame:
    """One row: the approximate size of a memtable with this state."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + MEMTABLE_ENTRY_OVERHEAD
    return state.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def union_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """All versions of several runs, in no order."""
    return reduce(DataFrame.unionByName, runs)


def merge_runs(runs: Sequence[DataFrame], drop_tombstones: bool, order: str = "seq") -> DataFrame:
    """Merge runs to the newest version of each key.

    ``drop_tombstones`` is right only where the oldest run takes part, since
    else an older run may hold a value that a tombstone hides.  A single run has
    unique keys and needs no aggregate.
    """
    if len(runs) == 1:
        return runs[0].where(~F.col("deleted")) if drop_tombstones else runs[0]
    return merged(union_runs(runs), drop_tombstones, order)


def merged(versions: DataFrame, drop_tombstones: bool, order: str = "seq") -> DataFrame:
    """The newest version of each key; where ``versions`` are dealt by ranges of keys already, nothing is shuffled."""
    state = lww(versions, order)
    return state.where(~F.col("deleted")) if drop_tombstones else state


def shadowed(versions: DataFrame) -> DataFrame:
    """``(key, versions, shadowed)``: how many versions of each key a merge drops."""
    return versions.groupBy("key").agg(F.count("*").alias("versions")).withColumn("shadowed", F.col("versions") - 1)


def valid_prefix(records: DataFrame, log: str = "wal_id", ordinal: str = "ordinal", ok: str = "ok") -> DataFrame:
    """The records of each log before its first bad one.

    The first bad ordinal is one small aggregate for each log, so no log's
    records have to be sorted in one task.
    """
    broken = records.where(~F.col(ok)).groupBy(log).agg(F.min(ordinal).alias("_broken"))
    joined = records.join(broken, log, "left")
    return joined.where(F.col("_broken").isNull() | (F.col(ordinal) < F.col("_broken"))).drop("_broken")
