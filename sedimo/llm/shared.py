"""Tables in the folder that driver and executors share, and small helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sedimo.sources.files import shared_root

#: With this setting a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def save(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a point that survives lost executors, and what is
    expensive to make is made once.  The plan's shuffle files are freed at once.
    The rows read back have a ``.scratch`` attribute with their path, for
    :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/sedimo/{uuid.uuid4().hex}-{name}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _made.append(path)
    with _freed_shuffles(spark):
        writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`save` that no later plan reads; others are left alone."""
    for df in tables:
        path = getattr(df, "scratch", None)
        if path in _made:
            _delete(df.sparkSession, path)


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Delete all tables of :func:`save` that this process has made after the first ``since``, but those in ``keep``.

    A lazy result reads the last tables of its operator, so this is for the
    caller who has written or consumed the results.
    """
    kept = {getattr(df, "scratch", None) for df in keep}
    for path in _made[since:]:
        if path not in kept:
            _delete(spark, path)


def made() -> int:
    """How many tables of :func:`save` exist now; a mark for :func:`release`."""
    return len(_made)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.remove(path)
