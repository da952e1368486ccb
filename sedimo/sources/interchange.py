"""Log and run files as tables, and tables as run files.

Files are read by Spark's binary source, one task a file, so any file system
serves; the bytes are parsed in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimo.functions.codec import LOG_NAME, RUN_NAME, Mutation, RunFile, log_record, parse_id, replay_log, write_run
from sedimo.schema import DEL, PUT

ROWS = 10_000


def _files(spark: SparkSession, path: str, glob: str, pattern: str, name: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(parse_id(F.element_at(F.split("path", "/"), -1), pattern).alias(name), "content").where(f"{name} is not null")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """:func:`parse_logs` of every ``wal-N.log`` in a folder."""
    return parse_logs(_files(spark, path, "wal-*.log", LOG_NAME, "wal_id"))


def parse_logs(files: DataFrame) -> DataFrame:
    """``(wal_id, ordinal, op, key, value)``: the longest valid prefix of every log of ``(wal_id, content)``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wal_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, _ = replay_log(content.as_py())
                for i in range(0, len(found), ROWS):
                    part = found[i : i + ROWS]
                    columns = [
                        pa.array([wal_id] * len(part), pa.int64()),
                        pa.array(range(i, i + len(part)), pa.int64()),
                        pa.array([DEL if m.deleted else PUT for m in part], pa.string()),
                        pa.array([m.key for m in part], pa.binary()),
                        pa.array([None if m.deleted else m.value for m in part], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["wal_id", "ordinal", "op", "key", "value"])

    return files.select("wal_id", "content").mapInArrow(parse, "wal_id long, ordinal long, op string, key binary, value binary")


def log_files(log: DataFrame) -> DataFrame:
    """``(wal_id, content)``: the bytes of each log of ``(wal_id, seq, op, key, value)``, its records by ``seq``.

    A log is built in memory by one task; logs are bounded, as each flush starts
    a new one.
    """

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("seq", "op", "key", "value")), strict=True), key=lambda r: r[0])
        content = b"".join(log_record(Mutation(op == DEL, k, b"" if op == DEL or v is None else v)) for _, op, k, v in rows)
        return pa.table({"wal_id": [key[0].as_py()], "content": [content]}, schema=pa.schema([("wal_id", pa.int64()), ("content", pa.binary())]))

    plain = log.select(F.col("wal_id").cast("long"), "seq", "op", F.col("key").cast("binary"), F.col("value").cast("binary"))
    return plain.groupBy("wal_id").applyInArrow(build, "wal_id long, content binary")


def log_records(log: DataFrame) -> DataFrame:
    """``(seq, record)``: the bytes of each mutation's log record."""

    def encode(ops: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
        rows = zip(ops.to_pylist(), keys.to_pylist(), values.to_pylist(), strict=True)
        return pa.array([log_record(Mutation(op == DEL, k, b"" if op == DEL or v is None else v)) for op, k, v in rows], pa.binary())

    return log.select("seq", F.arrow_udf(encode, "binary")("op", F.col("key").cast("binary"), F.col("value").cast("binary")).alias("record"))


def log_health(spark: SparkSession, path: str) -> DataFrame:
    """``(wal_id, records, clean)``: how much of every log is valid."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [replay_log(c.as_py()) for c in batch.column(1)]
            columns = [batch.column(0), pa.array([len(m) for m, _ in found], pa.int64()), pa.array([clean for _, clean in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["wal_id", "records", "clean"])

    return _files(spark, path, "wal-*.log", LOG_NAME, "wal_id").mapInArrow(parse, "wal_id long, records long, clean boolean")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """:func:`parse_runs` of every ``N.sst`` in a folder."""
    return parse_runs(_files(spark, path, "*.sst", RUN_NAME, "run_id"))


def parse_runs(files: DataFrame) -> DataFrame:
    """``(run_id, key, deleted, value)`` of every run file of ``(run_id, content)``; fails on a corrupt one."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in batched(RunFile(content.as_py()), ROWS):
                    columns = [
                        pa.array([run_id] * len(part), pa.int64()),
                        pa.array([m.key for m in part], pa.binary()),
                        pa.array([m.deleted for m in part], pa.bool_()),
                        pa.array([None if m.deleted else m.value for m in part], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["run_id", "key", "deleted", "value"])

    return files.select("run_id", "content").mapInArrow(parse, "run_id long, key binary, deleted boolean, value binary")


def run_layouts(files: DataFrame) -> DataFrame:
    """``(run_id, entries, index_entries, filter_bytes, file_bytes)``: what the footer of each run file says."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [c.as_py() for c in batch.column(1)]
            runs = list(map(RunFile, raw))
            figures = [[r.entry_count for r in runs], [len(r.index) for r in runs], [len(r.bloom.serialize()) for r in runs], list(map(len, raw))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f, pa.int64()) for f in figures)], ["run_id", "entries", "index_entries", "filter_bytes", "file_bytes"])

    return files.select("run_id", "content").mapInArrow(parse, "run_id long, entries long, index_entries long, filter_bytes long, file_bytes long")


def run_files(runs: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """``(run_id, content)``: the file of each run of ``(run_id, key, deleted, value)``.

    A file is built in memory by one task, so runs have to be of file size; a
    larger table is cut into runs by key range first.
    """

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = zip(table["key"].to_pylist(), table["deleted"].to_pylist(), table["value"].to_pylist(), strict=True)
        entries = sorted((Mutation(d, k, b"" if d or v is None else v) for k, d, v in rows), key=lambda m: m.key)
        return pa.table({"run_id": [key[0].as_py()], "content": [write_run(entries, bits_per_key)]}, schema=pa.schema([("run_id", pa.int64()), ("content", pa.binary())]))

    plain = runs.select(F.col("run_id").cast("long"), F.col("key").cast("binary"), "deleted", F.col("value").cast("binary"))
    return plain.groupBy("run_id").applyInArrow(build, "run_id long, content binary")
