"""Schemas, options and statistics of versioned keyed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PUT, DEL = "put", "del"


def mutation_log(kind: T.DataType | None = None) -> T.StructType:
    """``(seq, op, key, value)``; a larger ``seq`` is newer, and no two rows share one."""
    kind = kind or T.BinaryType()
    return T.StructType(
        [
            T.StructField("seq", T.LongType(), False),
            T.StructField("op", T.StringType(), False),
            T.StructField("key", kind, False),
            T.StructField("value", kind),
        ]
    )


def run_record(kind: T.DataType | None = None) -> T.StructType:
    """A version in a sorted run: one for each key and run."""
    kind = kind or T.BinaryType()
    return T.StructType(
        [
            T.StructField("seq", T.LongType(), False),
            T.StructField("key", kind, False),
            T.StructField("deleted", T.BooleanType(), False),
            T.StructField("value", kind),
        ]
    )


RUN_META = T.StructType(
    [
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("run_id", T.LongType(), False),
        T.StructField("entry_count", T.LongType(), False),
        T.StructField("file_size", T.LongType(), False),
    ]
)

#: Fixed values of the record formats.
MAX_FIELD = 1 << 28
INDEX_INTERVAL = 16
MEMTABLE_ENTRY_OVERHEAD = 32
RECORD_OVERHEAD = 9
INDEX_OVERHEAD = 12
FOOTER_BYTES = 48
BLOOM_HEADER_BYTES = 12


@dataclass(frozen=True)
class Options:
    """Knobs of a store.

    ``sync_wal`` and ``sync_files`` bring each record of a log, and each manifest,
    to the disk itself, where the file system can; the files of runs are Spark's
    to write.
    """

    memtable_bytes: int = 1 << 20
    compaction_trigger: int = 4
    bloom_bits_per_key: int = 10
    sync_wal: bool = False
    sync_files: bool = True
    run_partitions: int | None = None

    def __post_init__(self) -> None:
        if self.memtable_bytes < 1:
            raise ValueError("memtable_bytes must be at least 1")
        if self.compaction_trigger < 2:
            raise ValueError("compaction_trigger must be at least 2: one run can't be merged with itself")
        if self.bloom_bits_per_key < 0:
            raise ValueError("bloom_bits_per_key can't be negative; 0 turns the filter off")


@dataclass
class Stats:
    """Counters of a store; runs and entries as they are, the others since it was opened."""

    sstables: int = 0
    sstable_entries: int = 0
    bloom_skips: int = 0
    table_probes: int = 0
    flushes: int = 0
    compactions: int = 0
