"""A store: sorted Parquet runs under a manifest.

A commit is a new manifest file, made only if no one else has made that version;
a writer that comes second reads the other's version and asks again whether its
change applies.  Whatever no manifest names doesn't exist: files of a writer
that died are never read, and are deleted by :meth:`Store.clean` later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimo.functions.bloom import Bloom
from sedimo.functions.codec import Corrupt, Mutation, log_record, replay_log
from sedimo.operators import lookup, merge
from sedimo.operators.policy import pick_compaction
from sedimo.schema import DEL, MAX_FIELD, MEMTABLE_ENTRY_OVERHEAD, PUT, RUN_META, Options, Stats, mutation_log, run_record
from sedimo.sources.files import Appender, Files

MANIFEST, RUNS, LOGS, FILTERS, LATE = "_manifest", "_runs", "_logs", "_filters", "_late"
#: Manifests that stay beside the newest, and tries of a commit against other writers.
MANIFESTS_KEPT, COMMIT_TRIES = 64, 20
#: Keys of one filter; a larger run has several, each for a range of its keys.
FILTER_KEYS = 1 << 18
NO_FLOOR = -(1 << 63)
FILTER = "run string, n long, min_key binary, max_key binary, max_seq long, bloom binary"


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Run:
    """A committed run; the keys at its ends are in hexadecimal.  ``filters`` is the table of its Bloom filters."""

    run_id: int
    path: str
    entry_count: int
    file_size: int
    min_key: str
    max_key: str
    max_seq: int = 0
    filters: str | None = None


@dataclass(frozen=True)
class Manifest:
    """A version of the store; ``runs`` are newest first.

    Mutations up to ``floor`` are set aside: a full compaction may have dropped
    a tombstone that would hide them.
    """

    version: int = 0
    next_id: int = 1
    next_seq: int = 1
    floor: int = NO_FLOOR
    runs: tuple[Run, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)

    @classmethod
    def parse(cls, raw: bytes) -> Manifest:
        got = json.loads(raw)
        return cls(**got | {"runs": tuple(Run(**r) for r in got["runs"])})

    def dump(self) -> bytes:
        return json.dumps(asdict(self)).encode()


class Store:
    """Puts, deletions and lookups over byte-string keys.

    Single mutations gather in a small memtable on the driver, and in a log that
    is open until they are flushed; tables of mutations go straight into a run.
    The larger sequence number wins, whatever the order of arrival.  Several
    writers may append tables; single mutations have one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.options = spark, options
        self.files = Files(spark, path)
        self.stats_ = Stats()
        self.manifest = Manifest()
        self.memtable: dict[bytes, tuple[int, bool, bytes]] = {}
        self.memtable_size = 0
        self.last_seq = 0
        self.top = 0
        self.log: Appender | None = None
        self.pending_logs: list[str] = []
        self.log_health: dict[str, tuple[int, bool]] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        """Open or make a store: read the newest complete manifest, replay the logs, compact if due."""
        store = cls(spark, path, options or Options())
        for folder in (MANIFEST, RUNS, LOGS, FILTERS):
            store.files.mkdirs(folder)
        store.manifest = store._newest()
        store.last_seq = store.manifest.next_seq - 1
        store._recover()
        store._maybe_compact()
        return store

    def _parsed(self, version: int) -> Manifest | None:
        try:
            return Manifest.parse(self.files.read(f"{MANIFEST}/{version:012d}.json"))
        except (ValueError, KeyError, TypeError):
            return None  # a writer died within it, or it is damaged

    def _newest(self) -> Manifest:
        """The newest manifest that can be read; a store with manifests but none of them sound is an error."""
        versions = [int(n[:-5]) for n in self.files.names(MANIFEST) if n.endswith(".json")]
        if not versions:
            return Manifest()
        self.top = versions[-1]
        for version in reversed(versions):
            if found := self._parsed(version):
                return found
        raise Corrupt(f"no manifest of {self.files.root} can be read")

    def _refresh(self) -> None:
        """Take over the versions that others have made since, without listing the older ones."""
        while self.files.exists(f"{MANIFEST}/{self.top + 1:012d}.json"):
            self.top += 1
            self.manifest = self._parsed(self.top) or self.manifest

    def _commit(self, change: Callable[[Manifest], Manifest | None]) -> bool:
        """Make the next version out of the newest; False where ``change`` doesn't apply to it (None)."""
        for _ in range(COMMIT_TRIES):
            wanted = change(self.manifest)
            if wanted is None:
                return False
            wanted = replace(wanted, version=self.top + 1)
            if self.files.create(f"{MANIFEST}/{wanted.version:012d}.json", wanted.dump(), self.options.sync_files):
                self.manifest, self.top = wanted, wanted.version
                self.files.delete(f"{MANIFEST}/{wanted.version - MANIFESTS_KEPT:012d}.json")
                return True
            self._refresh()
        raise Conflict(f"version {self.top + 1} exists")

    def _with_run(self, m: Manifest, run: Run) -> Manifest:
        """``m`` with ``run`` as its newest."""
        return replace(m, runs=(replace(run, run_id=m.next_id), *m.runs), next_id=m.next_id + 1, next_seq=max(m.next_seq, run.max_seq + 1))

    def _recover(self) -> None:
        """Replay the logs' longest valid prefixes, and write what they hold as one run.

        A log with bad bytes stays in its place for inspection, and
        :attr:`log_health` tells how many of its records counted.
        """
        flushed = self.manifest.next_seq
        for name in [n for n in self.files.names(LOGS) if n.endswith(".log")]:
            found, clean = replay_log(self.files.read(f"{LOGS}/{name}"))
            self.log_health[name] = len(found), clean
            base = int(name.split("-")[1].split(".")[0])
            for seq, m in enumerate(found, base):
                if seq >= flushed:
                    self._remember(seq, m)
            self.last_seq = max(self.last_seq, base)  # the number of a bad record isn't used again
            if clean:
                self.pending_logs.append(name)
        if self.memtable:
            self._flush_memtable(counted=False)
        self._drop_logs()

    # Single mutations.

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self._write(Mutation(False, _bytes(key), _bytes(value)))

    def delete(self, key: bytes | str) -> None:
        self._write(Mutation(True, _bytes(key)))

    def _write(self, m: Mutation) -> None:
        """Append to the log, which holds all records since the last flush, then to the memtable."""
        if max(len(m.key), len(m.value)) > MAX_FIELD:
            raise ValueError(f"keys and values have at most {MAX_FIELD} bytes")
        seq = self.last_seq + 1
        if self.log is None:
            name = f"wal-{seq:018d}.log"
            self.log = self.files.appender(f"{LOGS}/{name}", self.options.sync_wal)
            if self.log is None:
                raise Conflict(f"{name} exists")
            self.pending_logs.append(name)
        self.log.add(log_record(m))
        self._remember(seq, m)
        if self.memtable_size >= self.options.memtable_bytes:
            self.flush()

    def _remember(self, seq: int, m: Mutation) -> None:
        old = self.memtable.get(m.key)
        self.memtable_size += len(m.value) - len(old[2]) if old else len(m.key) + len(m.value) + MEMTABLE_ENTRY_OVERHEAD
        self.memtable[m.key] = seq, m.deleted, m.value
        self.last_seq = max(self.last_seq, seq)

    def flush(self) -> None:
        """Write the memtable as a run; nothing to do where it is empty."""
        if self.memtable:
            self._flush_memtable(counted=True)
            self._maybe_compact()

    def _flush_memtable(self, counted: bool) -> None:
        rows = [(seq, k, deleted, None if deleted else v) for k, (seq, deleted, v) in self.memtable.items()]
        run = self._write_run(self.spark.createDataFrame(rows, run_record()).coalesce(1), len(rows))
        self._commit(lambda m: replace(self._with_run(m, run), next_seq=max(m.next_seq, self.last_seq + 1)))
        self.memtable, self.memtable_size = {}, 0
        self._drop_logs()
        self.stats_.flushes += counted

    def _drop_logs(self) -> None:
        """Delete the logs whose records a committed run holds."""
        if self.log is not None:
            self.log.close()
            self.log = None
        for name in self.pending_logs:
            self.files.delete(f"{LOGS}/{name}")
        self.pending_logs = []

    # Tables of mutations.

    def append(self, log: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Commit a table ``(seq, op, key, value)`` as one run.

        ``batch`` is the name and number of a batch of some stream: one that was
        committed before is left out, and False returned.  The rows' ``seq``
        decides, so late rows are harmless; those at or below the floor of a
        full compaction are set aside, see :meth:`late`.
        """

        def done(m: Manifest) -> bool:
            return batch is not None and m.batches.get(batch[0], -1) >= batch[1]

        if done(self.manifest):
            return False
        self.flush()
        kinds = {f.name: f.dataType for f in mutation_log().fields}
        typed = merge.validated(log.select(*[F.col(c).cast(kinds[c]).alias(c) for c in kinds]))
        floor = self.manifest.floor
        if floor > NO_FLOOR:
            aside = typed.where(F.col("seq") <= floor)
            if not aside.isEmpty():
                aside.write.parquet(self.files.full(f"{LATE}/{uuid.uuid4().hex}"))
            typed = typed.where(F.coalesce(F.col("seq") > floor, F.lit(True)))
        run = self._write_run(self._by_range(merge.memtable_state(typed)))

        def change(m: Manifest) -> Manifest | None:
            if done(m) or m.floor > floor:
                return None
            m = replace(m, batches=m.batches | ({batch[0]: batch[1]} if batch else {}))
            return self._with_run(m, run) if run else m

        if (run or batch) and not self._commit(change):
            self._discard(run)
            if done(self.manifest):
                return False
            raise Conflict("another writer compacted all runs meanwhile; append again")
        self.last_seq = max(self.last_seq, self.manifest.next_seq - 1)
        self.stats_.flushes += run is not None
        self._maybe_compact()
        return True

    def late(self) -> DataFrame:
        """The mutations that came at or below the floor of a full compaction, and so play no part."""
        if not self.files.names(LATE):
            return self.spark.createDataFrame([], mutation_log())
        return self.spark.read.schema(mutation_log()).parquet(self.files.full(f"{LATE}/*"))

    def _by_range(self, rows: DataFrame) -> DataFrame:
        n = self.options.run_partitions
        return rows.repartitionByRange(n, "key") if n else rows.repartitionByRange("key")

    def _write_run(self, state: DataFrame, expected: int | None = None) -> Run | None:
        """Write a state, one version of each key, sorted by key; no rows make no run.

        ``state`` is dealt by ranges of keys, which keep each file's keys
        together, so that a lookup skips files and row groups by their ends, and
        the rest by Parquet's filters.
        One reading of the keys that were written gives the run's figures and
        its own filters.
        """
        name = f"{uuid.uuid4().hex}"
        path = f"{RUNS}/{name}"
        writer = state.sortWithinPartitions("key").select("seq", "key", "deleted", "value").write
        bits = self.options.bloom_bits_per_key
        if bits:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
            writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(expected or 1_000_000)).option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(self.files.full(path))
        keys = self.spark.read.schema(run_record()).parquet(self.files.full(path)).select("seq", "key")
        if bits:
            filters = f"{FILTERS}/{name}"
            filters_of(keys, path, bits).write.parquet(self.files.full(filters))
            made = self.spark.read.schema(FILTER).parquet(self.files.full(filters)).select("n", "min_key", "max_key", "max_seq")
        else:
            filters, made = None, keys.select(F.lit(1).cast("long").alias("n"), F.col("key").alias("min_key"), F.col("key").alias("max_key"), F.col("seq").alias("max_seq"))
        ends = made.agg(F.sum("n"), F.hex(F.min("min_key")), F.hex(F.max("max_key")), F.max("max_seq")).first()
        run = Run(0, path, ends[0] or 0, self.files.size(path), ends[1] or "", ends[2] or "", ends[3] or 0, filters)
        if not run.entry_count:
            self._discard(run)
            return None
        return run

    def _discard(self, run: Run | None) -> None:
        """Delete the files of a run that wasn't committed."""
        if run is not None:
            self.files.delete(run.path)
            if run.filters:
                self.files.delete(run.filters)

    def _read(self, run: Run) -> DataFrame:
        return self.spark.read.schema(run_record()).parquet(self.files.full(run.path))

    # Lookups.

    def _memory(self) -> DataFrame | None:
        rows = [(seq, k, deleted, None if deleted else v) for k, (seq, deleted, v) in self.memtable.items()]
        return self.spark.createDataFrame(rows, run_record()) if rows else None

    def sources(self) -> list[DataFrame]:
        """All layers, newest first."""
        runs = self.manifest.runs
        memory = self._memory()
        found = ([memory] if memory is not None else []) + [self._read(r) for r in runs]
        return found or [self.spark.createDataFrame([], run_record())]

    def get(self, key: bytes | str) -> bytes | None:
        """The live value of one key, or None.

        A run is passed over where its keys end before the key or its filters
        exclude it; the others are asked in one job, as a late row may make an
        older run the newer one for this key.
        """
        key = _bytes(key)
        if key in self.memtable:
            _, deleted, value = self.memtable[key]
            return None if deleted else value
        runs = self._may_hold(key)
        self.stats_.bloom_skips += len(self.manifest.runs) - len(runs)
        self.stats_.table_probes += len(runs)
        if not runs:
            return None
        row = lookup.point_get([self._read(r) for r in runs], F.lit(key)).first()
        return None if row is None else bytes(row["value"])

    def _may_hold(self, key: bytes) -> list[Run]:
        """The runs that the ends of their keys and their filters don't exclude; one small read for all filters."""
        named = key.hex().upper()
        runs = [r for r in self.manifest.runs if r.min_key <= named <= r.max_key]
        paths = [self.files.full(r.filters) for r in runs if r.filters]
        if not paths:
            return runs
        rows = self.spark.read.schema(FILTER).parquet(*paths).where((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))
        held = {r.run for r in rows.select("run", "bloom").collect() if Bloom.deserialize(bytes(r.bloom)).may_contain([key])[0]}
        return [r for r in runs if not r.filters or r.path in held]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """``(key, value)`` for each row of ``keys``, in one job."""
        return lookup.multi_get(self.sources(), keys.select(F.col("key").cast("binary").alias("key")))

    def three_state(self, keys: DataFrame) -> DataFrame:
        """``(key, state)``: live, tombstone or unseen."""
        return lookup.three_state(self.sources(), keys.select(F.col("key").cast("binary").alias("key")))

    def live(self) -> DataFrame:
        """``(key, value)`` of all that is visible."""
        return merge.live(merge.merge_runs(self.sources(), drop_tombstones=False))

    def run_meta(self) -> DataFrame:
        """``(pos, run_id, entry_count, file_size)``, the newest at 0."""
        rows = [(i, r.run_id, r.entry_count, r.file_size) for i, r in enumerate(self.manifest.runs)]
        return self.spark.createDataFrame(rows, RUN_META)

    # Maintenance.

    def _maybe_compact(self) -> None:
        while n := pick_compaction([r.file_size for r in self.manifest.runs], self.options.compaction_trigger):
            if not self._compact_newest(n):
                return  # whoever came first looks after it

    def compact(self) -> None:
        """Flush, and merge all runs into one without tombstones.

        The merged run's last number becomes the floor.  Compactions that come
        by themselves keep their tombstones and leave the floor where it is, so
        that rows may come late.
        """
        self.flush()
        for _ in range(COMMIT_TRIES):
            if not self.manifest.runs or self._compact_newest(len(self.manifest.runs), drop_tombstones=True):
                return
        raise Conflict("other writers kept adding runs")

    def _compact_newest(self, n: int, drop_tombstones: bool = False) -> bool:
        """Merge the n newest runs; False, and nothing changed, where another writer's commit got in the way."""
        inputs = self.manifest.runs[:n]
        # A run has each key once, so there is little to combine before the exchange; the merge works within the ranges.
        rows = self._by_range(merge.union_runs([self._read(r) for r in inputs]))
        merged = self._write_run(merge.merge_runs([rows], drop_tombstones) if n == 1 else merge.merged(rows, drop_tombstones))

        def change(m: Manifest) -> Manifest | None:
            at = m.runs.index(inputs[0]) if inputs[0] in m.runs else 0
            if m.runs[at : at + n] != inputs or drop_tombstones and m.runs != inputs:
                return None
            new = (replace(merged, run_id=m.next_id),) if merged else ()
            floor = max(m.floor, m.next_seq - 1) if drop_tombstones else m.floor
            return replace(m, runs=m.runs[:at] + new + m.runs[at + n :], next_id=m.next_id + 1, floor=floor)

        if not self._commit(change):
            self._discard(merged)
            return False
        self.stats_.compactions += 1
        return True

    def stats(self) -> Stats:
        runs = self.manifest.runs
        return replace(self.stats_, sstables=len(runs), sstable_entries=sum(r.entry_count for r in runs))

    def clean(self) -> list[str]:
        """Delete the runs and manifests that the newest manifest doesn't need, and return their names.

        Readers of an older version may still be at work, so this is left to the
        owner of the store.
        """
        needed = {r.path for r in self.manifest.runs} | {r.filters for r in self.manifest.runs}
        gone = [f"{folder}/{n}" for folder in (RUNS, FILTERS) for n in self.files.names(folder) if f"{folder}/{n}" not in needed]
        gone += [f"{MANIFEST}/{n}" for n in self.files.names(MANIFEST) if n.endswith(".json") and int(n[:-5]) < self.manifest.version]
        for name in gone:
            self.files.delete(name)
        return gone


def filters_of(keys: DataFrame, run: str, bits_per_key: int) -> DataFrame:
    """One row for each ``FILTER_KEYS`` keys of a task: their number, ends, last ``seq`` and Bloom filter.

    Nothing is shuffled.  Where the keys are sorted, the ends are close together
    and a lookup reads the few filters whose ends hold its key.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            names = table["key"].to_pylist()
            top = max(table["seq"].to_pylist())
            bloom = Bloom.of(names, bits_per_key).serialize()
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            values = [run, len(names), min(names), max(names), top, bloom]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["run", "n", "min_key", "max_key", "max_seq", "bloom"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= FILTER_KEYS:
                yield row()
                held = []
        if held:
            yield row()

    return keys.select("seq", "key").mapInArrow(build, FILTER)


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else x


def log_of(spark: SparkSession, mutations: list[tuple[int, str, bytes, bytes | None]]) -> DataFrame:
    """A mutation log from a list, for small batches."""
    assert all(op in (PUT, DEL) for _, op, _, _ in mutations)
    return spark.createDataFrame(mutations, mutation_log())
