"""Line dedup over levelled sorted runs of line hashes.

Each batch of documents is merge-anti-joined with the runs of the batches
before: lines that have reached the bound there are settled and leave the batch.
The others become a run of the batch's own, sorted by hash, each with the number
of documents that had it so far, so that the newest row of a line tells its
standing.  A level that has gathered ``FANOUT`` runs is compacted into one run
of the next level, which keeps the largest standing of each line; N batches
leave about ``FANOUT * log(N)`` runs to join with, and rewrite each hash
``log(N)`` times.

A line that reaches the bound is settled in one row of one run, so the frequent
lines are those rows, without another merge.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimo.llm.shared import discard, save

FANOUT = 3
BATCHES = 4
MIN_DOCS = 10
MIN_CHARS = 1
#: Frequent lines are sent to all workers up to this many, of 16 bytes each; above, each text's are joined to it.
BROADCAST_LINES = 250_000

ADDED = ("n_lines", "n_dropped")
CUT = "text string, n_lines long, n_dropped long"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _raw(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _keys(text: pa.StringScalar, min_chars: int) -> set[bytes]:
    """The distinct keys of a text that are long enough to count."""
    return {k for k in map(line_key, _raw(text).split(b"\n")) if len(k) >= min_chars and _chars(k) >= min_chars}


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(line, n_docs)``: the 128-bit hash of each key, and how many rows of an Arrow batch have it.

    A line that very many rows share is one row for each batch of them, before
    any shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0):
                seen.update(_keys(text, min_chars))
            yield pa.RecordBatch.from_arrays([pa.array(map(_hash, seen), pa.binary()), pa.array(seen.values(), pa.int64())], ["line", "n_docs"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "line binary, n_docs long")


class LineRuns:
    """The levels of runs; ``levels[i]`` holds the runs of level i, oldest first.

    A run has ``line`` and ``n_docs``, the documents of its own and all earlier
    batches that have the line, sorted by line within its files.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout, self.levels = spark, min_docs, fanout, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def _newest(runs: list[DataFrame]) -> DataFrame:
        """The standing of each line over several runs; it only grows, so the newest is the largest."""
        if len(runs) == 1:
            return runs[0]
        return reduce(DataFrame.unionByName, runs).groupBy("line").agg(F.max("n_docs").alias("n_docs"))

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-join a batch's ``(line, n_docs)`` with the runs, and add what is left as a run of level 0."""
        own = lines.groupBy("line").agg(F.sum("n_docs").alias("n_docs"))
        if self.runs():
            before = self._newest(self.runs()).select("line", F.col("n_docs").alias("before")).hint("merge")
            open_ = F.col("before").isNull() | (F.col("before") < self.min_docs)
            own = own.join(before, "line", "left").where(open_).select("line", (F.col("n_docs") + F.coalesce("before", F.lit(0))).alias("n_docs"))
        self._put(0, save(own.sortWithinPartitions("line"), "run0"))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, save(self._newest(old).sortWithinPartitions("line"), f"run{level + 1}"))
            discard(*old)

    def frequent(self) -> DataFrame:
        """The lines that at least ``min_docs`` documents of all batches have, once each."""
        rows = reduce(DataFrame.unionByName, self.runs())
        return rows.where(F.col("n_docs") >= self.min_docs).select("line")


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``(line)``: the hash of every key that at least ``min_docs`` rows of ``docs`` have; a written table."""
    batch = F.spark_partition_id() % batches
    lines = save(line_counts(docs, min_chars).withColumn("batch", batch), "lines", ["batch"])
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("line", "n_docs"))
    frequent = save(runs.frequent(), "frequent")
    discard(lines, *runs.runs())
    return frequent


def _cut_one(text: pa.StringScalar, gone: frozenset[bytes] | set[bytes]) -> tuple[str | None, int, int]:
    """The shortened text, or None where it stays as it is; its lines; and those dropped."""
    whole = _raw(text).split(b"\n")
    kept = [x for x in whole if _hash(line_key(x)) not in gone] if gone else whole
    n = len(whole) - len(kept)
    return b"\n".join(kept).decode() if n else None, len(whole), n


def _cuts(rows: list[tuple[str | None, int, int]]) -> pa.Array:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    kinds = [pa.string(), pa.int64(), pa.int64()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["text", *ADDED])


def _joined(docs: DataFrame, frequent: DataFrame, min_chars: int) -> tuple[DataFrame, Column]:
    """``docs`` with ``_gone``, the frequent lines of each text, and what cuts them.

    Rows are named by a hash of id and text, so copies of a text under different
    ids spread over tasks.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id",) if c in docs.columns]
    owner = F.unhex(F.md5(F.concat_ws("\x1f", *named, F.coalesce("text", F.lit("")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, hashes = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _keys(text, min_chars)
                hashes.extend(map(_hash, own))
                owners.extend([name] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.binary()), pa.array(hashes, pa.binary())], ["_owner", "line"])

    each = docs.select(owner.alias("_owner"), "text").mapInArrow(run, "_owner binary, line binary")
    gone = save(each.join(frequent, "line", "left_semi").groupBy("_owner").agg(F.collect_set("line").alias("_gone")), "gone")
    cut = F.arrow_udf(lambda texts, gones: _cuts([_cut_one(t, set(g.as_py() or ())) for t, g in zip(texts, gones, strict=True)]), CUT)
    return docs.withColumn("_owner", owner).join(gone, "_owner", "left"), cut("text", "_gone")


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, sent: int = BROADCAST_LINES
) -> DataFrame:
    """Drop every line whose key at least ``min_docs`` rows of ``docs`` have.

    Returns the columns of ``docs`` with the shortened ``text``, and
    ``n_lines`` (before) and ``n_dropped``.  Each row is a document, repeated
    rows included; a line repeated in one row counts once.  A null or empty text
    is one empty line, which has no key of ``min_chars`` code points and stays;
    a null text becomes empty.  A row whose lines all go keeps an empty text.
    Texts are cut whole, whatever their length, and one at a time.  Columns of
    ``docs`` named like the added ones are replaced, and ones named ``_cut``,
    ``_owner`` or ``_gone`` left out.  No rows give no rows.

    At most ``sent`` frequent lines are sent to all workers, and no text is
    shuffled; more are joined to the texts that have them.
    """
    others = [c for c in docs.columns if c not in (*ADDED, "_cut", "_owner", "_gone")]
    whole = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else c for c in others])
    frequent = frequent_lines(whole, min_docs, min_chars, batches, fanout)
    rows = frequent.limit(sent + 1).collect()
    if len(rows) <= sent:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.line) for r in rows))
        discard(frequent)
        cut = F.arrow_udf(lambda texts: _cuts([_cut_one(t, known.value) for t in texts]), CUT)("text")
    else:
        whole, cut = _joined(whole, frequent, min_chars)
    out = whole.withColumn("_cut", cut)
    text = F.coalesce("_cut.text", "text", F.lit("")).alias("text")
    return out.select(*[text if c == "text" else c for c in others], *[f"_cut.{c}" for c in ADDED])
