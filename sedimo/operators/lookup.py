"""Point and batch lookups over layered runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimo.operators.merge import lww, union_runs
from sedimo.schema import INDEX_INTERVAL, RECORD_OVERHEAD

#: Lookup keys are sent to all executors up to this many; above, they are shuffled.
BROADCAST_KEYS = 100_000
#: Bytes that those keys may have all together.
BROADCAST_BYTES = 16 << 20
#: Ranges that a run's keys are sorted in, the sample that decides them, and the bytes of a cut.
RANGES, SAMPLE, CUT_BYTES = 64, 4096, 64
#: Sampled keys of a range, at least: few keys aren't worth ranges.
LEAST_KEYS = 32
#: Targets that stay together as one array, in key order.
CHUNK = 4096


def _only(versions: DataFrame, keys: DataFrame, small: bool) -> DataFrame:
    """The versions of the wanted keys, filtered below any aggregate."""
    wanted = keys.select("key").distinct()
    return versions.join(F.broadcast(wanted) if small else wanted, "key", "left_semi")


def state_of(sources: Sequence[DataFrame], keys: DataFrame, small: bool | None = None) -> DataFrame:
    """The newest version of each wanted key, tombstones included.

    Spark doesn't push a join below an aggregate, so the keys go to the sources
    first.  They are broadcast only when a count shows that they are few, and
    small all together; ``small`` says so without counting.
    """
    if small is None:
        n, size = keys.limit(BROADCAST_KEYS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
        small = n <= BROADCAST_KEYS and size <= BROADCAST_BYTES
    return lww(_only(union_runs(sources), keys, small))


def point_get(sources: Sequence[DataFrame], key: Column) -> DataFrame:
    """``(key, value)`` of one key: a row if it is live, else none.

    The filter on the key reaches every scan.
    """
    found = lww(union_runs([s.where(F.col("key") == key) for s in sources]))
    return found.where(~F.col("deleted")).select("key", "value")


def multi_get(sources: Sequence[DataFrame], keys: DataFrame, small: bool | None = None) -> DataFrame:
    """``(key, value)`` for each row of ``keys``; a null value where the key isn't live."""
    state = state_of(sources, keys, small).where(~F.col("deleted")).select("key", "value")
    return keys.select("key").join(state, "key", "left")


def three_state(sources: Sequence[DataFrame], keys: DataFrame, small: bool | None = None) -> DataFrame:
    """``(key, state)``: live, tombstone or unseen."""
    state = state_of(sources, keys, small).select("key", "deleted")
    said = F.when(F.col("deleted").isNull(), "unseen").when(F.col("deleted"), "tombstone").otherwise("live")
    return keys.select("key").join(state, "key", "left").select("key", said.alias("state"))


def probe_accounting(runs: DataFrame, keys: DataFrame, n_runs: DataFrame) -> DataFrame:
    """``(key, probes)`` without filters: runs searched, newest first, until one has the key.

    ``runs`` has ``pos`` (0 is the newest) and ``key``; ``n_runs`` is one row
    ``n``, their number.  A tombstone ends the search like a value; an unseen
    key costs all runs.
    """
    first = runs.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg((F.min("pos") + 1).alias("first"))
    asked = keys.select("key").join(first, "key", "left").join(F.broadcast(n_runs))  # one row
    return asked.select("key", F.coalesce("first", "n").cast("long").alias("probes"))


def record_bytes(key: str = "key", value: str = "value") -> Column:
    """Bytes of a record in a sorted run."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + RECORD_OVERHEAD


def cuts_of(keys: DataFrame, parts: int = RANGES) -> list:
    """At most ``parts - 1`` keys, or beginnings of them, that cut ``keys`` into even ranges.

    They come from a sample of fixed size; where they fall changes how work is
    spread and never a result.
    """
    seen = keys.select(F.substring("key", 1, CUT_BYTES).alias("k"), F.rand(7).alias("turn")).orderBy("turn").limit(SAMPLE).collect()
    found = sorted({bytes(r.k) if isinstance(r.k, bytearray) else r.k for r in seen if r.k is not None})
    return found[:: max(LEAST_KEYS, -(-len(found) // parts))][1:]


def range_of(key: Column, cuts: Sequence) -> Column:
    """The range that a key is in: how many cuts aren't above it."""
    # Sums and not a filter of an array: the optimizer carries a lambda's column over a join to the side that lacks it.
    return F.coalesce(reduce(Column.__add__, [(key >= F.lit(c)).cast("int") for c in cuts]), F.lit(0)) if cuts else F.lit(0)


def _carried(rows: DataFrame, by: Sequence[str], ranges: int) -> DataFrame:
    """``(by, _range, key, ordinal)``: for each range of each run the last record of the ranges before, null where there is none."""
    grid = rows.select(*by).distinct().withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    last = rows.groupBy(*by, "_range").agg(F.max(F.struct("key", "ordinal")).alias("last"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(last, [*by, "_range"], "left").withColumn("last", F.last("last", True).over(before))
    return carried.select(*by, "_range", "last.key", "last.ordinal")


def with_positions(run: DataFrame, by: Sequence[str], cuts: Sequence = ()) -> DataFrame:
    """Add each record's ``ordinal`` and byte ``offset`` in its run, in key order, and its ``_range``.

    ``by`` names the columns that tell runs apart.  A task sorts one range of
    one run; sums over the ranges before tell where it begins.
    """
    dealt = run.withColumn("_range", range_of(F.col("key"), cuts))
    sums = dealt.groupBy(*by, "_range").agg(F.count("*").alias("n"), F.sum(record_bytes()).alias("bytes"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes"))
    order = Window.partitionBy(*by, "_range").orderBy("key")
    inside = F.coalesce(F.sum(record_bytes()).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_inside", inside).withColumn("_nth", F.row_number().over(order)).join(starts, [*by, "_range"])
    placed = placed.withColumn("ordinal", F.col("_n") + F.col("_nth") - 1).withColumn("offset", (F.col("_bytes") + F.col("_inside")).cast("long"))
    return placed.drop("_n", "_bytes", "_inside", "_nth")


def sparse_index(run: DataFrame, by: Sequence[str], cuts: Sequence = (), interval: int = INDEX_INTERVAL) -> DataFrame:
    """``(by, key, ordinal, offset, _range)`` of every ``interval``-th record of each run."""
    return with_positions(run, by, cuts).where(F.col("ordinal") % interval == 0).select(*by, "key", "ordinal", "offset", "_range")


def _last_at_or_before(rows: DataFrame, asks: DataFrame, by: Sequence[str], ranges: int) -> DataFrame:
    """``asks`` with ``key`` and ``ordinal`` of the greatest key of their run that isn't above ``target``.

    Both sides are laid in one order within each range, behind what the ranges
    before carry over, so it takes one sort and no join on ranges of keys.
    """
    extra = [c for c in asks.columns if c not in (*by, "_range", "target")]
    kinds = dict(asks.dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in extra]
    known = rows.select(*by, "_range", "key", "ordinal").unionByName(_carried(rows, by, ranges).where("key is not null"))
    here = known.select(*by, "_range", F.col("key").alias("at"), F.lit(0).alias("kind"), F.struct("key", "ordinal").alias("last"), *none)
    ask = asks.select(*by, "_range", F.col("target").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(here.schema["last"].dataType).alias("last"), *extra)
    order = Window.partitionBy(*by, "_range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = here.unionByName(ask).withColumn("last", F.last("last", True).over(order)).where("kind = 1 and last is not null")
    return found.select(*by, "_range", F.col("at").alias("target"), *extra, "last.key", "last.ordinal")


def _numbered(targets: DataFrame, cuts: Sequence) -> tuple[DataFrame, DataFrame]:
    """``(target, _range, pos)``, the distinct targets and their places in key order, and ``(_range, start, end)``, the places of each range."""
    wanted = targets.where("key is not null").select(F.col("key").alias("target")).distinct().withColumn("_range", range_of(F.col("target"), cuts))
    ranges = targets.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_range"))
    sums = ranges.join(wanted.groupBy("_range").agg(F.count("*").alias("n")), "_range", "left")
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("_range"))  # a row for each range
    bounds = sums.select("_range", (upto - F.coalesce("n", F.lit(0))).alias("start"), upto.alias("end"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("target")) - 1
    return wanted.withColumn("nth", nth).join(F.broadcast(bounds), "_range").select("target", "_range", (F.col("start") + F.col("nth")).alias("pos")), bounds


def _stretches(rows: DataFrame, numbered: DataFrame, bounds: DataFrame, by: Sequence[str], ranges: int) -> DataFrame:
    """``(by, key, ordinal, lo, hi, same)``: the places of the targets whose greatest key of the run that isn't above them is ``key``.

    ``same`` tells whether the target at ``lo`` equals it.  All runs' keys are
    laid among the targets at once, so what is sorted is keys and targets and
    not their pairs.  A stretch ends with its range; the next one begins with
    what the ranges before carry over.
    """
    kinds = dict(rows.dtypes)
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in (*by, "ordinal")]
    here = rows.select(*by, "ordinal", "_range", F.col("key").alias("at"), F.lit(0).alias("asks"))
    laid = here.unionByName(numbered.select(*none, "_range", F.col("target").alias("at"), F.lit(1).alias("asks")))
    # Targets up to the key, those at the key included, and the one at the key.
    upto, same = F.sum("asks").over(Window.partitionBy("_range").orderBy("at")), F.sum("asks").over(Window.partitionBy("_range", "at"))
    placed = laid.withColumn("upto", upto).withColumn("same", same).where("asks = 0").join(F.broadcast(bounds), "_range")
    own = placed.select(*by, "_range", F.col("at").alias("key"), "ordinal", (F.col("start") + F.col("upto") - F.col("same")).alias("lo"), (F.col("same") > 0).alias("same"), "end")
    carried = _carried(rows, by, ranges).where("key is not null").join(F.broadcast(bounds), "_range")
    known = own.unionByName(carried.select(*by, "_range", "key", "ordinal", F.col("start").alias("lo"), F.lit(False).alias("same"), "end"))
    order = Window.partitionBy(*by, "_range").orderBy("ordinal")
    found = known.withColumn("hi", F.coalesce(F.lead("lo").over(order), "end"))
    return found.where("hi > lo").select(*by, "key", "ordinal", "lo", "hi", "same")


def _spread(stretches: DataFrame, numbered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each target of each stretch, with ``columns`` of the stretch, ``target``, and ``equal``: whether it is the key.

    Targets are dealt as arrays, and rows are only made after the last shuffle.
    """
    dealt = stretches.withColumn("chunk", F.explode(F.sequence(F.expr(f"lo div {CHUNK}"), F.expr(f"(hi - 1) div {CHUNK}"))))
    base = F.col("chunk") * CHUNK
    first, end = F.greatest(F.col("lo") - base, F.lit(0)).cast("int"), F.least(F.col("hi") - base, F.lit(CHUNK)).cast("int")
    parts = dealt.select("chunk", *columns, first.alias("_first"), (end - first).alias("_n"), (F.col("same") & (F.col("lo") >= base)).alias("same"))
    chunks = numbered.groupBy(F.expr(f"pos div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "target")))["target"].alias("targets"))
    # As a hash join, so that an array is not copied for each stretch that meets it; a number of tasks of its own, as rows grow here.
    met = parts.repartition(RANGES, "chunk").join(chunks.repartition(RANGES, "chunk").hint("shuffle_hash"), "chunk")
    rows = met.select(*columns, "same", F.posexplode(F.slice("targets", F.col("_first") + 1, F.col("_n"))).alias("_nth", "target"))
    return rows.select(*columns, "target", (F.col("same") & (F.col("_nth") == 0)).alias("equal"))


def sparse_index_seek(index: DataFrame, targets: DataFrame, by: Sequence[str], cuts: Sequence = ()) -> DataFrame:
    """For each target and run the greatest index key that isn't above it; no row before the first.

    A block of a run answers a stretch of the targets in key order.  Only the
    ends of stretches are looked for; the rows are made last, as many as the
    result has.
    """
    numbered, bounds = _numbered(targets, cuts)
    found = _spread(_stretches(index, numbered, bounds, by, len(cuts) + 1), numbered, [*by, "key", "ordinal"])
    return found.select(*by, "target", F.col("key").alias("block"), F.col("ordinal").cast("long").alias("first"))


def scan_costs(run: DataFrame, targets: DataFrame, by: Sequence[str], cuts: Sequence = (), interval: int = INDEX_INTERVAL) -> DataFrame:
    """What :func:`block_scan_cost` tells of the seek of every target in every run.

    All targets between two neighbouring records cost the same, so what is
    looked for is a stretch of targets for each record, and no pair is joined.
    """
    at = with_positions(run, by, cuts)
    numbered, bounds = _numbered(targets, cuts)
    total = at.groupBy(*by).agg(F.count("*").alias("total"))
    read = F.col("ordinal") % interval + 1  # from the block's first up to this record
    costs = _stretches(at, numbered, bounds, by, len(cuts) + 1).join(total, list(by))
    costs = costs.withColumn("read", read.cast("long")).withColumn("more", F.when(F.col("ordinal") + 1 < F.col("total"), read + 1).otherwise(read).cast("long"))
    return _spread(costs, numbered, [*by, "read", "more"]).select(*by, "target", F.when(F.col("equal"), F.col("read")).otherwise(F.col("more")).alias("records"))


def block_scan_cost(run: DataFrame, seeks: DataFrame, by: Sequence[str], cuts: Sequence = ()) -> DataFrame:
    """``(by, target, records)``: records read from the block's first until the key, a greater one or the end.

    A key that falls after the last of its block also reads the next block's
    first record.  ``by`` names the columns that tell runs apart.
    """
    at = with_positions(run, by, cuts)
    asks = seeks.select(*by, "target", "first").withColumn("_range", range_of(F.col("target"), cuts))
    last = _last_at_or_before(at, asks, by, len(cuts) + 1)
    total = at.groupBy(*by).agg(F.count("*").alias("total"))
    # Equal: read up to it.  Absent: up to the next record, where there is one.
    end = F.when(F.col("key") == F.col("target"), F.col("ordinal")).otherwise(F.least(F.col("ordinal") + 1, F.col("total") - 1))
    cost = last.join(total, list(by)).withColumn("records", end - F.col("first") + 1)
    return cost.select(*by, "target", F.col("records").cast("long").alias("records"))
