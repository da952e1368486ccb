"""The registered queries over the test tables, each with SQL for the same rows.

``events`` is a mutation log: ``event_id`` is the sequence number, ``user_id``
the key, an error a deletion.  Runs are a thousand events each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimo.functions.bloom import FNV_BASIS, FNV_PRIME, MIX_1, MIX_2, SECOND_SEED, bloom_params_columns, build_filters, filter_figures, key_hashes, pass_counts, probe_filters
from sedimo.functions.codec import LOG_DELETE, LOG_NAME, LOG_PUT, RUN_NAME, log_name, parse_id, run_name
from sedimo.operators import lookup, merge
from sedimo.operators.policy import LayoutModel, pick_compaction_rows, settle
from sedimo.schema import BLOOM_HEADER_BYTES, FOOTER_BYTES, INDEX_OVERHEAD, MEMTABLE_ENTRY_OVERHEAD, Options
from sedimo.sources import interchange
from sedimo.sources.files import shared_root
from sedimo.sources.store import Store

RUN = 1000
NEWEST = 4
BITS = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOG = """
log AS (
    SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, CAST(user_id AS VARCHAR) AS key,
           CASE WHEN event_type <> 'error' THEN props END AS value, event_type = 'error' AS deleted,
           CAST(floor(event_id / 1000.0) AS BIGINT) AS run_id, value AS amount
    FROM events
)"""
STATE = f"""{LOG},
state AS (
    SELECT key, seq, deleted, value, CASE WHEN NOT deleted THEN amount END AS amount
    FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
)"""
RUNS = f"""{LOG},
runs AS (
    SELECT run_id, key, seq, deleted, value
    FROM log QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1
),
sized AS (
    SELECT *, strlen(key) + coalesce(strlen(value), 0) + 9 AS bytes,
           row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS ordinal
    FROM runs
)"""


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutations(spark: SparkSession, sf_dir: str, value: str = "props", only: Column | None = None) -> DataFrame:
    """The event log with one of its columns as the value; ``only`` is a condition on the table's own columns, which reaches the scan."""
    e = table(spark, sf_dir, "events")
    e = e if only is None else e.where(only)
    return merge.normalise(e, F.col("event_id"), F.col("user_id").cast("string"), F.col(value), F.col("event_type") == "error")


def versions(spark: SparkSession, sf_dir: str, value: str = "props", only: Column | None = None) -> DataFrame:
    return merge.as_versions(mutations(spark, sf_dir, value, only))


def key_cuts(spark: SparkSession, sf_dir: str) -> list[str]:
    """Cuts of the keys into even ranges, from a sample of the log."""
    return lookup.cuts_of(mutations(spark, sf_dir).select("key"))


def run_of(seq: str = "seq") -> Column:
    return F.expr(f"{seq} div {RUN}")


def all_runs(spark: SparkSession, sf_dir: str, value: str = "props") -> DataFrame:
    """Every run's state, with its ``run_id``: the newest version of a key within the run."""
    v = versions(spark, sf_dir, value).withColumn("run_id", run_of())
    newest = F.max_by(F.struct("seq", "deleted", "value"), "seq").alias("v")
    return v.groupBy("run_id", "key").agg(newest).select("run_id", "key", "v.*")


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up: those of the customers, some of which no event has."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))


@query(f"WITH {LOG} SELECT seq, op, key, value FROM log")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations(spark, sf_dir)


@query(f"WITH {STATE} SELECT key, seq, deleted, value FROM state")
def memtable_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.memtable_state(mutations(spark, sf_dir))


@query(f"WITH {STATE} SELECT key, amount AS value FROM state WHERE NOT deleted")
def live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = mutations(spark, sf_dir, "value").select("seq", "key", (F.col("op") == "del").alias("deleted"), "value")
    return merge.live(merge.lww(v))


@query(f"WITH {STATE} SELECT key FROM state WHERE deleted")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.tombstones(merge.memtable_state(mutations(spark, sf_dir)))


@query(f"WITH {STATE} SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 32) AS BIGINT) AS bytes FROM state")
def memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.memtable_bytes(merge.memtable_state(mutations(spark, sf_dir)))


@query(f"WITH {STATE} SELECT key, value FROM state ORDER BY key")
def memtable_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.memtable_state(mutations(spark, sf_dir)).select("key", "value").orderBy("key")


@query(f"WITH {STATE} SELECT key, value FROM state WHERE key = '13' AND NOT deleted")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.point_get([versions(spark, sf_dir, only=F.col("user_id") == 13)], F.lit("13"))


@query(
    """WITH r AS (SELECT CAST(floor(event_id / 1000.0) AS BIGINT) AS wal_id, event_id % 1000 AS ordinal, CAST(user_id AS VARCHAR) AS key,
                         event_id % 877 <> 600 AS ok FROM events)
    SELECT wal_id, ordinal, key FROM r QUALIFY min(CAST(ok AS INT)) OVER (PARTITION BY wal_id ORDER BY ordinal) = 1"""
)
def wal_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    records = e.select(
        run_of("event_id").alias("wal_id"), (F.col("event_id") % RUN).alias("ordinal"), F.col("user_id").cast("string").alias("key"), (F.col("event_id") % 877 != 600).alias("ok")
    )
    return merge.valid_prefix(records).select("wal_id", "ordinal", "key")


@query(
    f"""WITH {LOG} SELECT key, seq % 3 AS wal_id, seq AS ordinal, deleted, value
    FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq % 3 DESC, seq DESC) = 1"""
)
def recovery_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base and two logs, replayed one after the other."""
    v = versions(spark, sf_dir).withColumn("wal_id", F.col("seq") % 3).withColumn("ordinal", F.col("seq"))
    return merge.lww(v, ["wal_id", "ordinal"])


@query(f"WITH {RUNS} SELECT run_id, key, seq, deleted, value FROM runs")
def flush_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_runs(spark, sf_dir)


@query(f"WITH {RUNS} SELECT run_id, key, deleted, value FROM runs ORDER BY run_id, key")
def run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run in key order."""
    return all_runs(spark, sf_dir).select("run_id", "key", "deleted", "value").orderBy("run_id", "key")


@query(
    f"""WITH {RUNS} SELECT key, seq, deleted, value FROM runs WHERE run_id > (SELECT max(run_id) - {NEWEST} FROM runs)
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"""
)
def compact_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest runs merged; their tombstones stay, as older runs remain."""
    runs = all_runs(spark, sf_dir)
    last = table(spark, sf_dir, "events").agg(F.max(run_of("event_id")).alias("last"))
    newest = runs.join(F.broadcast(last), F.col("run_id") > F.col("last") - NEWEST).drop("last")
    return merge.lww(newest.drop("run_id"))


@query(f"WITH {STATE} SELECT key, seq, value FROM state WHERE NOT deleted")
def compact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.lww(all_runs(spark, sf_dir).drop("run_id"))
    return merged.where(~F.col("deleted")).select("key", "seq", "value")


@query(f"WITH {RUNS} SELECT key, count(*) AS versions, count(*) - 1 AS shadowed FROM runs GROUP BY key")
def shadowed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.shadowed(all_runs(spark, sf_dir))


@query(
    f"""WITH {RUNS}, meta AS (
        SELECT user_group, (max(run_id) OVER ()) - run_id AS pos, file_size
        FROM (SELECT run_id, sum(bytes) AS file_size FROM sized GROUP BY run_id), (SELECT unnest([1, 2, 3, 5, 8]) AS user_group)
        WHERE run_id % user_group = 0
    ), ranked AS (
        SELECT user_group, row_number() OVER (PARTITION BY user_group ORDER BY pos) - 1 AS pos, file_size * (1 + pos % user_group) AS file_size FROM meta
    ), newer AS (
        SELECT *, sum(file_size) OVER (PARTITION BY user_group ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newer FROM ranked
    ), taken AS (
        SELECT user_group, coalesce(min(pos) FILTER (pos > 0 AND file_size > newer), count(*)) AS taken FROM newer GROUP BY user_group
    )
    SELECT user_group, CAST(CASE WHEN taken >= {NEWEST} THEN taken ELSE 0 END AS BIGINT) AS picked FROM taken"""
)
def pick_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy's choice for several lists of runs."""
    sizes = all_runs(spark, sf_dir).groupBy("run_id").agg(F.sum(lookup.record_bytes()).alias("file_size"))
    last = sizes.agg(F.max("run_id").alias("last"))
    meta = sizes.crossJoin(F.broadcast(last)).withColumn("user_group", F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 8)))))
    meta = meta.where("run_id % user_group = 0").withColumn("at", F.col("last") - F.col("run_id"))
    order = Window.partitionBy("user_group").orderBy("at")
    ranked = meta.select("user_group", (F.row_number().over(order) - 1).alias("pos"), (F.col("file_size") * (1 + F.col("at") % F.col("user_group"))).alias("file_size"))
    return pick_compaction_rows(ranked, NEWEST, ["user_group"])


@query(f"WITH {RUNS} SELECT count(*) AS upper_bound, count(DISTINCT key) AS keys FROM runs")
def merge_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sizes a merged run's filter, and what it holds in the end."""
    per_key = all_runs(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("upper_bound"), F.count("*").alias("keys"))


@query(f"WITH {STATE} SELECT CAST(c_custkey AS VARCHAR) AS key, s.value FROM customer LEFT JOIN (FROM state WHERE NOT deleted) s ON s.key = CAST(c_custkey AS VARCHAR)")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.multi_get([versions(spark, sf_dir)], wanted(spark, sf_dir))


@query(
    f"""WITH {STATE} SELECT CAST(c_custkey AS VARCHAR) AS key,
    CASE WHEN deleted IS NULL THEN 'unseen' WHEN deleted THEN 'tombstone' ELSE 'live' END AS state
    FROM customer LEFT JOIN state s ON s.key = CAST(c_custkey AS VARCHAR)"""
)
def lookup_three_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.three_state([versions(spark, sf_dir)], wanted(spark, sf_dir))


@query(
    f"""WITH {RUNS}, placed AS (SELECT key, (max(run_id) OVER ()) - run_id AS pos FROM runs),
    first AS (SELECT key, min(pos) + 1 AS probes FROM placed GROUP BY key)
    SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(coalesce(probes, (SELECT count(DISTINCT run_id) FROM runs)) AS BIGINT) AS probes
    FROM customer LEFT JOIN first f ON f.key = CAST(c_custkey AS VARCHAR)"""
)
def probe_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").agg(F.max(run_of("event_id")).alias("last"), F.count_distinct(run_of("event_id")).alias("n"))  # one row
    runs = all_runs(spark, sf_dir).join(F.broadcast(found)).withColumn("pos", F.col("last") - F.col("run_id"))
    return lookup.probe_accounting(runs, wanted(spark, sf_dir), found.select("n"))


@query(
    f"""WITH {RUNS} SELECT run_id, key, ordinal,
    CAST(coalesce(sum(bytes) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM sized QUALIFY ordinal % 16 = 0"""
)
def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.sparse_index(all_runs(spark, sf_dir), ["run_id"], key_cuts(spark, sf_dir))
    return found.select("run_id", "key", F.col("ordinal").cast("long").alias("ordinal"), "offset")


@query(
    f"""WITH {RUNS}, idx AS (SELECT run_id, key FROM sized WHERE ordinal % 16 = 0)
    SELECT run_id, target, max(key) AS block FROM idx JOIN (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS target FROM customer) ON key <= target
    GROUP BY run_id, target"""
)
def sparse_index_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = key_cuts(spark, sf_dir)
    index = lookup.sparse_index(all_runs(spark, sf_dir), ["run_id"], cuts)
    return lookup.sparse_index_seek(index, wanted(spark, sf_dir), ["run_id"], cuts).select("run_id", "target", "block")


@query(
    f"""WITH {RUNS}, t AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS target FROM customer),
    first AS (SELECT run_id, target, max(ordinal) AS first FROM sized JOIN t ON key <= target WHERE ordinal % 16 = 0 GROUP BY run_id, target),
    stop AS (SELECT run_id, target, min(ordinal) AS stop FROM sized JOIN t ON key >= target GROUP BY run_id, target),
    ends AS (SELECT run_id, max(ordinal) AS last FROM sized GROUP BY run_id)
    SELECT run_id, target, CAST(coalesce(stop, last) - first + 1 AS BIGINT) AS records FROM first LEFT JOIN stop USING (run_id, target) JOIN ends USING (run_id)"""
)
def block_scan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lookup reads in every run."""
    runs = all_runs(spark, sf_dir).select("run_id", "key", "value")
    return lookup.scan_costs(runs, wanted(spark, sf_dir), ["run_id"], key_cuts(spark, sf_dir))


@query(
    f"""WITH {RUNS} SELECT run_id, CAST(sum(bytes) + sum(CASE WHEN ordinal % 16 = 0 THEN 12 + strlen(key) ELSE 0 END)
    + 12 + ceil(greatest(64, count(*) * {BITS}) / 8.0) + 48 AS BIGINT) AS file_bytes FROM sized GROUP BY run_id"""
)
def run_file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.with_positions(all_runs(spark, sf_dir), ["run_id"], key_cuts(spark, sf_dir))
    indexed = F.when(F.col("ordinal") % 16 == 0, F.octet_length("key") + INDEX_OVERHEAD).otherwise(0)
    sums = rows.groupBy("run_id").agg(F.sum(lookup.record_bytes() + indexed).alias("body"), F.count("*").alias("n"))
    bits, _ = bloom_params_columns(F.col("n"), BITS)
    return sums.select("run_id", (F.col("body") + (bits / 8).cast("long") + BLOOM_HEADER_BYTES + FOOTER_BYTES).alias("file_bytes"))


@query(
    f"""WITH {RUNS} SELECT run_id, count(*) AS keys, CAST(ceil(greatest(64, count(*) * {BITS}) / 8.0) * 8 AS BIGINT) AS bits,
    CAST(least(greatest(floor({BITS} * 0.69), 1), 30) AS INT) AS hashes FROM runs GROUP BY run_id"""
)
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = all_runs(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("keys"))
    bits, hashes = bloom_params_columns(F.col("keys"), BITS)
    return n.select("run_id", "keys", bits.alias("bits"), hashes.alias("hashes"))


@query(
    f"""WITH RECURSIVE r AS (
        SELECT CAST(floor(event_id / 1000.0) AS BIGINT) AS wal_id, event_id AS seq,
               strlen(CAST(event_id AS VARCHAR)) + strlen(props) + {MEMTABLE_ENTRY_OVERHEAD} AS bytes,
               row_number() OVER (PARTITION BY CAST(floor(event_id / 1000.0) AS BIGINT) ORDER BY event_id) AS n
        FROM events
    ), fold AS (
        SELECT wal_id, n, seq, bytes AS held, bytes >= 4096 AS is_full FROM r WHERE n = 1
        UNION ALL
        SELECT r.wal_id, r.n, r.seq, CASE WHEN f.is_full THEN 0 ELSE f.held END + r.bytes,
               CASE WHEN f.is_full THEN 0 ELSE f.held END + r.bytes >= 4096
        FROM fold f JOIN r ON r.wal_id = f.wal_id AND r.n = f.n + 1
    )
    SELECT wal_id, seq, CAST(held AS BIGINT) AS bytes FROM fold WHERE is_full"""
)
def flush_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a memtable of 4,096 bytes fills up, in each log by itself.

    What is held depends on all before it since the last flush, so a log is one
    ordered fold; logs are bounded, as each flush starts a new one.
    """
    e = table(spark, sf_dir, "events").select(run_of("event_id").alias("wal_id"), F.col("event_id").alias("seq"), F.octet_length("props").cast("long").alias("n"))

    def fold(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        model = LayoutModel(Options(memtable_bytes=4096, compaction_trigger=1 << 30))
        out = []
        for seq, n in sorted(zip(rows["seq"].to_pylist(), rows["n"].to_pylist(), strict=True)):
            held, name = model.memtable_size, str(seq).encode()
            model.apply([(name, n)])
            if not model.memtable:
                out.append((key[0].as_py(), seq, held + len(name) + n + MEMTABLE_ENTRY_OVERHEAD))
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["wal_id", "seq", "bytes"])

    return e.groupBy("wal_id").applyInArrow(fold, "wal_id long, seq long, bytes long")


@query(f"WITH {RUNS} SELECT count(DISTINCT run_id) AS sstables, count(*) AS sstable_entries, CAST(sum(bytes) AS BIGINT) AS data_bytes FROM sized")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = all_runs(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("entry_count"), F.sum(lookup.record_bytes()).alias("bytes"))
    return meta.agg(F.count("*").alias("sstables"), F.sum("entry_count").alias("sstable_entries"), F.sum("bytes").alias("data_bytes"))


@query(
    """WITH n AS (SELECT o_orderkey, printf('%06d.sst', o_orderkey * 997) AS run, printf('wal-%06d.log', o_orderkey) AS log FROM orders),
    each AS (SELECT o_orderkey, unnest([run, log, run || '.tmp', 'x' || run]) AS name FROM n)
    SELECT name, TRY_CAST(nullif(regexp_extract(name, '^([0-9]+)\\.sst$', 1), '') AS BIGINT) AS run_id,
           TRY_CAST(nullif(regexp_extract(name, '^wal-([0-9]+)\\.log$', 1), '') AS BIGINT) AS wal_id FROM each"""
)
def parse_file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(run_name(F.col("o_orderkey") * 997).alias("run"), log_name(F.col("o_orderkey")).alias("log"))
    names = o.select(F.explode(F.array("run", "log", F.concat("run", F.lit(".tmp")), F.concat(F.lit("x"), "run"))).alias("name"))
    return names.select("name", parse_id(F.col("name"), RUN_NAME).alias("run_id"), parse_id(F.col("name"), LOG_NAME).alias("wal_id"))


@query(f"WITH {RUNS} SELECT run_id, count(*) AS keys, 0::BIGINT AS missed FROM runs GROUP BY run_id")
def bloom_no_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of a run passes the run's filter."""
    runs = all_runs(spark, sf_dir).select("run_id", "key")
    pairs = probe_filters(runs, build_filters(runs, BITS))
    return pairs.groupBy("run_id").agg(F.count("*").alias("keys"), F.count_if(~F.col("maybe")).alias("missed"))


@query(f"WITH {STATE} SELECT key, seq, deleted, value FROM state")
def late_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose sequence numbers interleave, each delivered twice: the result is that of one delivery."""
    v = versions(spark, sf_dir)
    even, odd = v.where("seq % 2 = 0"), v.where("seq % 2 = 1")
    return merge.merge_runs([odd, even, odd, even], drop_tombstones=False)


def _field(b: Column) -> Column:
    """A byte string as the log has it: its length in four bytes, the lowest first, and its bytes."""
    n = F.octet_length(b)
    low_first = [F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]
    return F.concat(F.unhex(F.concat(*low_first)), b)


@query(
    f"""WITH {LOG}, f AS (SELECT seq, deleted, hex(encode(key)) AS k, hex(encode(coalesce(value, ''))) AS v FROM log),
    h AS (
        SELECT seq, CASE WHEN deleted THEN '0{LOG_DELETE}' ELSE '0{LOG_PUT}' END
            || array_to_string([printf('%02X', (strlen(k) // 2 // x) % 256) FOR x IN [1, 256, 65536, 16777216]], '') || k
            || array_to_string([printf('%02X', (strlen(v) // 2 // x) % 256) FOR x IN [1, 256, 65536, 16777216]], '') || v AS h FROM f
    )
    SELECT seq, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(h) // 2),
            lambda i: (16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::BIGINT)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS crc FROM h"""
)
def wal_record_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of each event's log record: over its kind, lengths, key and value."""
    kind = F.when(F.col("op") == "del", F.lit(bytes([LOG_DELETE]))).otherwise(F.lit(bytes([LOG_PUT])))
    value = F.coalesce(F.col("value").cast("binary"), F.lit(b""))
    return mutations(spark, sf_dir).select("seq", F.crc32(F.concat(kind, _field(F.col("key").cast("binary")), _field(value))).alias("crc"))


RECORD_HEX = f"""{LOG}, f AS (SELECT seq, run_id, op, key, CASE WHEN deleted THEN NULL ELSE value END AS value, deleted, hex(encode(key)) AS k,
        hex(encode(CASE WHEN deleted THEN '' ELSE coalesce(value, '') END)) AS v FROM log),
    h AS (
        SELECT *, CASE WHEN deleted THEN '0{LOG_DELETE}' ELSE '0{LOG_PUT}' END
            || array_to_string([printf('%02X', (strlen(k) // 2 // x) % 256) FOR x IN [1, 256, 65536, 16777216]], '') || k
            || array_to_string([printf('%02X', (strlen(v) // 2 // x) % 256) FOR x IN [1, 256, 65536, 16777216]], '') || v AS h FROM f
    )"""


@query(
    f"""WITH {RECORD_HEX},
    c AS (
        SELECT seq, h, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(h) // 2),
                lambda i: (16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)::BIGINT)),
            lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS crc FROM h
    )
    SELECT seq, array_to_string([printf('%02X', (crc // x) % 256) FOR x IN [1, 256, 65536, 16777216]], '')
        || array_to_string([printf('%02X', (strlen(h) // 2 // x) % 256) FOR x IN [1, 256, 65536, 16777216]], '') || h AS record FROM c"""
)
def wal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every event's log record, in hexadecimal."""
    return interchange.log_records(mutations(spark, sf_dir)).select("seq", F.hex("record").alias("record"))


def damaged(content: Column, wal_id: Column) -> Column:
    """Of every three logs one loses its last three bytes, and one has its middle byte turned over."""
    size, middle = F.octet_length(content), (F.octet_length(content) / 2).cast("int")
    byte = F.conv(F.hex(F.substring(content, middle + 1, 1)), 16, 10).cast("int")
    turned = F.unhex(F.lpad(F.hex((F.lit(255) - byte).cast("long")), 2, "0"))
    broken = F.concat(F.substring(content, F.lit(1), middle), turned, F.substring(content, middle + 2, size))
    return F.when(wal_id % 3 == 1, F.substring(content, F.lit(1), size - 3)).when(wal_id % 3 == 2, broken).otherwise(content)


@query(
    f"""WITH {LOG}, r AS (
        SELECT run_id AS wal_id, seq, op, key, CASE WHEN deleted THEN NULL ELSE value END AS value,
               17 + strlen(key) + CASE WHEN deleted THEN 0 ELSE strlen(coalesce(value, '')) END AS bytes FROM log
    ), e AS (
        SELECT *, row_number() OVER w - 1 AS ordinal, sum(bytes) OVER w AS stop, sum(bytes) OVER (PARTITION BY wal_id) AS size
        FROM r WINDOW w AS (PARTITION BY wal_id ORDER BY seq ROWS UNBOUNDED PRECEDING)
    )
    SELECT wal_id, ordinal, op, key, value FROM e
    WHERE stop <= CASE wal_id % 3 WHEN 1 THEN size - 3 WHEN 2 THEN size // 2 ELSE size END"""
)
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as bytes, some torn and some damaged, and what their replay gives: the records before the harm."""
    files = interchange.log_files(mutations(spark, sf_dir).withColumn("wal_id", run_of()))
    harmed = files.select("wal_id", damaged(F.col("content"), F.col("wal_id")).alias("content"))
    return interchange.parse_logs(harmed).select("wal_id", "ordinal", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def written_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interchange.run_files(all_runs(spark, sf_dir), BITS)


@query(f"WITH {RUNS} SELECT run_id, key, deleted, CASE WHEN NOT deleted THEN coalesce(value, '') END AS value FROM runs")
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run written as the bytes of a file, and read back."""
    back = interchange.parse_runs(written_runs(spark, sf_dir))
    return back.select("run_id", F.col("key").cast("string").alias("key"), "deleted", F.col("value").cast("string").alias("value"))


@query(
    f"""WITH {RUNS} SELECT run_id, count(*) AS entries, CAST(ceil(count(*) / 16.0) AS BIGINT) AS index_entries,
    CAST(12 + ceil(greatest(64, count(*) * {BITS}) / 8.0) AS BIGINT) AS filter_bytes,
    CAST(sum(bytes) + sum(CASE WHEN ordinal % 16 = 0 THEN 12 + strlen(key) ELSE 0 END) + 12 + ceil(greatest(64, count(*) * {BITS}) / 8.0) + 48 AS BIGINT) AS file_bytes
    FROM sized GROUP BY run_id"""
)
def run_file_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the footers of the written runs say, and their real sizes."""
    return interchange.run_layouts(written_runs(spark, sf_dir))


def _hashed(keys: str) -> str:
    """SQL for the two hashes ``h1`` and ``h2`` of ``keys(key)``: FNV-1a from two starts, then two rounds of mixing, modulo 2**64."""
    wrap = "% 18446744073709551616::UHUGEINT"

    def start(seed: int) -> str:
        ordered = "list_transform(string_split(key, ''), lambda c: ascii(c)::UHUGEINT)"
        return f"list_reduce(list_prepend({FNV_BASIS ^ seed}::UHUGEINT, {ordered}), lambda h, b: (xor(h, b) * {FNV_PRIME}::UHUGEINT) {wrap})"

    def mix(factor: int, source: str) -> str:
        return f"SELECT key, " + ", ".join(f"xor({x}, {x} // 8589934592) * {factor}::UHUGEINT {wrap} AS {x}" for x in ("x", "y")) + f" FROM {source}"

    return f"""started AS (SELECT key, {start(0)} AS x, {start(SECOND_SEED)} AS y FROM {keys}),
    once AS ({mix(MIX_1, "started")}),
    twice AS ({mix(MIX_2, "once")}),
    hashed AS (SELECT key, xor(x, x // 8589934592) AS h1, xor(y, y // 8589934592) | 1 AS h2 FROM twice)"""


def _signed(h: str) -> str:
    return f"CAST(CASE WHEN {h} >= 9223372036854775808::UHUGEINT THEN {h}::HUGEINT - 18446744073709551616::HUGEINT ELSE {h}::HUGEINT END AS BIGINT)"


@query(f"""WITH {LOG}, names AS (SELECT DISTINCT key FROM log), {_hashed("names")} SELECT key, {_signed("h1")} AS h1, {_signed("h2")} AS h2 FROM hashed""")
def bloom_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter's two hashes of every key."""
    return key_hashes(mutations(spark, sf_dir).select("key").distinct())


PLACES = f"""{RUNS}, names AS (SELECT DISTINCT key FROM runs UNION SELECT DISTINCT CAST(c_custkey AS VARCHAR) FROM customer), {_hashed("names")},
sizes AS (SELECT run_id, CAST(ceil(greatest(64, count(*) * {BITS}) / 8.0) * 8 AS BIGINT) AS bits, CAST(least(greatest(floor({BITS} * 0.69), 1), 30) AS BIGINT) AS hashes FROM runs GROUP BY run_id),
places AS (
    SELECT DISTINCT run_id, bits, hashes, CAST(((h1 + i * h2) % 18446744073709551616::UHUGEINT) % bits::UHUGEINT AS BIGINT) AS place
    FROM (SELECT run_id, bits, hashes, h1, h2, unnest(range(hashes))::UHUGEINT AS i FROM runs JOIN sizes USING (run_id) JOIN hashed USING (key))
)"""


@query(f"WITH {PLACES} SELECT run_id, bits, hashes, count(*) AS bits_set, CAST(sum(place) AS BIGINT) AS place_sum FROM places GROUP BY run_id, bits, hashes")
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits of every run's serialized filter."""
    return filter_figures(build_filters(all_runs(spark, sf_dir).select("run_id", "key"), BITS))


@query(
    f"""WITH {PLACES}, asked AS (
        SELECT run_id, key, CAST(((h1 + i * h2) % 18446744073709551616::UHUGEINT) % bits::UHUGEINT AS BIGINT) AS place, hashes
        FROM (SELECT run_id, key, bits, hashes, h1, h2, unnest(range(hashes))::UHUGEINT AS i
              FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer) JOIN hashed USING (key), sizes)
    ), hits AS (
        SELECT a.run_id, a.key, count(*) = any_value(a.hashes) AS maybe FROM asked a JOIN places p ON a.run_id = p.run_id AND a.place = p.place GROUP BY a.run_id, a.key
    )
    SELECT run_id, (SELECT count(DISTINCT c_custkey) FROM customer) AS asked, count(*) FILTER (maybe) AS passed,
           count(*) FILTER (maybe AND key NOT IN (SELECT key FROM runs r WHERE r.run_id = hits.run_id)) AS false_positives
    FROM hits GROUP BY run_id"""
)
def bloom_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lookup keys each run's filter lets pass, and how many of those the run hasn't."""
    runs, keys = all_runs(spark, sf_dir).select("run_id", "key"), wanted(spark, sf_dir).where("key is not null").distinct()
    n_keys, n_events = table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "events").count()
    found = pass_counts(keys, build_filters(runs, BITS), n_keys, n_events * BITS // 8)
    # A filter lets every key of its run pass, so what passes besides is false.
    held = runs.join(keys, "key", "left_semi").groupBy("run_id").agg(F.count("*").alias("held"))
    told = found.join(held, "run_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    return told.select("run_id", "asked", "passed", (F.col("passed") - F.col("held")).alias("false_positives"))


@query(
    f"""WITH RECURSIVE {RUNS}, arrivals AS (
        SELECT g, list(file_size * (1 + run_id % g) ORDER BY run_id) AS q
        FROM (SELECT run_id, CAST(sum(bytes) AS BIGINT) AS file_size FROM sized GROUP BY run_id), (SELECT unnest([1, 2, 3, 5, 8]) AS g) GROUP BY g
    ), fold AS (
        SELECT g, q, 0 AS nth, 0 AS compactions, CAST([] AS BIGINT[]) AS sizes, false AS done FROM arrivals
        UNION ALL
        SELECT g, q, CASE WHEN taken < {NEWEST} AND nth < len(q) THEN nth + 1 ELSE nth END, CASE WHEN taken >= {NEWEST} THEN compactions + 1 ELSE compactions END,
               CASE WHEN taken >= {NEWEST} THEN list_prepend(CAST(list_sum(sizes[1:taken]) AS BIGINT), sizes[taken + 1:]) WHEN nth < len(q) THEN list_prepend(q[nth + 1], sizes) ELSE sizes END,
               taken < {NEWEST} AND nth >= len(q)
        FROM (SELECT *, coalesce(list_min(list_filter(range(2, len(sizes) + 1), lambda i: sizes[i] > list_sum(sizes[1:i - 1]))) - 1, len(sizes)) AS taken FROM fold WHERE NOT done)
    )
    SELECT g AS user_group, len(q) AS flushes, CAST(compactions AS BIGINT) AS compactions, len(sizes) AS runs, sizes[1] AS newest, sizes[-1] AS oldest FROM fold WHERE done"""
)
def compaction_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flushes and compactions as runs arrive one by one, for several lists of sizes."""
    sizes = all_runs(spark, sf_dir).groupBy("run_id").agg(F.sum(lookup.record_bytes()).alias("size"))
    dealt = sizes.withColumn("user_group", F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 8)))))
    arrivals = dealt.select("user_group", F.col("run_id").alias("pos"), (F.col("size") * (1 + F.col("run_id") % F.col("user_group"))).alias("file_size"))
    found = settle(arrivals, NEWEST, ["user_group"])
    return found.select("user_group", "flushes", "compactions", F.size("sizes").cast("long").alias("runs"), F.get("sizes", 0).alias("newest"), F.element_at("sizes", -1).alias("oldest"))


def filled_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store in the shared folder with the log in four appends that interleave, of which the two newest are merged."""
    log = mutations(spark, sf_dir).select("seq", "op", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    store = Store.open(spark, f"{shared_root(spark)}/sedimo/{uuid.uuid4().hex}-store", Options(compaction_trigger=100))
    for k in range(4):
        store.append(log.where(F.col("seq") % 4 == k))
    store._compact_newest(2)
    return store


@query(f"WITH {STATE} SELECT key, value FROM state WHERE NOT deleted")
def store_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store shows after appends, a compaction and being opened again."""
    again = Store.open(spark, filled_store(spark, sf_dir).files.root, Options(compaction_trigger=100))
    return again.live().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(
    f"""WITH {LOG}, held AS (SELECT count(DISTINCT (CASE WHEN seq % 4 >= 2 THEN 2 ELSE seq % 4 END, key)) AS n, count(DISTINCT CASE WHEN seq % 4 >= 2 THEN 2 ELSE seq % 4 END) AS runs FROM log)
    SELECT runs AS sstables, n AS sstable_entries, 4::BIGINT AS flushes, 1::BIGINT AS compactions FROM held"""
)
def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of that store."""
    s = filled_store(spark, sf_dir).stats()
    return spark.createDataFrame([(s.sstables, s.sstable_entries, s.flushes, s.compactions)], "sstables long, sstable_entries long, flushes long, compactions long")
