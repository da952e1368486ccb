"""Merging, lookups, policy, formats, the store and streams."""

import os
import random
import signal
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sedimo.functions import bloom
from sedimo.functions.bloom import Bloom, bloom_params
from sedimo.functions.codec import Corrupt, Mutation, RunFile, log_record, replay_log, write_run
from sedimo.operators import lookup, merge, policy
from sedimo.plans import catalogue
from sedimo.schema import Options, mutation_log, run_record
from sedimo.shell import run as shell
from sedimo.sources import interchange
from sedimo.sources.store import RUNS, Store
from sedimo.streaming.ingest import ingest, live_changes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def told(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert told(tuple(r) for r in got.select(*names).collect()) == told(want.fetchall())


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.SQL) == set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def log(spark, *rows):
    return spark.createDataFrame(list(rows), mutation_log())


def test_last_write_wins_and_tombstones(spark):
    state = merge.memtable_state(log(spark, (1, "put", b"a", b"1"), (2, "put", b"b", b"2"), (3, "put", b"a", b"3"), (4, "del", b"a", None), (5, "put", b"", b""), (6, "del", b"\x80\xff", None)))
    assert {bytes(r.key): (r.deleted, r.value and bytes(r.value)) for r in state.collect()} == {b"a": (True, None), b"b": (False, b"2"), b"": (False, b""), b"\x80\xff": (True, None)}
    assert {bytes(r.key) for r in merge.live(state).collect()} == {b"b", b""}
    assert merge.memtable_bytes(state).first().bytes == 1 + 32 + 1 + 1 + 32 + 32 + 2 + 32
    asked = spark.createDataFrame([(b"a",), (b"b",), (b"zz",)], "key binary")
    assert {bytes(r.key): r.state for r in lookup.three_state([state], asked).collect()} == {b"a": "tombstone", b"b": "live", b"zz": "unseen"}
    with pytest.raises(Exception, match="bad mutation at seq 9"):
        merge.validated(log(spark, (9, "upsert", b"a", None))).collect()


def test_tombstones_hide_only_after_merging(spark):
    runs = [spark.createDataFrame(r, run_record()) for r in ([(3, b"k", True, None)], [(2, b"k", False, b"v2")], [(1, b"k", False, b"v1")])]
    assert merge.merge_runs(runs, True).count() == 0
    assert [bytes(r.value) for r in merge.merge_runs([r.where("not deleted") for r in runs], True).collect()] == [b"v2"]  # the mistake
    assert merge.merge_runs(runs[:2], False).first().deleted


def test_lookup_keys_are_filtered_below_the_aggregate(spark):
    plan = lookup.multi_get([catalogue.versions(spark, SF)], catalogue.wanted(spark, SF), small=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_compactions_that_follow_arrivals(spark):
    rng = random.Random(5)
    cases = [[rng.choice([1, 2, 5, 10, 40]) for _ in range(rng.randrange(1, 14))] for _ in range(30)]
    rows = [(g, p, n) for g, sizes in enumerate(cases) for p, n in enumerate(sizes)]
    want = {}
    for g, sizes in enumerate(cases):
        runs, merges = [], 0
        for size in sizes:
            runs.insert(0, size)
            while n := policy.pick_compaction(runs, 3):
                runs[:n] = [sum(runs[:n])]
                merges += 1
        want[g] = len(sizes), merges, runs
    got = policy.settle(spark.createDataFrame(rows, "g int, pos int, file_size long"), 3, ["g"]).collect()
    assert {r.g: (r.flushes, r.compactions, list(r.sizes)) for r in got} == want


def test_positions_do_not_depend_on_the_ranges(spark):
    rng = random.Random(6)
    keys = sorted({f"k{rng.randrange(900):04d}" for _ in range(300)})
    run = spark.createDataFrame([(g, k, "v" * (i % 5)) for g in (1, 2) for i, k in enumerate(keys) if i % 3 or g == 1], "run_id long, key string, value string")
    targets = spark.createDataFrame([("a",), ("z",), ("k0500x",), *[(f"k{i:04d}",) for i in range(0, 900, 13)]], "key string")
    told_by = []
    for cuts in ([], ["k0100", "k0101", "k0700"], lookup.cuts_of(run, 7), ["a", "zz"]):
        index = lookup.sparse_index(run, ["run_id"], cuts)
        seeks = lookup.sparse_index_seek(index, targets, ["run_id"], cuts)
        told_by.append((told(map(tuple, index.drop("_range").collect())), told(map(tuple, seeks.collect())), told(map(tuple, lookup.block_scan_cost(run, seeks, ["run_id"], cuts).collect()))))
    assert all(x == told_by[0] for x in told_by)
    assert len(lookup.cuts_of(run, 7)) == 6 and len(lookup.cuts_of(run.where("key < 'k0020'"), 7)) == 0


def test_pick_compaction(spark):
    rng = random.Random(3)
    cases = [[rng.choice([1, 2, 5, 10, 40]) for _ in range(rng.randrange(1, 9))] for _ in range(40)]
    rows = [(g, p, n) for g, sizes in enumerate(cases) for p, n in enumerate(sizes)]
    got = policy.pick_compaction_rows(spark.createDataFrame(rows, "g int, pos int, file_size long"), 4, ["g"]).collect()
    assert {r.g: r.picked for r in got} == {g: policy.pick_compaction(s, 4) for g, s in enumerate(cases)}
    assert policy.pick_compaction([10, 10, 20, 40], 4) == 4 and policy.pick_compaction([10, 10, 21], 2) == 2 and policy.pick_compaction([], 2) == 0


def test_layout_model_counts():
    model = policy.LayoutModel(Options(memtable_bytes=4096))
    model.apply((f"key{i:08d}".encode(), len(f"value-{i}") + 40) for i in range(5000))
    assert (model.flushes, model.compactions, len(model.memtable)) == (111, 27, 3)
    assert [len(entries) for _, entries in model.runs] == [45, 45, 45, 180, 360, 1440, 2882]
    model.compact()
    assert len(model.runs) == 1 and len(model.runs[0][1]) == 5000


def test_bloom_filter():
    names = [f"present-{i}".encode() for i in range(10_000)]
    f = Bloom.of(names, 10)
    assert f.may_contain(names).all()
    assert f.may_contain([f"absent-{i}".encode() for i in range(10_000)]).sum() == 93
    again = Bloom.deserialize(f.serialize())
    assert again.may_contain(names).all() and (again.bits, again.hashes) == bloom_params(10_000, 10) == (100_000, 6)
    assert Bloom.of(names, 0).may_contain([b"x"]).all() and Bloom.of(names, 0).serialize() == b""
    assert bloom_params(1, 100) == (104, 30) and bloom_params(1, 1) == (64, 1)
    assert Bloom.of([b""], 10).may_contain([b""]).all()
    for raw in (b"x", f.serialize()[:-1]):
        with pytest.raises(ValueError):
            Bloom.deserialize(raw)


def test_log_replay_takes_the_longest_valid_prefix(spark, tmp_path):
    made = [Mutation(i % 4 == 3, f"key{i}".encode(), b"" if i % 4 == 3 else f"value{i}".encode()) for i in range(10)]
    raw = b"".join(map(log_record, made))
    assert replay_log(raw) == (made, True) and replay_log(b"") == ([], True)
    assert replay_log(raw[:-3]) == (made[:9], False)
    bad = raw[: len(raw) // 2] + b"\x7f" + raw[len(raw) // 2 + 1 :]
    found, clean = replay_log(bad)
    assert not clean and found == made[: len(found)] and len(found) < 10
    for n, data in ((1, raw), (2, raw[:-3]), (7, bad)):
        (tmp_path / f"wal-{n:06d}.log").write_bytes(data)
    (tmp_path / "wal-x.log").write_bytes(b"other")
    assert {(r.wal_id, r.records, r.clean) for r in interchange.log_health(spark, str(tmp_path)).collect()} == {(1, 10, True), (2, 9, False), (7, len(found), False)}
    rows = interchange.read_logs(spark, str(tmp_path)).where("wal_id = 2").orderBy("ordinal").collect()
    assert [(r.op == "del", bytes(r.key), bytes(r.value or b"")) for r in rows] == [(m.deleted, m.key, m.value) for m in made[:9]]


def test_run_files(spark, tmp_path):
    made = [Mutation(i % 7 == 0, f"key{i:08d}".encode(), b"" if i % 7 == 0 else f"value-{i}".encode()) for i in range(1000)]
    raw = write_run(made, 10)
    run = RunFile(raw)
    assert list(run) == made and run.entry_count == 1000 and len(run.index) == 63
    assert all(run.get(m.key)[0] == m and run.get(m.key)[1] <= 16 and run.may_contain(m.key) for m in made)
    assert [run.get(k)[0] for k in (b"a", b"zzz", b"key00000005x")] == [None] * 3
    assert run.get(b"key00000015x") == (None, 17) and run.get(b"a") == (None, 0)
    lengths = [(len(m.key), len(m.value)) for m in made]
    assert len(raw) == policy.run_file_bytes(lengths, 1000, 10)
    assert write_run([], 10) == b""
    for wrong in (made[::-1], [made[0], made[0]]):
        with pytest.raises(ValueError, match="ascend"):
            write_run(wrong, 10)
    for broken in (raw[:20], raw[:-1] + b"x"):
        with pytest.raises(Corrupt):
            RunFile(broken)
    (tmp_path / "000003.sst").write_bytes(raw)
    (tmp_path / "000099.sst.tmp").write_bytes(b"garbage")
    back = interchange.read_runs(spark, str(tmp_path))
    assert back.count() == 1000 and back.where("deleted").count() == 143
    [file] = interchange.run_files(back).collect()
    assert file.run_id == 3 and bytes(file.content) == raw


def test_options_are_validated():
    for wrong in ({"compaction_trigger": 1}, {"memtable_bytes": 0}, {"bloom_bits_per_key": -1}):
        with pytest.raises(ValueError):
            Options(**wrong)


def test_store_reopens_with_all_it_acknowledged(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store.open(spark, path)
    for op in (("a", "1"), ("b", "2"), ("a", "3"), ("", "empty key"), ("e", "")):
        s.put(*op)
    s.delete("b")
    s.delete("never")
    assert s.get("a") == b"3" and s.get("b") is None and s.get("e") == b"" and s.get("") == b"empty key"
    s = Store.open(spark, path)  # from the logs alone
    assert s.get("a") == b"3" and s.get("b") is None and s.get("e") == b"" and s.stats().sstables == 1 and s.stats().flushes == 0
    s.put("c", "9")
    s.flush()
    s.flush()
    s = Store.open(spark, path)
    assert s.get("c") == b"9" and s.get("a") == b"3" and s.stats().sstables == 2
    asked = spark.createDataFrame([(b"a",), (b"b",), (b"zz",), (b"a",)], "key binary")
    assert sorted((bytes(r.key), r.value and bytes(r.value)) for r in s.multi_get(asked).where("value is not null").collect()) == [(b"a", b"3")] * 2
    assert {bytes(r.key): r.state for r in s.three_state(asked).collect()} == {b"a": "live", b"b": "tombstone", b"zz": "unseen"}


def test_store_compaction_drops_tombstones_only_with_the_oldest_run(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(compaction_trigger=100))
    for i, row in enumerate([("put", b"v1"), ("put", b"v2"), ("del", None)]):
        s.append(log(spark, (i + 1, row[0], b"k", row[1])))
    s._compact_newest(2)
    assert s.get("k") is None and s.stats().sstables == 2 and s.stats().sstable_entries == 2
    s.compact()
    assert s.get("k") is None and s.stats().sstables == 0 and s.live().count() == 0
    s.append(log(spark, (2, "put", b"k", b"late"), (4, "put", b"new", b"1")))  # the late row is set aside, the new one counts
    s = Store.open(spark, str(tmp_path / "s"))
    assert s.get("k") is None and s.get("new") == b"1"
    assert [(r.seq, bytes(r.key), bytes(r.value)) for r in s.late().collect()] == [(2, b"k", b"late")]


def test_automatic_compactions_let_rows_come_late(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(compaction_trigger=2, run_partitions=1))
    s.append(log(spark, (10, "del", b"k", None), (11, "put", b"a", b"11")))
    s.append(log(spark, (12, "put", b"b", b"12")))
    s.append(log(spark, (5, "put", b"k", b"hidden"), (6, "put", b"a", b"old"), (13, "put", b"c", b"13")))
    assert s.stats().compactions >= 1 and s.stats().sstables == 1 and s.late().count() == 0
    assert {bytes(r.key): bytes(r.value) for r in s.live().collect()} == {b"a": b"11", b"b": b"12", b"c": b"13"}
    for again in ((5, "put", b"k", b"hidden"), (12, "put", b"b", b"12")):
        s.append(log(spark, again))
    assert s.get("k") is None and s.get("b") == b"12"


def test_writers_that_come_second_try_again(spark, tmp_path):
    one, other = (Store.open(spark, str(tmp_path / "s"), Options(compaction_trigger=100)) for _ in range(2))
    one.append(log(spark, (1, "put", b"a", b"1")))
    other.append(log(spark, (2, "put", b"b", b"2")))
    one.append(log(spark, (3, "del", b"b", None), (4, "put", b"c", b"4")), batch=("x", 0))
    assert other.append(log(spark, (9, "put", b"z", b"9")), batch=("x", 0)) is False  # the other has made this batch
    other.append(log(spark, (5, "put", b"d", b"5")))
    assert [r.run_id for r in other.manifest.runs] == [4, 3, 2, 1]
    stale = Store.open(spark, str(tmp_path / "s"), Options(compaction_trigger=100))
    one._refresh()
    one.compact()
    assert stale._compact_newest(2) is False and stale.manifest == one.manifest
    s = Store.open(spark, str(tmp_path / "s"))
    assert {bytes(r.key): bytes(r.value) for r in s.live().collect()} == {b"a": b"1", b"c": b"4", b"d": b"5"}


def test_damaged_store_is_an_error(spark, tmp_path):
    path = tmp_path / "s"
    Store.open(spark, str(path)).append(log(spark, (1, "put", b"a", b"1")))
    for file in (path / "_manifest").iterdir():
        file.unlink() if file.suffix == ".crc" else file.write_text("{")
    with pytest.raises(Corrupt, match="manifest"):
        Store.open(spark, str(path))


def test_lookups_ask_the_filters(spark, tmp_path):
    for bits in (10, 0):
        s = Store.open(spark, str(tmp_path / f"s{bits}"), Options(compaction_trigger=100, bloom_bits_per_key=bits))
        for k in range(3):
            s.append(log(spark, *[(1 + 3 * i + k, "put", f"key{3 * i + k:05d}".encode(), str(k).encode()) for i in range(400)]))
        for i in (5, 100, 1000):
            assert s.get(f"key{i:05d}") == str(i % 3).encode()
        assert s.get("key00500x") is None and s.get("a") is None
        skipped = s.stats().bloom_skips
        assert skipped == 3 if bits == 0 else 9 <= skipped <= 12  # without filters the ends of the keys exclude "a" alone
        assert skipped + s.stats().table_probes == 15


WRITER = """
import sys
from pyspark.sql import SparkSession
from sedimo.schema import Options
from sedimo.sources.store import Store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
store = Store.open(spark, sys.argv[1], Options(memtable_bytes=4096))
i = 0
while True:
    store.put(f"key{i:08d}", f"value-{i}" + 40 * "x")
    print(i, flush=True)
    i += 1
"""


@pytest.mark.parametrize("after", [3, 130])
def test_killed_writer_loses_nothing_it_acknowledged(spark, tmp_path, after):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    child = subprocess.Popen([sys.executable, "-c", WRITER, str(tmp_path / "s")], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, start_new_session=True)
    last = -1
    for line in child.stdout:
        last = int(line)
        if last >= after:
            break
    os.killpg(child.pid, signal.SIGKILL)  # the session of the writer alone, with its engine
    last = max([last, *(int(x) for x in child.stdout.read().split(b"\n")[:-1])])
    child.wait()
    assert last >= after
    s = Store.open(spark, str(tmp_path / "s"))
    got = {bytes(r.key): bytes(r.value) for r in s.live().collect()}
    assert all(got[f"key{i:08d}".encode()] == f"value-{i}".encode() + 40 * b"x" for i in range(last + 1))
    assert len(got) <= last + 2


def test_store_ignores_what_no_manifest_names(spark, tmp_path):
    path = tmp_path / "s"
    s = Store.open(spark, str(path))
    s.append(log(spark, (0, "put", b"a", b"1"), (2, "del", b"b", None)))
    s.append(log(spark, (3, "put", b"b", b"2")))
    before = s.manifest
    merged = s._write_run(s._by_range(merge.merge_runs(s.sources(), True)))  # a compaction that died before its commit
    (path / RUNS / "_half").mkdir()
    (path / "_manifest" / f"{9:012d}.json").write_text('{"version": 9, "ru')
    s = Store.open(spark, str(path))
    assert s.manifest == before and s.get("b") == b"2"
    s.append(log(spark, (4, "del", b"a", None)))
    assert s.get("a") is None and s.manifest.version == 10
    assert merged.path in s.clean() and Store.open(spark, str(path)).get("b") == b"2"


def test_bad_log_is_kept_and_told(spark, tmp_path):
    path = tmp_path / "s"
    s = Store.open(spark, str(path))
    s.put("a", "1")
    s.put("b", "2")
    last = sorted((path / "_logs").glob("*.log"))[-1]
    last.write_bytes(last.read_bytes()[:-2])
    for crc in (path / "_logs").glob(".*.crc"):
        crc.unlink()
    s = Store.open(spark, str(path))
    assert s.get("a") == b"1" and s.get("b") is None and s.log_health[last.name] == (1, False) and last.exists()  # one log holds both
    s.put("b", "3")
    assert Store.open(spark, str(path)).get("b") == b"3"


def test_random_batches_against_a_dict(spark, tmp_path):
    rng = random.Random(12345)
    s, want, seq = Store.open(spark, str(tmp_path / "s"), Options(compaction_trigger=3)), {}, 0
    for batch in range(9):
        rows = []
        for _ in range(120):
            seq += 1
            k = f"k{rng.randrange(60)}".encode()
            if rng.random() < 0.3:
                rows.append((seq, "del", k, None))
                want.pop(k, None)
            else:
                v = rng.randbytes(rng.randrange(100))
                rows.append((seq, "put", k, v))
                want[k] = v
        rng.shuffle(rows)
        s.append(log(spark, *rows))
        if batch == 4:
            s.compact()
            s = Store.open(spark, str(tmp_path / "s"), Options(compaction_trigger=3))
    assert {bytes(r.key): bytes(r.value) for r in s.live().collect()} == want
    s.compact()
    assert s.stats().sstable_entries == len(want) and s.stats().compactions > 0


def test_stream_into_a_store_is_exactly_once(spark, tmp_path):
    rows = [(i, "del" if i % 5 == 0 else "put", f"k{i % 7}".encode(), None if i % 5 == 0 else str(i).encode()) for i in range(1, 60)]
    for k in range(3):
        log(spark, *rows[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = Store.open(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema(mutation_log()).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, s, str(tmp_path / "c"), once=True).awaitTermination()
    want = {bytes(r.key): bytes(r.value) for r in merge.live(merge.memtable_state(log(spark, *rows))).collect()}
    assert {bytes(r.key): bytes(r.value) for r in s.live().collect()} == want
    done = s.manifest
    assert s.append(log(spark, *rows), batch=("ingest", 2)) is False and s.manifest == done
    q = live_changes(stream).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {bytes(r.key): bytes(r.value) for r in spark.table("live").where("not deleted").collect()} == want


def test_shell(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(memtable_bytes=4096))
    lines = ["put a  one two ", "get a", "get b", "put k", "get k", "del a", "get a", "", "flush", "compact", "what", "stats", "quit", "get k"]
    assert list(shell(s, [x + "\n" for x in lines])) == [
        "ok", "one two ", "(not found)", "ok", "", "ok", "(not found)", "flushed", "compacted", "unknown command",
        "sstables=1 entries=1 flushes=1 compactions=1 bloom_skips=0 table_probes=0",
    ]


def test_late_mutations_take_part_whatever_their_number(spark):
    newest = {r.key: r.seq for r in catalogue.versions(spark, SF).groupBy("key").agg(F.max("seq").alias("seq")).collect()}
    assert any(n % 3 == 1 for n in newest.values())
    assert {r.key: r.seq for r in catalogue.QUERIES["late_mutations"](spark, SF).collect()} == newest


@pytest.mark.parametrize("name", ["block_scan_cost", "run_scan"])
def test_every_run_is_covered(spark, name):
    sf = SF.replace("sf0.001", "sf0.01")  # ten runs
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(catalogue.SQL[name])
    got = catalogue.QUERIES[name](spark, sf).select(*[d[0] for d in want.description]).collect()
    assert {r.run_id for r in got} == set(range(10)) and told(map(tuple, got)) == told(want.fetchall())


def test_payload_checksum_is_that_of_the_log_record(spark):
    rows = catalogue.mutations(spark, SF).collect()
    want = {r.seq: int.from_bytes(log_record(Mutation(r.op == "del", r.key.encode(), (r.value or "").encode()))[:4], "little") for r in rows}
    assert {r.seq: r.crc for r in catalogue.QUERIES["wal_record_crc"](spark, SF).collect()} == want


def rows_shuffled(spark, make):
    """How many rows the stages that ``make`` runs write for shuffles, and what it returns."""
    sc, none = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList()
    no_quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(none, False, False, no_quantiles, none)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = written()
    found = make()
    return sum(n for stage, n in written().items() if stage not in before), found


@pytest.fixture(scope="module")
def many_pairs(spark, tmp_path_factory):
    """Tables whose runs and lookup keys make far more pairs than rows."""
    root = str(tmp_path_factory.mktemp("pairs"))
    events = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/events.parquet")
    copies = [events.withColumn("event_id", F.col("event_id") + 10_000 * r).withColumn("user_id", F.col("user_id") + 40 * r) for r in range(2)]
    copies[0].unionByName(copies[1]).write.parquet(f"{root}/events.parquet")
    spark.range(20_000).select(F.col("id").alias("c_custkey")).write.parquet(f"{root}/customer.parquet")
    return root


def test_asking_every_filter_makes_no_row_of_a_pair(spark, many_pairs):
    shuffled, found = rows_shuffled(spark, lambda: catalogue.QUERIES["bloom_probes"](spark, many_pairs).collect())
    assert len(found) == 20 and all(r.asked == 20_000 for r in found)
    assert shuffled < 20 * 20_000 / 2


@pytest.mark.parametrize("cell", [(1 << 16, 1 << 22), (70, 100)])
def test_filters_asked_together_tell_what_each_tells_alone(spark, monkeypatch, cell):
    monkeypatch.setattr(bloom, "CELL_KEYS", cell[0])
    monkeypatch.setattr(bloom, "CELL_BYTES", cell[1])
    if cell[0] < 100:
        monkeypatch.setattr(bloom, "LANES", 3)
        monkeypatch.setattr(bloom, "CHUNK", 11)
    rng = random.Random(8)
    own = {run: [f"k{rng.randrange(400)}".encode() for _ in range(rng.choice([1, 8, 30, 30, 90]))] for run in range(70)}
    asked = [f"k{i}".encode() for i in range(0, 800, 3)] + ["ünï".encode(), b""]
    filters = {run: Bloom.of(keys, 0 if run == 5 else 10) for run, keys in own.items()}
    filters[70] = Bloom(64, 6, bloom.np.zeros(8, bloom.np.uint8))  # nothing is in it
    made = spark.createDataFrame([(run, f.serialize()) for run, f in filters.items()], "run_id long, bloom binary")
    keys = spark.createDataFrame([(k,) for k in [*asked, None]], "key binary")
    got = bloom.pass_counts(keys, made, len(asked), sum(len(f.serialize()) for f in filters.values())).collect()
    want = {run: (len(asked), int(f.may_contain(asked).sum())) for run, f in filters.items() if run != 70}
    assert {r.run_id: (r.asked, r.passed) for r in got} == want and len(got) == len(want)
    assert bloom.pass_counts(keys.where("false"), made, 0, 0).count() == 0 and bloom.pass_counts(keys, made.where("false"), 9, 9).count() == 0


@pytest.mark.parametrize("name", ["block_scan_cost", "sparse_index_seek"])
def test_pairs_of_runs_and_targets_are_not_shuffled(spark, many_pairs, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{many_pairs}/{t}.parquet/*.parquet'")
    [(want,)] = con.execute(f"SELECT count(*) FROM ({catalogue.SQL[name]})").fetchall()
    # All columns are made, as a count alone would not need them.
    shuffled, got = rows_shuffled(spark, lambda: catalogue.QUERIES[name](spark, many_pairs).agg(F.count(F.hash("*"))).first()[0])
    assert got == want > 350_000
    assert shuffled < want / 2


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_seeks_of_odd_keys(spark, monkeypatch, chunk):
    monkeypatch.setattr(lookup, "CHUNK", chunk)
    rng = random.Random(9)
    runs = {g: sorted({rng.choice([b"", b"\x80\xff", f"k{rng.randrange(200)}".encode()]) for _ in range(n)}) for g, n in ((1, 120), (2, 1), (3, 40))}
    run = spark.createDataFrame([(g, k, b"v") for g, keys in runs.items() for k in keys], "run_id long, key binary, value binary")
    asked = [b"", b"k", b"zz", b"\x80", b"\xff\xff", *[f"k{i}".encode() for i in range(0, 250, 3)]]
    targets = spark.createDataFrame([(k,) for k in [*asked, *asked[:5], None]], "key binary")
    want = {}
    for g, keys in runs.items():
        for t in asked:
            at = sum(k <= t for k in keys) - 1
            if at >= 0:
                first = at // 16 * 16
                # A key that is absent takes one record more, where there is one.
                read = at - first + 1 + (keys[at] != t and at + 1 < len(keys))
                want[g, t] = keys[first], first, read
    for cuts in ([], [b"k1", b"k15", b"k3"], [b"zzz"]):
        seeks = lookup.sparse_index_seek(lookup.sparse_index(run, ["run_id"], cuts), targets, ["run_id"], cuts).collect()
        assert {(r.run_id, bytes(r.target)): (bytes(r.block), r.first) for r in seeks} == {k: x[:2] for k, x in want.items()} and len(seeks) == len(want)
        costs = lookup.scan_costs(run, targets, ["run_id"], cuts).collect()
        assert {(r.run_id, bytes(r.target)): r.records for r in costs} == {k: x[2] for k, x in want.items()} and len(costs) == len(want)
