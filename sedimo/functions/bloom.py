"""Bloom filters with the documented parameters, hash and layout.

Stored tables use Parquet's own filters for skipping.  These functions serve
interchange with run files and exact accounting of probes; hashing is done for
whole columns with numpy, as it needs wrapping 64-bit arithmetic.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimo.schema import BLOOM_HEADER_BYTES

# Fixed values of the filter's format.
FNV_BASIS = 1469598103934665603
FNV_PRIME = 1099511628211
SECOND_SEED = 0x9E3779B97F4A7C15
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
LN2 = 0.69
LEAST_BITS = 64
MOST_HASHES = 30
#: Runs whose filters are asked at once, a bit for each, and keys that are asked at once.
LANES, CHUNK = 512, 4096
#: Keys, and bytes of filters, that meet in one task.
CELL_KEYS, CELL_BYTES = 1 << 16, 4 << 20


def bloom_params(keys: int, bits_per_key: int) -> tuple[int, int]:
    """``(bits, hashes)``; zero bits where the filter is off."""
    if bits_per_key <= 0:
        return 0, 0
    bits = -(-max(LEAST_BITS, keys * bits_per_key) // 8) * 8
    return bits, min(max(int(bits_per_key * LN2), 1), MOST_HASHES)


def bloom_bytes(keys: int, bits_per_key: int) -> int:
    """Bytes of a written filter."""
    bits, _ = bloom_params(keys, bits_per_key)
    return BLOOM_HEADER_BYTES + bits // 8 if bits else 0


def bloom_params_columns(keys: Column, bits_per_key: int) -> tuple[Column, Column]:
    """The same as columns."""
    if bits_per_key <= 0:
        return F.lit(0).cast("long"), F.lit(0)
    bits = F.ceil(F.greatest(F.lit(LEAST_BITS).cast("long"), keys * bits_per_key) / 8).cast("long") * 8
    return bits, F.lit(min(max(int(bits_per_key * LN2), 1), MOST_HASHES))


def _mixed(h: np.ndarray) -> np.ndarray:
    for factor in (MIX_1, MIX_2):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def hash_pairs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each key; the second is odd.

    Keys are taken one byte place at a time, all keys at once.
    """
    lengths = np.array([len(k) for k in keys], np.int64)
    width = int(lengths.max(initial=0))
    grid = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), np.uint8).reshape(len(keys), width) if width else None
    out = []
    for seed in (0, SECOND_SEED):
        h = np.full(len(keys), FNV_BASIS ^ seed, np.uint64)
        for i in range(width):
            h = np.where(i < lengths, (h ^ grid[:, i].astype(np.uint64)) * np.uint64(FNV_PRIME), h)
        out.append(_mixed(h))
    return out[0], out[1] | np.uint64(1)


@dataclass
class Bloom:
    """A filter; without bits it is off and holds everything."""

    bits: int = 0
    hashes: int = 0
    data: np.ndarray | None = None

    @classmethod
    def of(cls, keys: list[bytes], bits_per_key: int, expected: int | None = None) -> Bloom:
        bits, hashes = bloom_params(len(keys) if expected is None else expected, bits_per_key)
        if not bits:
            return cls()
        flags = np.zeros(bits, np.uint8)
        if keys:
            flags[cls(bits, hashes)._places(keys).ravel()] = 1
        return cls(bits, hashes, np.packbits(flags, bitorder="little"))

    def _places(self, keys: list[bytes]) -> np.ndarray:
        h1, h2 = hash_pairs(keys)
        steps = np.arange(self.hashes, dtype=np.uint64)
        return ((h1[:, None] + steps * h2[:, None]) % np.uint64(self.bits)).astype(np.int64)

    def may_contain(self, keys: list[bytes]) -> np.ndarray:
        """Whether each key may be in; never false for one that was added."""
        if not self.bits:
            return np.ones(len(keys), bool)
        if not keys:
            return np.zeros(0, bool)
        at = self._places(keys)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)

    def serialize(self) -> bytes:
        return struct.pack("<IQ", self.hashes, self.bits) + self.data.tobytes() if self.bits else b""

    @classmethod
    def deserialize(cls, raw: bytes) -> Bloom:
        if not raw:
            return cls()
        if len(raw) < BLOOM_HEADER_BYTES:
            raise ValueError("corrupt bloom filter")
        hashes, bits = struct.unpack_from("<IQ", raw)
        if not bits or bits % 8 or bits // 8 != len(raw) - BLOOM_HEADER_BYTES or not hashes:
            raise ValueError("corrupt bloom filter")
        return cls(bits, hashes, np.frombuffer(raw, np.uint8, offset=BLOOM_HEADER_BYTES))


def _as_bytes(column: pa.Array) -> list[bytes]:
    return [k.encode() if isinstance(k, str) else k for k in column.to_pylist()]


def build_filters(runs: DataFrame, bits_per_key: int, by: str = "run_id") -> DataFrame:
    """``(by, bloom)``: the serialized filter of each run's keys.

    A filter is as large as its run demands, so a run is one group here; runs
    are bounded by the flush threshold or split before.
    """

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        raw = Bloom.of(_as_bytes(table["key"].combine_chunks()), bits_per_key).serialize()
        return pa.table({by: [key[0].as_py()], "bloom": [raw]}, schema=pa.schema([(by, pa.int64()), ("bloom", pa.binary())]))

    return runs.select(F.col(by).cast("long").alias(by), "key").groupBy(by).applyInArrow(build, f"{by} long, bloom binary")


def probe_filters(asked: DataFrame, filters: DataFrame, by: str = "run_id") -> DataFrame:
    """``(by, key, maybe)`` for each row ``(by, key)``: whether the filter of its run may hold the key.

    A filter meets all keys asked of it once, in one task; a run without a
    filter may hold every key.
    """

    def probe(keys: pa.Table, blooms: pa.Table) -> pa.Table:
        raw = blooms["bloom"][0].as_py() if blooms.num_rows else b""
        found = Bloom.deserialize(raw).may_contain(_as_bytes(keys["key"].combine_chunks()))
        return pa.table([keys[by], keys["key"], pa.array(found, pa.bool_())], names=[by, "key", "maybe"])

    kind = asked.schema["key"].dataType.simpleString()
    wanted = asked.select(F.col(by).cast("long").alias(by), "key")
    return wanted.groupBy(by).cogroup(filters.groupBy(by)).applyInArrow(probe, f"{by} long, key {kind}, maybe boolean")


def key_hashes(keys: DataFrame) -> DataFrame:
    """``(key, h1, h2)``: the two hashes of each row's key, as signed numbers."""

    def hashes(names: pa.Array) -> pa.Array:
        h1, h2 = hash_pairs(_as_bytes(names))
        return pa.StructArray.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["h1", "h2"])

    return keys.select("key", F.arrow_udf(hashes, "h1 long, h2 long")("key").alias("h")).select("key", "h.h1", "h.h2")


def filter_figures(filters: DataFrame, by: str = "run_id") -> DataFrame:
    """``(by, bits, hashes, bits_set, place_sum)`` of each serialized filter: its parameters, and how many places are set and their sum."""

    def figures(blooms: pa.Array) -> pa.Array:
        rows = []
        for raw in blooms:
            f = Bloom.deserialize(raw.as_py())
            at = np.flatnonzero(np.unpackbits(f.data, bitorder="little")) if f.bits else np.empty(0, np.int64)
            rows.append((f.bits, f.hashes, len(at), int(at.sum())))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["bits", "hashes", "bits_set", "place_sum"])

    return filters.select(by, F.arrow_udf(figures, "bits long, hashes long, bits_set long, place_sum long")("bloom").alias("f")).select(by, "f.*")


def _asked_together(filters: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many keys each of ``filters``, all of one shape, lets pass, and whether any key meets a set bit of it.

    The filters are laid side by side: a row for each place, with a bit for each
    filter, so that one operation asks 64 of them.
    """
    bits, hashes = filters[0].bits, filters[0].hashes
    width = -(-len(filters) // 64) * 64
    flags = np.zeros((bits, width), np.uint8)
    for i, f in enumerate(filters):
        flags[:, i] = np.unpackbits(f.data, bitorder="little")
    table = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
    passed, met = np.zeros(width, np.int64), np.zeros(width // 64, np.uint64)
    for at in range(0, len(h1), CHUNK):
        x, y = h1[at : at + CHUNK], h2[at : at + CHUNK]
        all_set = np.full((len(x), width // 64), np.iinfo(np.uint64).max, np.uint64)
        for k in range(hashes):
            rows = table[((x + np.uint64(k) * y) % np.uint64(bits)).astype(np.int64)]
            all_set &= rows
            met |= np.bitwise_or.reduce(rows, axis=0)
        passed += np.unpackbits(all_set.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return passed[: len(filters)], np.unpackbits(met.view(np.uint8), bitorder="little")[: len(filters)].astype(bool)


def pass_counts(keys: DataFrame, filters: DataFrame, n_keys: int, filter_bytes: int, by: str = "run_id") -> DataFrame:
    """``(by, asked, passed)``: of all ``keys`` how many each run's filter is asked for and lets pass.

    Every filter is asked for every key, but no pair becomes a row.  Keys are
    dealt to slots and filters to parts, by ``n_keys`` and ``filter_bytes``,
    which are estimates and change no result; a task has one slot and one part.
    A run without a set bit that any key meets gives no row.
    """
    slots, parts = max(1, -(-n_keys // CELL_KEYS)), max(1, -(-filter_bytes // CELL_BYTES))
    dealt = key_hashes(keys.where("key is not null")).withColumn("slot", F.pmod("h1", F.lit(slots)).cast("int"))
    dealt = dealt.select("slot", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "h1", "h2")
    laid = filters.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    laid = laid.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "part", F.col(by).cast("long").alias(by), "bloom")

    def ask(asked: pa.Table, blooms: pa.Table) -> pa.Table:
        h1, h2 = (asked[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        alike: dict[tuple[int, int], list[tuple[int, Bloom]]] = {}
        for run, raw in zip(blooms[by].to_pylist(), blooms["bloom"].to_pylist(), strict=True):
            f = Bloom.deserialize(raw)
            alike.setdefault((f.bits, f.hashes), []).append((run, f))
        rows = []
        for (bits, _), own in alike.items():
            for i in range(0, len(own), LANES):
                runs, some = zip(*own[i : i + LANES], strict=True)
                passed, met = _asked_together(list(some), h1, h2) if bits else ([len(h1)] * len(runs), [len(h1) > 0] * len(runs))
                rows += zip(runs, [len(h1)] * len(runs), map(int, passed), map(bool, met), strict=True)
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[by, "asked", "passed", "met"])

    found = dealt.groupBy("slot", "part").cogroup(laid.groupBy("slot", "part")).applyInArrow(ask, f"{by} long, asked long, passed long, met boolean")
    return found.groupBy(by).agg(F.sum("asked").alias("asked"), F.sum("passed").alias("passed"), F.max("met").alias("met")).where("met").drop("met")
