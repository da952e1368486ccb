"""Near-duplicates by the exact similarity of shingle sets, with candidates by SimHash and, beyond its radius, MinHash.

The similarity of two documents is the number of shingles that both have over
the number that either has.  First come the pairs whose fingerprints the
covering tables of :mod:`sedimo.llm.simhash` bring together.  Among what these
leave apart, candidates are the pairs that agree in all ``ROWS`` minima of any
of ``BANDS`` bands; a pair of similarity s agrees in one with a probability of
``1 - (1 - s**ROWS)**BANDS``, 0.999993 at 0.8, where 15 % of a fingerprint's bits
differ.  Every link is then decided by the whole sets.

Buckets of at most ``SMALL`` give all their pairs.  In a larger one all members
are compared with a few heads first; one minus the similarity is a metric, so
:func:`links_left` finds the links that are left without
comparing all pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from sedimo.llm import simhash
from sedimo.llm.components import connected_components
from sedimo.llm.shared import discard, save

BANDS, ROWS = 30, 5
#: One minus the least similarity, 0.8.  Similarities are quotients of whole numbers, none of which lies so close
#: below 0.8 that the allowance for rounding takes it in.
DISTANCE = 0.2 + 1e-9
#: Members up to which a bucket gives all its pairs, heads of a larger one, and members of a block.
SMALL, HEADS, BLOCK = 16, 2, 64
CHUNK = 1 << 10
#: Columns of a block's table of members by shingles that are held at once, and documents whose sets are sent at once.
COLUMNS, SENT = 1 << 14, 256
_ORDERS = np.array([random.Random(f"order {k}").getrandbits(64) | 1 for k in range(BANDS * ROWS)], np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, width))


def digest(s: np.ndarray) -> bytes:
    """Equal for equal sets, 128 bits."""
    return xxhash.xxh3_128_digest(s.tobytes())


def band_keys(s: np.ndarray) -> list[int]:
    """One number for each band, of its minima; none for an empty set."""
    if not len(s):
        return []
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), CHUNK):
        np.minimum(least, np.multiply.outer(_ORDERS, s[i : i + CHUNK]).min(axis=1), out=least)
    raw = least.tobytes()
    n = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[b * n : b * n + n], b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, prints, fp, bands)``: the digest of each row's set, its text's fingerprint and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, bands = [], [], []
            for text in batch.column(1):
                h = simhash.shingle_hashes(text.as_py(), width)
                s = np.unique(h)
                digests.append(digest(s))
                prints.append(simhash.majority(h))
                bands.append(band_keys(s))
            made = [pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "prints", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, prints binary, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(node, digest, prints)``: each row's doc_id, its set's digest and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SENT):
                part = batch.slice(at, SENT)
                sets = [shingle_set(text.as_py(), width) for text in part.column(1)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(digest, sets), pa.binary()), pa.ListArray.from_arrays(ends, flat)], ["node", "digest", "prints"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "node long, digest binary, prints array<long>")


def apart(x: Column, y: Column) -> Column:
    """One minus the similarity of two sets."""
    both = F.size(F.array_intersect(x, y))
    return 1 - both / (F.size(x) + F.size(y) - both)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each two of ``sets`` how many members they share."""
    sizes = [len(s) for s in sets]
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row, order = np.repeat(np.arange(len(sets)), sizes), np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(column[-1]) + 1, COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[i:j], column[i:j] - lo] = 1
        both += has @ has.T
    return both


def least_reached(link: np.ndarray) -> np.ndarray:
    """For each row of a matrix of links, each row linked to itself, the least position it hangs together with."""
    at = np.arange(len(link))
    while True:
        moved = np.where(link, at[None, :], len(at)).min(axis=1)
        moved = moved[moved]
        if (moved == at).all():
            return at
        at = moved


def _within(blocks: GroupedData, distance: float) -> DataFrame:
    """Links ``(a, b)`` that connect the members of each block as all its pairs within ``distance`` do; all are compared."""

    def run(block: pa.Table) -> pa.Table:
        node = block["node"].to_numpy()
        sets = [x.values.to_numpy() for x in block["prints"].combine_chunks()]
        both, n = overlaps(sets), np.array([len(s) for s in sets])
        at = least_reached(1 - both / (n[:, None] + n[None, :] - both) <= distance)
        moved = at != np.arange(len(at))
        return pa.table([pa.array(node[moved]), pa.array(node[at[moved]])], names=["a", "b"])

    return blocks.applyInArrow(run, "a long, b long")


def links_left(
    members: DataFrame,
    joined: DataFrame,
    nodes: DataFrame,
    distance: float,
) -> DataFrame | None:
    """The links of large buckets between nodes that ``joined`` doesn't connect yet; None if no bucket has two components.

    ``members`` has ``key``, ``node`` and ``near``, the distances to the bucket's
    heads.  A member's home is the first head within ``distance``.  By the
    triangle inequality, one farther than twice that from a head has no link to
    its home members, so only those between ask there; members without a home
    are compared in blocks.  Whatever is in one component already is not
    compared.
    """
    named = members.join(joined.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = save(named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key"), "several")
    home = F.filter("near", lambda h: h.d <= distance)
    left = save(named.join(mixed, "key").withColumn("home", F.get(home, 0)), "mixed")
    if left.isEmpty():
        return None
    prints = nodes.select("node", "prints")
    held = left.where("home is not null").select("key", F.col("home.head").alias("head"), "node", "root", F.col("home.d").alias("d"))
    asks = left.select("key", "node", "root", F.explode("near").alias("h")).where((F.col("h.d") > distance) & (F.col("h.d") <= 2 * distance))
    asks = asks.select("key", F.col("h.head").alias("head"), F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("h.d").alias("a_d"))
    # Home members share their head's component, so one row tells whether asking there can join anything.
    heads = held.groupBy("key", "head").agg(F.first("root").alias("h_root"))
    asks = asks.join(heads, ["key", "head"]).where("a_root <> h_root")
    asks = asks.join(prints.select(F.col("node").alias("a"), F.col("prints").alias("a_prints")), "a")
    held = held.join(asks.select("key", "head").distinct(), ["key", "head"], "left_semi").join(prints, "node")
    held = held.select(F.col("key").alias("k"), F.col("head").alias("h"), "node", "d", "prints")
    close = (F.col("a_d") - F.col("d") <= distance) & (apart(F.col("a_prints"), F.col("prints")) <= distance)
    answers = asks.join(held, (F.col("key") == F.col("k")) & (F.col("head") == F.col("h")) & close).select("a", F.col("node").alias("b"))

    rest = left.where("home is null").select("key", "node", "root")
    sizes = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = rest.join(sizes.select("key", parts.alias("parts")), "key").withColumn("b", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j")))
    rest = rest.select("key", "node", F.explode(blocks).alias("p")).select("key", "node", "p.i", "p.j").join(prints, "node")
    return answers.unionByName(_within(rest.groupBy("key", "i", "j"), distance))


def links(known: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links ``(a, b)`` that connect all candidates of ``known`` within ``DISTANCE``.

    ``known`` has ``node``, ``prints``, a digest, ``fp`` and ``bands``.  Only the
    sets of candidates are made a second time and kept, from their rows of
    ``docs``.  Pairs that the fingerprints' links have settled are not compared.
    """
    covered = simhash.similar(known.select("node", F.array("fp").alias("prints")))
    dealt = known.select("node", F.explode("bands").alias("key"))
    # Tables of their own, here and below, so that joins read plain shuffles and a large bucket can be split among tasks.
    shared = save(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = save(dealt.join(shared, "key"), "buckets")
    discard(shared)
    several = met.select("node").union(covered.select("a")).union(covered.select("b")).distinct()
    asked = known.join(several, "node").select("node", F.col("prints").alias("digest"))
    rows = docs.join(asked.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    made = shingle_sets(rows, width).join(asked, ["node", "digest"]).dropDuplicates(["digest"])
    sets = save(made.select("node", "prints"), "sets")
    one, other = (sets.select(F.col("node").alias(x), F.col("prints").alias(f"{x}_prints")) for x in "ab")

    def close(pairs: DataFrame) -> DataFrame:
        return pairs.join(one, "a").join(other, "b").where(apart(F.col("a_prints"), F.col("b_prints")) <= DISTANCE).select("a", "b")

    printed = save(close(covered), "printed")
    settled = connected_components(printed, "a", "b")
    x, y = (settled.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")

    few = met.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
    apart_yet = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
    found = printed.unionByName(close(pairs.join(x, "a", "left").join(y, "b", "left").where(apart_yet).select("a", "b")))

    large = met.where(F.col("n") > SMALL).select("key", "node")
    heads = large.groupBy("key").agg(*[F.min_by("node", F.xxhash64("node", F.lit(h))).alias(f"h{h}") for h in range(HEADS)])
    heads = save(heads.select("key", F.explode(F.array_distinct(F.array(*[f"h{h}" for h in range(HEADS)]))).alias("head")), "heads")
    asks = save(large.join(heads, "key"), "asks")
    away = asks.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct().join(one, "a").join(other, "b")
    away = save(away.select(F.col("a").alias("node"), F.col("b").alias("head"), apart(F.col("a_prints"), F.col("b_prints")).alias("d")), "away")
    stars = away.where(F.col("d") <= DISTANCE).select(F.col("node").alias("a"), F.col("head").alias("b"))
    joined = connected_components(found.unionByName(stars), "a", "b")
    near = asks.join(away, ["node", "head"]).groupBy("key", "node").agg(F.collect_list(F.struct("head", "d")).alias("near"))
    members = save(near, "members")
    left = links_left(members, joined, sets, DISTANCE)
    joined = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
    out = joined if left is None else save(joined.unionByName(left).distinct(), "overlapping")
    if left is not None:
        discard(met, sets, heads, asks, away, members, covered, printed)
    return out


def copies(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, prints, component_id)`` as :func:`sedimo.llm.simhash.near_duplicates` gives them.

    Equal sets are one node; rows without any word are equal.
    """
    made = save(sketches(docs, width), "sketches")
    # Equal sets have equal bands; fingerprints count repeats, so one is chosen.
    bands = made.where("doc_id is not null").groupBy("prints").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    return simhash.grouped(made.select("doc_id", "prints"), lambda known: links(known.join(bands, "prints"), docs, width))
