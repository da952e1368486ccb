"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has one bit for each bit of its shingles' hashes: the
majority.  Candidates come from ``2**(radius+1) - 1`` tables.  Each of the 64
bit positions gets a vector of ``radius + 1`` bits; the table of a non-zero
vector v keeps the positions whose vector has an odd product with v.  For any
``radius`` differing positions there is a v that is orthogonal to all their
vectors, so its table keeps none of them: every pair within the radius falls
into one bucket of some table, without fail.

Buckets of at most ``SMALL`` are compared pair by pair.  A larger bucket would
need all its pairs; there each fingerprint is dealt to the points at most one
bit away from it instead (outside the bits that the bucket shares).  Two
fingerprints meet at such a point if and only if they differ in two bits at
most, so the links to each point's least member give the same components, with
rows in proportion to the members.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimo.llm.components import connected_components
from sedimo.llm.shared import discard, save

BITS = 64
SEED = 42
#: Members up to which a bucket gives its pairs; a larger one gives points, which connect the same fingerprints.
SMALL = 16
CHUNK = 1 << 16
#: Odd multipliers for further fingerprints from the same hashes, from a seeded generator.
_MIX = [random.Random(f"print {k}").getrandbits(64) | 1 for k in range(64)]


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included.

    A-Z is lower-cased; fewer words than ``width`` are one shingle; none give
    an empty array.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    cuts = map(slice, starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, n)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return h
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[k])
    return h ^ (h >> np.uint64(32))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit number."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, prints: int = 1) -> DataFrame:
    """``(doc_id, prints)``: an array of ``prints`` fingerprints of each row's whole text.

    The first is the plain one; the others come from the same hashes, mixed.
    A null or blank text has zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), width)
                rows.append([majority(_mixed(h, k)) for k in range(prints)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "prints"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, prints array<long>")


def covering_masks(radius: int, seed: int = SEED, bits: int = BITS) -> list[int]:
    """One mask over the lowest ``bits`` positions for each table, as signed 64-bit numbers."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def _signed(bit: int) -> int:
    return -(1 << 63) if bit == 63 else 1 << bit


def similar(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes with fingerprints within ``radius`` bits; a written table.

    ``nodes`` has ``node`` and ``prints``; any of the prints may link.
    """
    if radius not in (1, 2):
        raise ValueError("large buckets are resolved for a radius of 1 or 2")
    masks = covering_masks(radius)
    one = nodes.select("node", F.posexplode("prints").alias("k", "fp"))
    dealt = one.select("node", "k", "fp", F.posexplode(F.array(*map(F.lit, masks))).alias("t", "mask"))
    dealt = dealt.select("node", "k", "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # A table of its own, so that the join reads plain shuffles and a large bucket can be split among tasks.
    shared = save(dealt.groupBy("k", "t", "key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = save(dealt.join(shared, ["k", "t", "key"]), "buckets")

    pairs = (
        met.where(F.col("n") <= SMALL)
        .groupBy("k", "t", "key")
        .agg(F.collect_list(F.struct("fp", "node")).alias("m"))
        .select(
            F.explode(
                F.flatten(
                    F.transform(
                        "m",
                        lambda x, i: F.transform(
                            F.filter(F.slice("m", i + 2, SMALL), lambda y: F.bit_count(x.fp.bitwiseXOR(y.fp)) <= radius),
                            lambda y: F.struct(x.node.alias("a"), y.node.alias("b")),
                        ),
                    )
                )
            ).alias("p")
        )
        .select("p.a", "p.b")
    )
    flips = F.array(F.lit(0), *[F.lit(_signed(i)) for i in range(BITS)])
    mask = F.element_at(F.array(*map(F.lit, masks)), F.col("t") + 1)
    points = (
        met.where(F.col("n") > SMALL)
        .select("node", "k", "fp", mask.alias("mask"), F.explode(flips).alias("flip"))
        .where("(flip & mask) = 0")
        .select("node", "k", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), (F.col("flip") == 0).alias("own"))
    )
    # A radius of 1 asks for a member at the point itself; 2 does not.
    least = points.groupBy("k", "z").agg(F.min("node").alias("b"), F.max("node").alias("top"), F.max("own").alias("own"))
    least = save(least.where("b <> top" if radius == 2 else "b <> top and own").select("k", "z", "b"), "least")
    stars = points.join(least, ["k", "z"]).where("node <> b").select(F.col("node").alias("a"), "b")
    found = save(pairs.unionByName(stars).distinct(), "similar")
    discard(shared, met, least)
    return found


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, prints: int = 1, links: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(doc_id, prints, component_id)``, a row for each row of ``docs``.

    ``component_id`` is the least doc_id reachable through fingerprints that
    differ in at most ``radius`` bits, or through ``links`` where that is given,
    a function from nodes and their fingerprints to links.  Equal fingerprints are one node, named
    by its least doc_id, so that groups of exact copies cost one row.  Rows that
    share a doc_id count as one document.  A null doc_id has its fingerprint and
    takes the component of an equal fingerprint; a fingerprint that only null
    ids have stays alone, with a null component_id.  Whole texts count, whatever
    their length; other columns are left out.  No rows give no rows.
    """
    return grouped(save(fingerprints(docs, width, prints), "prints"), links or (lambda known: similar(known, radius)))


def grouped(made: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made``, rows of ``doc_id`` and ``prints``, with the ``component_id`` of :func:`near_duplicates`."""
    nodes = save(made.groupBy("prints").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")), "nodes")
    known = nodes.where("node is not null").select("prints", "node")
    # Texts of one doc_id that differ are one document: its ids link them.
    same = made.where("doc_id is not null").join(known, "prints").where("doc_id <> node").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")
    )
    repeated = made.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("prints").alias("x"), F.max("prints").alias("y")
    ).where("x <> y").select(F.col("doc_id").alias("a"))
    roots = connected_components(links(known).unionByName(same.join(repeated, "a", "left_semi")), "a", "b")
    classes = nodes.join(roots, "node", "left").select("prints", F.coalesce("root", "node").alias("component_id"))
    return made.join(classes, "prints")


def drop_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """Keep the row with the least doc_id of each group, with all its columns.

    Groups are those of :mod:`sedimo.llm.overlap` over sets of shingles of
    ``width`` words: what links of a similarity of 0.8 or more connect.  Texts
    without any word, null ones too, are one group.  Of rows that share a doc_id
    the one with the least other columns stays, in their order.  Rows without a
    doc_id cannot be named by a group and stay.  Texts are compared whole,
    whatever their length.  Other columns, which have to be of types that have
    an order, come along.  No rows give no rows.
    """
    from sedimo.llm import overlap  # it builds on this module

    groups = overlap.copies(docs, width)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in docs.columns if c != "doc_id"]
    named = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("least")).select("doc_id", "least.*")
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
