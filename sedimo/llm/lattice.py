"""Near-duplicate vectors by lattice hashing.

Each table projects a unit vector at random into eight dimensions and takes the
nearest point of the E8 lattice as its cell.  A vector stands at home in its own
cell and probes the next nearest lattice points; two vectors are compared where
one of them is at home and the other at home or probing.  Every pair compared is
verified by its cosine in double precision.

Equal vectors are one node with a number of copies.  A pair that meets in
several cells is counted in the first of them only, so no list of pairs is ever
made: a group returns, for each member, how many links it has there and the
least member it hangs together with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimo.llm.components import connected_components
from sedimo.llm.shared import discard, save

COSINE = 0.93
TABLES = 8
PROBES = 3
#: Standard deviation of a projection's entries.  At 0.8 a pair at the bound itself (0.37 apart) meets in some table
#: 995 times in 1000, and one of unrelated vectors is compared once in 100 (measured in 64 dimensions).
SCALE = 0.8
SEED = 7
#: Members of a group; larger cells are cut into blocks, and each pair of blocks is a group.
BLOCK = 1024
PAIRS = 1 << 17

LINKS = "nid long, n long, root long"


def _coset(y: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and a next point of D8 + shift to each row of ``y``."""
    near = np.rint(y - shift)
    off = y - shift - near
    turn = np.where(off >= 0, 1.0, -1.0)
    order = np.argsort(-np.abs(off), axis=1, kind="stable")
    rows = np.arange(len(y))
    odd = near.sum(axis=1) % 2 != 0
    first, second = near.copy(), near.copy()
    # An odd sum has to change one coordinate, the one that costs least; an even one none, or two.
    a, b = order[:, 0], order[:, 1]
    first[rows[odd], a[odd]] += turn[rows[odd], a[odd]]
    second[rows[odd], b[odd]] += turn[rows[odd], b[odd]]
    even = ~odd
    for c in (a, b):
        second[rows[even], c[even]] += turn[rows[even], c[even]]
    return first + shift, second + shift


def e8_points(y: np.ndarray) -> np.ndarray:
    """Four lattice points near each row of ``y``, nearest first: ``(rows, 4, 8)``.

    The first is the nearest point of E8, which is D8 and D8 + 1/2 together.
    """
    points = np.stack([*_coset(y, 0.0), *_coset(y, 0.5)], axis=1)
    away = ((points - y[:, None, :]) ** 2).sum(axis=2)
    return np.take_along_axis(points, np.argsort(away, axis=1, kind="stable")[:, :, None], axis=1)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """``(rows, tables, 1 + probes)`` cell numbers: home first, then the probes."""
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, unit.shape[1]])
        plane = rng.standard_normal((unit.shape[1], 8)) * scale
        factors = rng.integers(1, 1 << 62, 8) | 1
        doubled = np.rint(2 * e8_points(unit @ plane)[:, : 1 + probes]).astype(np.int64)
        out[:, t] = (doubled * factors).sum(axis=2) + t
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one.  A power of two brings the largest component near one first, so that no square overflows or vanishes."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cells_of(embeddings: pa.Array) -> pa.Array:
    out: list = [None] * len(embeddings)
    rows = [e.values.to_numpy(zero_copy_only=False).astype(np.float64) for e in embeddings]
    for dim in {len(r) for r in rows}:
        at = [i for i, r in enumerate(rows) if len(r) == dim]
        found = cells(_unit(np.array([rows[i] for i in at])))
        for i, c in zip(at, found.reshape(len(at), -1), strict=True):
            out[i] = c
    return pa.array(out, pa.list_(pa.int64()))


def _least_connected(link: np.ndarray) -> np.ndarray:
    """For each member the least position it hangs together with."""
    at = np.arange(len(link))
    while True:
        moved = np.minimum(at, np.where(link, at[None, :], len(link)).min(axis=1))
        moved = moved[moved]
        if (moved == at).all():
            return at
        at = moved


def _first_here(c: np.ndarray, nid: np.ndarray, i: np.ndarray, j: np.ndarray, t: int, cell: int) -> np.ndarray:
    """Whether cell ``cell`` of table ``t`` is the first place where i and j meet."""
    home_i, home_j = c[i, :, 0], c[j, :, 0]
    same = home_i == home_j
    j_probes = (c[j, :, 1:] == home_i[:, :, None]).any(axis=2)
    i_probes = (c[i, :, 1:] == home_j[:, :, None]).any(axis=2)
    first = (same | j_probes | i_probes).argmax(axis=1) == t
    # Each may probe the other's home; then the smaller one's home counts.
    twice = ~same[:, t] & j_probes[:, t] & i_probes[:, t]
    at_smaller = np.where(nid[i] < nid[j], home_i[:, t], home_j[:, t]) == cell
    return first & (~twice | at_smaller)


def _links_in(unit: np.ndarray, home: np.ndarray, side: np.ndarray | None, c: np.ndarray, nid: np.ndarray, copies: np.ndarray, t: int, cell: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member of one group: links counted here, and the least node it hangs together with."""
    link = (unit @ unit.T >= cosine) & (home[:, None] | home[None, :])
    np.fill_diagonal(link, False)
    if side is not None:
        link &= side[:, None] != side[None, :]
    n = np.zeros(len(unit), np.int64)
    root = nid
    if link.any():
        order = np.argsort(nid, kind="stable")
        least = _least_connected(link[np.ix_(order, order)])
        root = np.empty_like(nid)
        root[order] = nid[order][least]
        i, j = np.nonzero(np.triu(link))
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            first = _first_here(c, nid, a, b, t, cell)
            np.add.at(n, a[first], copies[b[first]])
            np.add.at(n, b[first], copies[a[first]])
    return n, root


def _groups(table: pa.Table, cosine: float) -> pa.Table:
    """All cells that one task holds together: ``nid, n, root`` where there is a link."""
    order = sorted(range(table.num_rows), key=list(zip(table["t"].to_pylist(), table["cell"].to_pylist(), table["label"].to_pylist(), table["dim"].to_pylist(), strict=True)).__getitem__)
    table = table.take(pa.array(order, pa.int64())).combine_chunks()
    key = [table[c].to_pylist() for c in ("t", "cell", "label", "dim")]
    nid, copies = table["nid"].to_numpy(), table["copies"].to_numpy()
    home, i, j, b = (table[c].to_numpy() for c in ("home", "i", "j", "b"))
    home = home.astype(bool)
    c = table["cells"].combine_chunks().flatten().to_numpy().reshape(len(nid), -1, 1 + PROBES)
    flat = table["embedding"].combine_chunks()
    starts = flat.offsets.to_numpy() - flat.offsets[0].as_py()
    values = flat.flatten().to_numpy().astype(np.float64)
    ends = [k for k in range(1, len(nid) + 1) if k == len(nid) or any(x[k] != x[k - 1] for x in key)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    for end in ends:
        if end - at > 1:
            s = slice(at, end)
            unit = _unit(values[starts[at] : starts[end]].reshape(end - at, key[3][at]))
            n, root = _links_in(unit, home[s], b[s] if i[at] != j[at] else None, c[s], nid[s], copies[s], key[0][at], key[1][at], cosine)
            hit = (n > 0) | (root != nid[s])
            out.append((nid[s][hit], n[hit], root[hit]))
        at = end
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
    return pa.table([pa.array(x, pa.int64()) for x in columns], names=["nid", "n", "root"])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``vectors``.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; rows are compared
    only within a label that is not null, and between vectors of one length.
    Vectors that are null, empty or zero, that hold null or non-finite
    components, or whose label is null link with nothing: they have no links and
    are their own component.  Equal vectors link with each other and share all
    links.  A null id counts as a link of others and never names a component
    unless all its ids are null.  Components of any size count: none overflows.
    Other columns, whatever their names, are left out.  No rows give no rows.
    """
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), e.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("label").isNotNull() & F.coalesce(F.when(finite, F.exists("embedding", lambda x: x != 0)), F.lit(False))
    # Equal vectors of a label share 128 bits of hash, which stand for them in the last join.
    name = [F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit(SEED), "label", "embedding").alias("g")]
    fit = rows.where(sound)
    nodes = fit.select("*", *name).groupBy("h", "g").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("node"), F.count("*").alias("copies")
    )
    nodes = nodes.withColumn("cells", F.arrow_udf(_cells_of, "array<long>")("embedding")).withColumn("dim", F.size("embedding"))
    nodes = save(nodes.withColumn("nid", F.monotonically_increasing_id()), "vectors")

    dealt = nodes.select("nid", "label", "dim", F.posexplode("cells").alias("slot", "cell"))
    dealt = dealt.selectExpr("nid", "label", "dim", f"slot div {1 + PROBES} as t", f"cast(slot % {1 + PROBES} = 0 as int) as home", "cell")
    where = ["label", "dim", "t", "cell"]
    met = dealt.groupBy(*where).agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any = 1").drop("any")
    met = save(met, "met")  # the join reads plain shuffles, so that a large cell can be split among tasks
    parts = F.ceil(F.col("n") / block).cast("int")
    placed = dealt.join(met, where).withColumn("parts", parts).withColumn("b", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j")))
    placed = placed.withColumn("p", F.explode(pairs)).select("*", "p.i", "p.j")
    # Small cells share a task's group; a pair of blocks of a large cell is one by itself.
    bins = F.lit(max(1, nodes.count() * TABLES // block))
    bin_ = F.when(F.col("parts") == 1, F.pmod(F.xxhash64(*where), bins)).otherwise(F.xxhash64(*where, "i", "j").bitwiseOR(F.lit(-(1 << 63))))
    placed = placed.withColumn("bin", bin_).select("bin", "nid", "label", "dim", "t", "home", "cell", "b", "i", "j")
    full = placed.join(nodes.select("nid", "copies", "embedding", "cells"), "nid")
    found = save(full.groupBy("bin").applyInArrow(lambda t: _groups(t, cosine), LINKS), "found")

    counts = found.groupBy("nid").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("nid <> root").select("nid", "root"), "nid", "root")
    named = nodes.join(counts, "nid", "left").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    named = named.select("h", "g", "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "nid").alias("root"))
    named = save(named, "named")
    discard(nodes, met, found)
    heads = named.groupBy("root").agg(F.min("node").alias("component_id"))
    named = named.join(heads, "root").select("h", "g", "n_links", "component_id")
    linked = fit.select("vec_id", *name).join(named, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
