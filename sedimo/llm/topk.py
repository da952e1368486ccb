"""Exact top-k search by inner product, with pivot-table elimination.

Every vector keeps its distances to a set of pivots.  By the triangle inequality
a query and a candidate are at least ``max |d(q, p) - d(x, p)|`` apart, which
bounds their inner product from above.  Candidates are scored in the order of
that bound until it falls below the k-th best score: nothing further on can
enter the result, ties included.

Rows are cut into blocks by their nearest pivot, so a block's distances lie
close together.  A first pass scores every query against its own block; the
k-th best score there is a floor for the query.  The ranges of distances in a
block of queries and a block of candidates bound all their products at once, so
the second pass leaves out pairs of blocks that lie below the floors, and each
pair that is left is one bounded group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimo.llm.shared import discard, save

#: Pivots, chosen far apart among at most SAMPLE rows with the least hash.
PIVOTS = 32
SAMPLE = 1024
CANDIDATES = 4096
QUERIES = 2048
CHUNK = 256
TILE = 16
#: Cells whose numbers of rows are sent to all workers; a length of vectors has PIVOTS at most.
CELLS_SENT = 100_000
#: Parts into which the pairs of blocks are dealt.
SLOTS = 64
#: Share of the distances that a gap is lowered by, and of the squared lengths that a bound is raised by.  Sums of
#: a million squares are off by less.
SLACK = 1e-9
LEAST, MOST = -(1 << 63), (1 << 63) - 1

FOUND = "query_id long, query_key long, vec_id long, score long"
BLOCK, ASKED = ["dim", "cell", "part"], ["dim", "q_cell", "q_part"]


def quantised(x: Column, scale: int = 64) -> Column:
    """``floor(scale * component)`` of each component, or null where the vector is unfit."""
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(x.isNotNull() & finite, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def choose_pivots(sample: list[np.ndarray], count: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each pivot is the row farthest from those before it."""
    rows = np.array(sample, np.float64)
    chosen = [0]
    gap = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def bounds(dq: np.ndarray, dx: np.ndarray, qq: np.ndarray, xx: np.ndarray) -> np.ndarray:
    """An upper bound of every inner product: ``(queries, candidates)``.

    ``dx`` has a row for each pivot.  Each gap is lowered by what rounding can
    have added to it, which grows with the distances themselves, so a bound
    holds however far away a pivot is.
    """
    gap = np.zeros((len(dq), dx.shape[1]))
    off, allowed = np.empty_like(gap), np.empty_like(gap)
    for p in range(len(dx)):
        np.subtract(dx[p][None, :], dq[:, p][:, None], out=off)
        np.abs(off, out=off)
        np.add(dx[p][None, :], dq[:, p][:, None], out=allowed)
        allowed *= SLACK
        off -= allowed
        np.maximum(gap, off, out=gap)
    gap *= gap
    sums = qq[:, None] + xx[None, :]
    return (sums - gap) / 2 + SLACK * (1 + sums)


def scores_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, exact; beyond the range of a long the nearest long."""
    found = x @ q
    return found if found.dtype != object else np.array([min(max(s, LEAST), MOST) for s in found], np.int64)


def exact(v: np.ndarray) -> np.ndarray:
    """Whole numbers as the fastest type whose inner products are exact."""
    most = v.shape[1] * max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0)))) ** 2
    return v.astype(np.float64) if most < 1 << 52 else v if most < 1 << 62 else v.astype(object)


def best_in_block(q: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the block's k best for one query, ties to the smaller id, and how many were scored.

    Only scores from ``floor`` up count.  Candidates are scored in chunks of
    falling bound, each chunk twice the one before, until no bound reaches the
    k-th best score.
    """
    left = np.flatnonzero(bound >= floor)
    best, scores, size, scored = left[:0], scores_of(x[:0], q), CHUNK, 0
    while len(left):
        if len(left) > size:
            order = np.argpartition(-bound[left], size)
            chunk, left = left[order[:size]], left[order[size:]]
        else:
            chunk, left = left, left[:0]
        found = scores_of(x[chunk], q)
        scored += len(chunk)
        good = found >= floor
        best, scores = np.append(best, chunk[good]), np.append(scores, found[good])
        top = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[top], scores[top]
        if len(best) == k:
            floor = scores[-1]
            left = left[bound[left] >= floor]
        size *= 2
    return best, scores, scored


def _search(table: pa.Table, k: int) -> pa.Table:
    """The k best of one group: queries and candidates of one dimension."""
    dim = table["dim"][0].as_py()
    asks = table["is_query"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    ids = table["vec_id"].combine_chunks().to_numpy()
    keys = table["key"].combine_chunks().to_numpy()
    v = _matrix(table["v"], dim)
    d = _matrix(table["d"], len(table["d"][0]))
    floors = [-np.inf if f is None else f for f in table["floor"].to_pylist()]
    norms = (v.astype(np.float64) ** 2).sum(axis=1)
    v = exact(v)
    x, xid = v[~asks], ids[~asks]
    dx, xx = np.ascontiguousarray(d[~asks].T), norms[~asks]
    place: dict[tuple[int, int], int] = {}
    for at, name in enumerate(zip(xid.tolist(), keys[~asks].tolist(), strict=True)):
        place.setdefault(name, at)
    rows: list[tuple] = []
    queries = np.flatnonzero(asks)
    for t in range(0, len(queries), TILE):
        tile = queries[t : t + TILE]
        for i, bound in zip(tile.tolist(), bounds(d[tile], dx, norms[tile], xx), strict=True):
            name = int(ids[i]), int(keys[i])
            if name in place:
                bound[place[name]] = -np.inf  # the query's own row
            best, scores, _ = best_in_block(v[i], bound, x, xid, k, max(floors[i], LEAST))
            rows += zip([name[0]] * len(best), [name[1]] * len(best), xid[best].tolist(), map(int, scores), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "score"])


def _parts(per_block: int, seed: int) -> Column:
    """A block's part of its cell, of about ``per_block`` rows, decided by a hash of the row."""
    return F.pmod(F.xxhash64("vec_id", "key", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("n") / per_block)).cast("long"))


def _nearest(cells: int) -> Column:
    """The nearest of the first ``cells`` pivots."""
    near = F.slice("d", 1, max(1, min(PIVOTS, cells)))
    return F.array_position(near, F.array_min(near)).cast("int")


def _sized(rows: DataFrame, by: list[str]) -> DataFrame:
    """Add ``n``, the rows of each cell."""
    held = rows.groupBy(*by).agg(F.count("*").alias("n"))
    few = held.limit(CELLS_SENT + 1).count() <= CELLS_SENT  # else vectors have very many lengths
    return rows.join(F.broadcast(held) if few else held, by)


def _ranges(rows: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """For each block the least and greatest distance to each pivot and the greatest squared length."""
    one = [f(F.get("d", p)).alias(f"{prefix}_{f.__name__}{p}") for p in range(PIVOTS) for f in (F.min, F.max)]
    return rows.groupBy(*by).agg(F.max("length").alias(f"{prefix}_length"), F.min(F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))).alias(f"{prefix}_floor"), *one)


def _pairs(asks: DataFrame, pool: DataFrame) -> DataFrame:
    """The pairs of blocks in which some query may find a score from its floor up."""
    q = _ranges(asks, ASKED, "q").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    x = _ranges(pool, BLOCK, "x").withColumn("slot", F.pmod(F.xxhash64(*BLOCK), F.lit(SLOTS)).cast("int"))
    apart = [F.greatest(F.col(f"q_min{p}") - F.col(f"x_max{p}"), F.col(f"x_min{p}") - F.col(f"q_max{p}")) - SLACK * (F.col(f"q_max{p}") + F.col(f"x_max{p}")) for p in range(PIVOTS)]
    gap = F.greatest(F.lit(0.0), *apart)  # a pivot that a dimension lacks is null, and left out
    lengths = F.col("q_length") + F.col("x_length")
    reach = (lengths - gap * gap) / 2 + SLACK * (1 + lengths)
    return q.join(x, ["dim", "slot"]).where(reach >= F.col("q_floor")).select(*ASKED, "cell", "part")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for every row that ``is_query`` marks.

    ``vectors`` has ``vec_id`` and ``embedding``; its other columns play no part,
    but ``is_query`` may use them.  A row is not its own candidate; equal copies
    of it with other rows are.  Only vectors of one length are compared.  Rows
    with a null id, and null vectors or ones with null or non-finite components,
    take no part.  A component or score beyond the range of a long counts as the
    nearest long.  A query row that is repeated is answered once; with fewer
    than k other rows, all are returned; without rows the result is empty.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("v"), is_query.alias("is_query"))
    rows = rows.where("vec_id is not null and v is not null").withColumn("dim", F.size("v")).withColumn("key", F.xxhash64("v"))
    seen = rows.orderBy(F.xxhash64("vec_id", "key"), "vec_id", "key").limit(SAMPLE).select("dim", "v").collect()
    pivots = {dim: choose_pivots([np.array(r.v) for r in seen if r.dim == dim]) for dim in {r.dim for r in seen}}

    def distances(vs: pa.Array) -> pa.Array:
        out = []
        for v in vs:
            a = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            p = pivots.get(len(a))
            out.append([0.0] if p is None else np.sqrt(((p - a) ** 2).sum(axis=1)))
        return pa.array(out, pa.list_(pa.float64()))

    rows = rows.withColumn("d", F.arrow_udf(distances, "array<double>")("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    # No more cells than blocks of candidates, or of queries, so that blocks aren't small.
    count, asking = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    rows = rows.withColumn("cell", _nearest(-(-count // candidates))).withColumn("q_cell", _nearest(-(-asking // queries)))
    rows = save(rows.withColumn("length", square), "pivot-table")
    rows = _sized(rows, ["dim", "cell"]).withColumn("part", _parts(candidates, 1))
    asks = rows.where("is_query").drop("n").dropDuplicates(["vec_id", "key"])
    floor = F.lit(None).cast("long")
    pool = rows.drop("q_cell").withColumn("is_query", F.lit(False)).withColumn("floor", floor)
    group = ["vec_id", "key", "v", "d", "is_query", "floor", *BLOCK]

    own = pool.select(group).unionByName(asks.withColumn("floor", floor).select(group))
    seeds = own.groupBy(*BLOCK).applyInArrow(lambda t: _search(t, k), FOUND).groupBy("query_id", "query_key")
    floors = seeds.agg(F.min("score").alias("floor"), F.count("*").alias("found")).where(F.col("found") >= k)
    floors = floors.select(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key"), "floor")
    asks = asks.join(floors, ["vec_id", "key"], "left").drop("cell", "part")
    asks = save(_sized(asks, ["dim", "q_cell"]).withColumn("q_part", _parts(queries, 2)), "asks")

    pairs = save(_pairs(asks, pool), "block-pairs")
    both = [*group, "q_cell", "q_part"]
    met = pool.join(pairs, BLOCK).select(both).unionByName(asks.join(pairs, ASKED).select(both))
    found = save(met.groupBy(*ASKED, "cell", "part").applyInArrow(lambda t: _search(t, k), FOUND), "found")
    discard(rows, asks, pairs)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
