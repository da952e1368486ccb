"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimo.llm.shared import discard, save


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    out = save(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
    discard(least)
    return out


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = save(e.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = save(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    discard(least)
    return out


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Every child has one parent and no parent is a child."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Return ``(node, root)`` for every node of ``links`` that is not a root.

    ``root`` is the least node of the component.  Alternating large-star and
    small-star rounds shrink all links to stars, in a number of rounds that grows
    with the logarithm of the nodes; each round is a few shuffles of
    the links and is written to the shared folder.  The least neighbours
    are tables of their own, so that a join reads plain shuffles and a hub's
    links can be split among tasks.  Null ends and self-links are ignored.
    """
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        f"{a} is not null and {b} is not null and {a} <> {b}"
    )
    e = save(e.distinct(), "links")
    while not _is_forest_of_stars(e):
        large = _large_star(e)
        small = _small_star(large)
        discard(e, large)
        e = small
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
