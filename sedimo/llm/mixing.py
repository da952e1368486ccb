"""Mixing sources to target weights, in DataFrame operations only.

The mix is cut into equal blocks of words.  Sainte-Laguë apportionment deals
them to the sources by highest quotients of their targets, then each source's
blocks to its shards by highest quotients of their sizes, so every quota is an
integer.  Within a shard the documents stand in a seeded order; full rounds of
the shard come first, the rest is the leading blocks of that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimo.llm.shared import save

WEIGHTS = (5, 2, 1)
#: A document, and so a source, is taken this many times at most.
REPEATS = 3
#: A mix has about this many blocks, of at most ``LARGEST`` words each.
BLOCKS = 1_000_000
LARGEST = 2048
#: Documents of a shard, within which one task orders them.
SHARD = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _div(x: Column | str, y: Column) -> Column:
    return F.call_function("div", F.col(x) if isinstance(x, str) else x, y)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Add ``position``, ``weight`` and ``target`` to ``(source, source_size, n_docs)``.

    Targets share all words by weight, each at most ``repeats`` times its
    source's size.  The excess is reshared until none is above: with a level L
    every target is ``min(weight * L, cap)``, and L is the first, in the order
    of cap per weight, that the next source's own cap allows.  There is one row
    for each source here, so these windows sort a summary, not the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("position"), F.lit(len(weights))).cast("int") + 1)
    s = sources.withColumn("position", position).withColumn("weight", weight.cast("long"))
    s = s.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", "position")
    done, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(done), F.lit(0))
    s = s.withColumn("level", rest.cast("double") / F.sum("weight").over(left))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "position", "level"))).over(everything)["level"])
    target = F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))
    return s.withColumn("target", F.coalesce(target, F.col("cap").cast("double"))).drop("cap", "ratio", "level")


def apportion(rows: DataFrame, group: list[str], position: str, claim: str, seats: str) -> DataFrame:
    """Add ``quota``: the ``seats`` of each group by Sainte-Laguë over ``claim``.

    Seat k of a row has the quotient ``claim / (2k + 1)``; the highest win, ties
    by ``position``.  All n quotas of a group lie within ``share * n / 2 + 1`` of
    their exact shares: at the divisor of exact shares, rounding is off by n / 2
    seats in all at most, and undoing that moves a row by its share of them.  So
    the seats below that range are granted, and only those in it, about 5n, are
    ranked.
    """
    whole = Window.partitionBy(*group)
    total = F.sum(F.col(claim).cast("double")).over(whole)
    share = F.when(total > 0, F.col(claim) / total).otherwise(F.lit(0.0))
    n = F.count("*").over(whole)
    s = rows.withColumn("_share", share).withColumn("_reach", (F.ceil(F.col("_share") * n / 2) + 2).cast("long"))
    s = s.withColumn("_low", F.greatest(F.lit(0).cast("long"), F.floor(F.col("_share") * F.col(seats)).cast("long") - F.col("_reach")))
    s = s.withColumn("_high", F.floor(F.col("_share") * F.col(seats)).cast("long") + F.col("_reach"))
    s = s.withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    names = [c for c in s.columns if c not in ("_share", "_reach", "_high")]
    k = s.select(*names, F.explode(F.sequence(F.col("_low"), F.col("_high"))).alias("_k"))
    best = Window.partitionBy(*group).orderBy((F.col(claim) / (2 * F.col("_k") + 1)).desc(), position, "_k")
    won = ((F.row_number().over(best) <= F.col("_open")) & (F.col(claim) > 0)).cast("long")
    ranked = k.withColumn("_won", won)
    key = [c for c in names if c not in ("_open", "_low")]
    return ranked.groupBy(*key).agg((F.first("_low") + F.sum("_won")).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED, shard_docs: int = SHARD) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, a row for each row of ``docs``.

    A null source is one source, placed last; a null or blank text has size 0
    and gives no words.  ``taken`` is at most ``repeats`` times the size; the
    document at the end of a quota may be taken in part.  Equal rows stand next
    to each other in the seeded order, which is the same in every run.  No rows
    give no rows.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = save(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size")), "sized")
    summary = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy()
    block = F.greatest(F.lit(1).cast("long"), F.least(F.lit(LARGEST).cast("long"), _div("total", F.lit(BLOCKS))))
    s = targets(summary, weights, repeats).withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("block", block).withColumn("seats", _div("total", F.col("block")))
    s = apportion(s.withColumn("all", F.lit(0)), ["all"], "position", "target", "seats")
    s = save(
        s.select(
            "source", "position", "source_size", "target", "block", F.col("quota").alias("blocks"),
            F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_docs") / shard_docs)).alias("shards"),
        ),
        "sources",
    )
    # The order and the shard come from one seeded digest of the id.
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = sized.withColumn("turn", digest).join(s.select(F.col("source").alias("name"), "position", "shards"), F.col("source").eqNullSafe(F.col("name")))
    part = F.pmod(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long"), F.col("shards"))
    keyed = keyed.select("doc_id", "size", "turn", "position", part.alias("shard"))
    parts = keyed.groupBy("position", "shard").agg(F.sum("size").alias("shard_size"))
    q = apportion(parts.join(s.select("position", "blocks"), "position"), ["position"], "shard", "shard_size", "blocks")
    q = q.join(s.drop("blocks", "shards"), "position")
    words = F.least(F.col("quota") * F.col("block"), F.col("shard_size") * repeats)
    q = q.select("position", "shard", "source", "source_size", "target", "shard_size", words.alias("words"))
    run = Window.partitionBy("position", "shard").orderBy("turn", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rounds = F.when(F.col("shard_size") > 0, _div("words", F.greatest(F.col("shard_size"), F.lit(1).cast("long")))).otherwise(F.lit(0).cast("long"))
    out = keyed.join(q, ["position", "shard"]).withColumn("end", F.sum("size").over(run)).withColumn("rounds", rounds)
    rest = F.col("words") - F.col("rounds") * F.col("shard_size")
    more = F.least(F.col("end"), rest) - F.least(F.col("end") - F.col("size"), rest)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + more).alias("taken"))


def mixed_texts(docs: DataFrame, columns: list[str], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The rows of the mix itself, with ``columns``, which hold ``doc_id``, ``source`` and ``text``.

    A document taken in full stands there once for each round, with its text as
    it is, and a part is its first words, joined by one space; ``n_chars``, where
    asked for, follows the text.  Documents of which nothing is taken are gone,
    as are null and blank texts, which have no words.  Repeated rows share out
    what :func:`mix` takes of them.  Other columns come along unchanged,
    whatever their names; no rows give no rows.
    """
    taken = mix(docs, weights, repeats, seed).where("taken > 0")
    # A repeated doc_id shares its takings out by size and source, which decide a row's place.
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.struct(*[c for c in columns if c != "text"])
    left = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("from"), size.alias("words"), F.col("text").cast("string").alias("t"), row.alias("row"))
    left = left.withColumn("nth", F.row_number().over(Window.partitionBy("id", "from", "words").orderBy("t")))
    right = taken.select(F.col("doc_id").alias("i"), F.col("source").alias("f"), F.col("size").alias("w"), "taken")
    right = right.withColumn("n", F.row_number().over(Window.partitionBy("i", "f", "w").orderBy(F.desc("taken"))))
    met = left.join(right, F.col("id").eqNullSafe(F.col("i")) & F.col("from").eqNullSafe(F.col("f")) & (F.col("words") == F.col("w")) & (F.col("nth") == F.col("n")))
    full, part = _div("taken", F.col("words")), F.pmod(F.col("taken"), F.col("words"))
    first = F.array_join(F.slice(F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, part.cast("int")), " ")
    pieces = F.concat(F.array_repeat(F.col("t"), full.cast("int")), F.when(part > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    out = met.select("row", F.explode(pieces).alias("piece"))
    new = {"text": F.col("piece"), "n_chars": F.length("piece").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])
