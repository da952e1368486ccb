"""Substring dedup by suffix automata over shards of reference passages.

A window is a run of ``window`` words of one document.  Each window names its
anchor, the word group inside it with the least hash; neighbouring windows share
one, and form a passage.  Equal windows have equal anchors at equal places, so
a window can repeat only where its anchor does.

1. Anchors that occur once in the corpus are done with.
2. A passage whose words all occurred in an earlier passage of its anchor is
   removed at once; of equal passages the first stays a candidate.
3. Candidates of one anchor that differ may still share windows.  They are dealt
   into shards of bounded size.  A shard's task streams them in document order
   through a suffix automaton of those before: where the matching statistic
   reaches the window's length, that window occurred earlier.

An automaton over all references would grow with the corpus and could not be
broadcast; the shards bring each passage to the only automaton it can match.
An anchor with very many candidates would fill a shard by itself; its windows
are compared by their hashes instead, each with the first of its kind, so no
task holds all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimo.llm.shared import discard, save

WINDOW = 20
#: Words of an anchor.
GROUP = 8
#: Candidates of an anchor above which its windows are compared one by one; the results are the same.
HOT = 512
#: Words that the automaton of a shard holds, about.
SHARD_WORDS = 100_000
LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int | np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, words parted by ASCII white space and unchanged."""
    words = text.encode().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def passages(h: np.ndarray, window: int, group: int) -> tuple[np.ndarray, ...]:
    """``anchor, content, start, count`` of each run of windows with one anchor.

    ``content`` is a hash of the run's words and the anchor's place in them.
    """
    n = len(h)
    if n < window:
        return (np.empty(0, np.int64),) * 4
    g = np.zeros(n - group + 1, np.uint64)
    for j in range(group):
        g = g * np.uint64(_BASE) + h[j : n - group + 1 + j]
    g = (g ^ (g >> np.uint64(31))) * _SPREAD
    g ^= g >> np.uint64(29)
    m = n - window + 1
    at = np.arange(m) + np.lib.stride_tricks.sliding_window_view(g, window - group + 1).argmin(axis=1)
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    end = np.append(start[1:], m)
    power, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
    sums = np.append(np.uint64(0), np.cumsum(h * power[:-1]))
    content = (sums[end - 1 + window] - sums[start]) * inverse[start]
    content = (content ^ (content >> np.uint64(32))) + (at[start] - start).astype(np.uint64) * _SPREAD + (end - start).astype(np.uint64)
    anchor = g[at[start]]
    return anchor.view(np.int64), content.view(np.int64), start, end - start


class SuffixAutomaton:
    """All substrings of the token sequences added so far."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def matches(self, tokens: list[int]) -> list[int]:
        """For each token, the longest substring known that ends there."""
        state = size = 0
        out = []
        for t in tokens:
            while state and t not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if t in self.step[state]:
                state = self.step[state][t]
                size += 1
            out.append(size)
        return out

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        """The state for exactly p's longest string and t, taken out of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.step[p].get(t) == q:
            self.step[p][t] = own
            p = self.link[p]
        return own

    def add(self, tokens: list[int]) -> None:
        last = 0
        for t in tokens:
            if t in self.step[last]:
                last = self._split(last, t, self.step[last][t])
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and t not in self.step[p]:
                self.step[p][t] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, t, self.step[p][t])
            last = new


def _runs(hits: list[int]) -> Iterator[tuple[int, int]]:
    """``(first, count)`` of each run of consecutive numbers."""
    at = 0
    for i in range(1, len(hits) + 1):
        if i == len(hits) or hits[i] != hits[i - 1] + 1:
            yield hits[at], i - at
            at = i


def _match_shard(table: pa.Table, window: int) -> pa.Table:
    """The windows of a shard's passages that an earlier passage holds."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("ord", "start", "key", "words")), strict=True), key=lambda r: r[:3])
    seen = SuffixAutomaton()
    out: list[tuple[int, int, int, int]] = []
    before = None
    for doc, start, key, words in rows:
        if before == (doc, start, key):
            continue  # a repeated row is not earlier than itself
        before = doc, start, key
        hits = [i + 1 - window for i, n in enumerate(seen.matches(words)) if n >= window]
        out += [(doc, key, start + first, count) for first, count in _runs(hits)]
        if len(hits) < len(words) - window + 1:
            seen.add(words)
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["ord", "key", "start", "count"])


def _kept(texts: pa.Array, removed: pa.Array, window: int) -> pa.Array:
    rows = []
    for text, spans in zip(texts, removed, strict=True):
        words = (text.as_py() or "").encode().split()
        n = len(words)
        kept = words
        if spans.is_valid:
            edge = np.zeros(n + 1, np.int64)
            for s in spans.as_py():
                edge[s["start"]] += 1
                edge[s["start"] + s["count"] - 1 + window] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            kept = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
        rows.append({"text": b" ".join(kept).decode(), "n_words": n, "n_removed": n - len(kept)})
    return pa.array(rows, pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, text, n_words, n_removed)``, a row for each row of ``docs``.

    Words covered by a window whose words also start earlier, in a smaller
    doc_id or before it in the same document, are gone from ``text``; the others
    are joined by one space.  Windows are judged on the input.  Null ids come
    after all others.  Rows that share an id, a null one too, count as one
    document: what starts later in one of them repeats what starts earlier in
    another, and equal rows lose the same words.  Null, empty and short texts have no windows and lose
    nothing.  Very long texts are read whole; a text's words and passages are
    held by one task.  Other columns, whatever their names, are left out.  No
    rows give no rows.
    """
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("key")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for batch in batches:
            found = [passages(word_hashes(t.as_py()), window, group) for t in batch.column(2)]
            lists = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["ord", "key", "anchor", "content", "start", "count"])

    lists = "ord long, key long, anchor array<long>, content array<long>, start array<int>, count array<int>"
    # A row's number stands for its key while passages are shuffled, as numbers of one task compress well.
    cuts = save(base.select("ord", "key", "text").mapInArrow(cut, lists).withColumn("row", F.monotonically_increasing_id()), "passages")
    names = save(cuts.select("row", "ord", "key"), "names")
    anchors = cuts.select(F.explode("anchor").alias("anchor"))
    repeated = save(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")
    each = cuts.select("row", "ord", F.explode(F.arrays_zip("anchor", "content", "start", "count")).alias("p")).select("row", "ord", "p.*")
    met = save(each.join(repeated, "anchor", "left_semi"), "shared")
    discard(cuts, repeated)

    # Tables between the joins, so that a join reads plain shuffles and a hot key's rows can be split among tasks.
    firsts = save(met.groupBy("anchor", "content").agg(F.min(F.struct("ord", "start")).alias("first")), "firsts")
    judged = met.join(firsts, ["anchor", "content"]).withColumn("later", F.struct("ord", "start") > F.col("first"))
    judged = save(judged.select("row", "anchor", "start", "count", "later"), "judged")
    discard(met)
    several = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > hot).alias("hot"))
    rest = save(judged.where("not later").join(several, "anchor").select("row", "anchor", "start", "count", "hot"), "candidates")
    discard(firsts)
    asked = rest.join(names, "row").groupBy("ord", "key").agg(F.collect_set(F.struct("start", "count", "anchor", "hot")).alias("asked"))
    shards = max(1, math.ceil(rest.count() * (window + 6) / shard_words))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, key, text, wanted in zip(*batch.columns, strict=True):
                h = word_hashes(text.as_py())
                for w in wanted.as_py():
                    start, count = w["start"], w["count"]
                    if not w["hot"]:
                        rows.append((w["anchor"] % shards, doc.as_py(), key.as_py(), start, h[start : start + count - 1 + window].view(np.int64)))
                        continue
                    for s in range(start, start + count):
                        own = xxhash.xxh3_64_intdigest(h[s : s + window].tobytes())
                        rows.append((None, doc.as_py(), key.as_py(), s, np.array([own], np.uint64).view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(list(c), pa.int64()) for c in columns[:4]]
            arrays.append(pa.array(columns[4], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "ord", "key", "start", "words"])

    sent = base.select("ord", "key", "text").join(asked, ["ord", "key"]).mapInArrow(words_of, "shard long, ord long, key long, start long, words array<long>")
    sent = save(sent, "sent")
    discard(rest)
    matched = sent.where("shard is not null").groupBy("shard").applyInArrow(lambda t: _match_shard(t, window), "ord long, key long, start long, count long")
    matched = save(matched, "matched")
    single = sent.where("shard is null").select("ord", "key", "start", F.get("words", 0).alias("word"))
    earliest = save(single.groupBy("word").agg(F.min(F.struct("ord", "start")).alias("at")), "earliest")
    repeats = single.join(earliest, "word").where(F.struct("ord", "start") > F.col("at")).select("ord", "key", "start", F.lit(1).cast("long").alias("count"))

    spans = judged.where("later").join(names, "row").select("ord", "key", F.col("start").cast("long"), F.col("count").cast("long"))
    spans = spans.unionByName(matched).unionByName(repeats)
    removed = save(spans.groupBy("ord", "key").agg(F.collect_set(F.struct("start", "count")).alias("removed")), "removed")
    discard(judged, names, sent, matched, earliest)
    kept = F.arrow_udf(lambda t, r: _kept(t, r, window), "text string, n_words long, n_removed long")
    out = base.join(removed, ["ord", "key"], "left").select("doc_id", kept("text", "removed").alias("k"))
    return out.select("doc_id", "k.text", "k.n_words", "k.n_removed")
