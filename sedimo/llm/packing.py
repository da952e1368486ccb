"""Packing token sequences into fixed windows, best fit decreasing.

A document longer than the window is first cut into full windows, each a
sequence by itself.  What is left of every document is sorted by falling length
and put into the open window with the least room that still holds it; a segment
tree over remaining capacity finds that window in a few steps.
"""

from __future__ import annotations

import base64
import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimo.llm.shared import save

WINDOW = 2048
END_ID = 1
#: Pieces that one task packs; a block's last open windows are all that a larger block could fill better.
BLOCK = 1 << 16
LOCAL_BITS = 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Characters on which the two tokenizer libraries are tested to split alike.
_TESTED = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")


class Encoder:
    """Token ids of a text as the JSON vocabulary gives them.

    The rank file holds the same vocabulary for a library several times faster;
    it serves texts of tested characters without a special token's string.  All
    other texts go to the JSON vocabulary's own library.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if _TESTED.search(text) or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary, ranks, pattern)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree.

    Leaf c says whether a window with c free places is open; an inner node says
    so for its range.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.with_room: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, room: int, on: int) -> None:
        i = room + self.leaves
        self.any[i] = on
        while i > 1:
            i >>= 1
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                return
            self.any[i] = now

    def add(self, number: int, room: int) -> None:
        if not self.with_room[room]:
            self._mark(room, 1)
        self.with_room[room].append(number)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the fullest window with room for ``need``: its number and room."""
        i = need + self.leaves
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        number = self.with_room[room].pop()
        if not self.with_room[room]:
            self._mark(room, 0)
        return number, room


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """The window number and offset of each length, and the number of windows."""
    which, where = [0] * len(lengths), [0] * len(lengths)
    opened, windows = 0, OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = windows.take(lengths[i])
        if found is None:
            found = opened, window
            opened += 1
        number, room = found
        which[i], where[i] = number, window - room
        if room > lengths[i]:
            windows.add(number, room - lengths[i])
    return which, where, opened


def tokenize(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Cut every document's ids and ``end_id`` into pieces of at most ``window``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, window: int = WINDOW, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``.

    The pieces are dealt evenly, whatever their keys, into blocks of about
    ``block`` rows, and each block is packed in one task.  A sequence's number
    holds the block above ``LOCAL_BITS`` bits, so numbers are unique but not
    gapless.  A null or empty text is its end id alone; a long one is cut into
    full windows, from its whole ids; repeated rows are packed each.  Other
    columns, whatever their names, are left out.  No rows give no sequences.
    """
    pieces = save(tokenize(docs, vocabulary, ranks, pattern, window, end_id), "pieces")
    blocks = max(1, math.ceil(pieces.count() / block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << LOCAL_BITS
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        order = sorted(zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        lengths = [r[2] for r in order]
        which, where, _ = best_fit_decreasing(lengths, window)
        columns = [*zip(*order, strict=True), [base + w for w in which], where]
        names = [*table.column_names, "sequence_id", "offset"]
        whole = pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)
        yield from whole.to_batches(max_chunksize=10_000)

    return pieces.repartition(blocks).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
