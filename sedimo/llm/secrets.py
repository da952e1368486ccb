"""Secret scans: patterns, and windows of high Shannon entropy.

Three fixed patterns give the base spans.  The scan adds candidate strings
whose entropy, in windows that slide by one character, reaches the bound of
their character class.  The counts of a window change by one character in and
one out, so a string costs time in proportion to its length.  Windows that touch
a base span or something on the allow list are left out; the rest of their
candidate counts.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: The whole run is one match, so a run that is too short fails as a whole.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}", re.ASCII)
ASSIGN_VALUE = 6

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % WINDOW, re.ASCII)
#: Least bits a character of a window, by class.  A window of 20 has 4.32 bits at most.
BOUNDS = {"hex": 3.0, "alnum": 3.8, "base64": 3.9}
#: The same for windows without digits, which names written together resemble more.
LETTERS_BOUND = 4.0
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+\Z")
_ALNUM_ONLY = re.compile(r"[0-9A-Za-z]+\Z")
#: Parts of a candidate that are known not to be secret: placeholders, runs of the alphabet, identifiers with a public form.
ALLOWED = re.compile(
    r"example|sample|placeholder|changeme|dummy|xxxx+|0123456|abcdefg|lorem"
    r"|(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])",
    re.IGNORECASE,
)

#: A window holds one character more for a moment.
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def character_class(s: str) -> str:
    """The narrowest class that holds all characters of ``s``."""
    if _HEX_ONLY.match(s):
        return "hex"
    return "alnum" if _ALNUM_ONLY.match(s) else "base64"


def high_windows(s: str, bound: float, barred: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``s`` with at least ``bound`` bits a character that touch no span of the sorted ``barred``.

    A window also needs two letters and two digits: words have none, numbers no
    letters.  One without digits needs two letters of either case, and
    ``LETTERS_BOUND`` bits.
    """
    counts: dict[str, int] = {}
    kinds = {"digit": 0, "upper": 0, "lower": 0}
    terms = 0.0
    spans: list[tuple[int, int]] = []
    nth, free = 0, 0  # the next barred span, and where the last one that began has ended
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        terms += _TERM[k + 1] - _TERM[k]
        counts[c] = k + 1
        if kind := _kind(c):
            kinds[kind] += 1
        while nth < len(barred) and barred[nth][0] <= i:
            free = max(free, barred[nth][1])
            nth += 1
        if i >= WINDOW:
            out = s[i - WINDOW]
            k = counts[out]
            terms += _TERM[k - 1] - _TERM[k]
            counts[out] = k - 1
            if kind := _kind(out):
                kinds[kind] -= 1
        start = i - WINDOW + 1
        if start < free or start < 0:
            continue
        if kinds["digit"]:
            good, least = kinds["digit"] >= 2 and kinds["upper"] + kinds["lower"] >= 2, bound
        else:
            good, least = kinds["upper"] >= 2 and kinds["lower"] >= 2, max(bound, LETTERS_BOUND)
        if good and math.log2(WINDOW) - terms / WINDOW >= least - 1e-9:
            if spans and start <= spans[-1][1]:
                spans[-1] = spans[-1][0], i + 1
            else:
                spans.append((start, i + 1))
    return spans


def _kind(c: str) -> str | None:
    return "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that entropy adds; windows that touch a span of the sorted ``taken`` or an allowed part are left out."""
    found = []
    starts = [a for a, _, _ in taken]
    ends = list(accumulate((b for _, _, b in taken), max))
    for m in CANDIDATE.finditer(text):
        s, at, end = m.group(), m.start(), m.end()
        # Ends of the spans so far only grow, so those that reach the candidate are a slice.
        first, last = bisect.bisect_right(ends, at), bisect.bisect_left(starts, end)
        barred = [(max(a, at) - at, b - at) for a, _, b in taken[first:last] if b > at]
        barred += [x.span() for x in ALLOWED.finditer(s)]
        found += [(at + a, 3, at + b) for a, b in high_windows(s, BOUNDS[character_class(s)], sorted(barred))]
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end``, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts:
        text = t.as_py() or ""
        base = base_spans(text)
        kinds = [k for _, k, _ in base]
        spans = sorted(base + entropy_spans(text, base))
        rows.append((*map(kinds.count, range(3)), written(base), written(spans)))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64()] * 3 + [pa.string()] * 2
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["n_assign", "n_access", "n_hex", "base", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, spans)``, a row for each row of ``docs``.

    Spans are in code points of the whole text, ends exclusive.  A null text is
    empty and has none; repeated rows have equal spans; overlapping spans of
    different kinds all stay.  Texts of any length are read once, from end to
    end.  Other columns, whatever their names, are left out.  No rows give no
    rows.
    """
    found = F.arrow_udf(_scan, "n_assign long, n_access long, n_hex long, base string, spans string")
    return docs.select(F.col("doc_id").cast("long"), found(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")
