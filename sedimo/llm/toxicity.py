"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct words, pairs of neighbours and pairs with one word
between, hashed into ``2**BITS`` places.  Every coordinate has its own learning
rate, and the L1 term leaves most weights at exactly zero, so what is broadcast
for scoring is a short list of places and weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimo.llm.shared import discard, save

BITS = 20
#: Labelled rows that the model is fitted on, at most; which ones is decided by a hash of the id.
TRAINING_ROWS = 16_000
#: Features of all those rows together, at most; rows from where it is passed are left out of the fitting, the scores are of all.
TRAINING_FEATURES = 1 << 26
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
#: What an error on label 1 weighs, as that label is the rarer one.
POSITIVE = 3.0
FOLDS = 5
#: Place of the constant feature, after the hashed ones.
BIAS = 1 << BITS
#: The model without any training rows.
UNTAUGHT = {BIAS: -10.0}

_PAIR, _SKIP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: ASCII letters stay, in lower case, as do digits and all other alphabets' bytes; the rest parts words.
_PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def features(text: str | None) -> np.ndarray:
    """The sorted, distinct places of a whole text's features and the constant."""
    words = text.encode().translate(_PARTS).split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    every = np.concatenate([h, (h[:-1] * _PAIR + h[1:]) * _SPREAD, (h[:-2] * _SKIP + h[2:]) * _SPREAD])
    return np.append(np.unique((every >> np.uint64(64 - BITS)).astype(np.int32)), np.int32(BIAS))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _probability(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> dict[int, float]:
    """The non-zero weights after ``epochs`` passes in the given order.

    Without any rows the constant alone has a weight, so that every score is
    close to 0.
    """
    if not rows:
        return dict(UNTAUGHT)
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    for _ in range(epochs):
        for x, label in rows:
            zx, nx = z[x], n[x]
            w = _weights(zx, nx)
            g = (_probability(w.sum()) - label) * (POSITIVE if label else 1.0)
            step = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - step * w
            n[x] = nx + g * g
    w = _weights(z, n)
    return {int(i): float(w[i]) for i in np.flatnonzero(w)}


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from the fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> dict[int, float]:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    The labels chosen are those with the least hash of their id; at most
    ``rows`` of them are broadcast to the scan of ``docs``.  Features are made
    where the texts are, and one task fits what comes out, ``TRAINING_FEATURES``
    at most, in an order that only ids and features decide, so reruns agree.
    Rows without a label or an id are not used; of several labels of one id the
    larger counts; of several documents, each row.  The model that comes back
    has at most ``2**BITS + 1`` weights.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = save(known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(rows), "labels")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    places = F.arrow_udf(lambda texts: pa.array([features(t.as_py()) for t in texts], pa.list_(pa.int32())), "array<int>")("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            for x, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                held += len(x)
                if held <= TRAINING_FEATURES:
                    found.append((x.values.to_numpy(), y))
        w = fit(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.int32()), pa.array(list(w.values()), pa.float64())], ["place", "weight"])

    ordered = texts.select("label", "turn", "doc_id", places.alias("places")).orderBy("turn", "doc_id", "places").limit(2 * rows).select("places", "label")
    fitted = ordered.coalesce(1).mapInArrow(run, "place int, weight double").collect()
    discard(chosen)
    return {r.place: r.weight for r in fitted} or dict(UNTAUGHT)


def scorer(docs: DataFrame, model: dict[int, float]):
    """A column function of the text: the probability of label 1, from the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((np.array(list(model), np.int32), np.array(list(model.values()))))

    def score(texts: pa.Array) -> pa.Array:
        places, weights = sent.value
        dense = np.zeros(BIAS + 1)
        dense[places] = weights
        return pa.array([_probability(dense[features(t.as_py())].sum()) for t in texts], pa.float64())

    return F.arrow_udf(score, "double")


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5) and ``held_out``.

    Null and empty texts get the score of the constant alone; repeated rows get
    equal scores; a text counts whole, whatever its length.  Columns of ``docs``
    with these names are replaced.  No rows give no rows.
    """
    by_text = scorer(docs, train(docs, labels, rows))
    out = docs.withColumn("score", by_text(F.col("text").cast("string")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model does not predict to be toxic, with all their columns.

    Null and empty texts have the score of the constant alone; repeated rows go
    or stay together; no rows give no rows.
    """
    by_text = scorer(docs, train(docs, labels, rows))
    return docs.where(by_text(F.col("text").cast("string")) < 0.5)
