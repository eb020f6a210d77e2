"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams of the words of a text are
hashed to ``BUCKETS`` learned vectors; their average goes through a softmax layer
(as in fastText's supervised mode). Training is stochastic gradient descent in
numpy on the driver over a sample of labelled documents. A score needs only each
bucket's share of the logit, so documents are scored with one table look-up a
feature.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .frames import arrow_map, held_out, raw_texts

BUCKETS = 1 << 15
GRAMS = (3, 5)
DIMENSIONS = 16
EPOCHS = 5
RATE = 0.3
SEED = 11
#: Labelled documents that training takes at most; which ones, a hash decides. Six
#: bytes for each of a document's distinct buckets reach the driver.
SAMPLE = 3000
THRESHOLD = 0.3


def counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for part in hashing.features(raw, BUCKETS, GRAMS):
        total += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def _sparse():
    def step(batch):
        found = [counts(raw) for raw in raw_texts(batch.column(1))]
        return batch.column(0), [a.astype(np.uint16).tobytes() for a, _ in found], [(c / max(c.sum(), 1)).astype(np.float32).tobytes() for _, c in found], batch.column(2)

    return step


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, y)``: at most ``sample`` labelled documents outside the
    held-out fifth, least hash first.

    The sampled labels are few by their limit and are broadcast; the texts of other
    documents aren't moved. Labels other than 0 and 1 and null ids are left out; an
    id labelled both ways counts as 0. Of rows that repeat an id, one counts: that
    of the least hash, chosen before the shuffle. A null text is as an empty one.
    """
    marks = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_id")))
    few = marks.groupBy("_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")


class Model:
    """``table``: each bucket's share of the logit; ``bias``: the rest."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, raw: bytes) -> float:
        total, n = 0.0, 0
        for part in hashing.features(raw, BUCKETS, GRAMS):
            total += float(self.table.take(part).sum(dtype=np.float64))
            n += len(part)
        return float(1 / (1 + np.exp(-(total / max(n, 1) + self.bias))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """``rows``: buckets, shares and label. No rows of either label: a model that
    gives the labels' mean, or 0.5 without any."""
    random = np.random.default_rng(SEED)
    mean = float(np.mean([y for _, _, y in rows])) if rows else 0.5
    vectors = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = (random.uniform(-1, 1, (DIMENSIONS, 2)) / DIMENSIONS).astype(np.float32)
    bias = np.log(np.clip([1 - mean, mean], 1e-3, 1)).astype(np.float32)
    if 0 < mean < 1:
        # Steps shrink with what a bucket has already moved (Adagrad), so that
        # rare buckets learn as well as those that every text has.
        moved = np.full(BUCKETS, 1e-8, np.float32)
        moved_out = np.full(out.shape, 1e-8, np.float32)
        for _ in range(EPOCHS):
            for i in random.permutation(len(rows)):
                at, share, y = rows[i]
                if not len(at):
                    continue
                hidden = share @ vectors[at]
                logits = hidden @ out + bias
                gap = np.exp(logits - logits.max())
                gap /= gap.sum()
                gap[y] -= 1
                back, step = out @ gap, np.outer(hidden, gap)
                moved_out += step**2
                out -= RATE * step / np.sqrt(moved_out)
                moved[at] += share**2 * float(back @ back)
                vectors[at] -= (RATE * share / np.sqrt(moved[at]))[:, None] * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``sample`` labelled documents; only their bucket shares
    reach the driver. Without usable labels every score is 0.5; with labels of one
    kind alone it is their mean."""
    rows = labelled(docs, labels, label, sample, doc_id, text)
    sparse = arrow_map(rows, {"doc_id": F.col("doc_id"), "text": F.col("text"), "y": F.col("y")}, _sparse, "doc_id long, at binary, share binary, y int").toArrow()
    # Views of the collected table, which isn't copied.
    got = [(np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(s.as_buffer(), np.float32), y.as_py()) for a, s, y in zip(sparse["at"], sparse["share"], sparse["y"], strict=True)]
    return train([got[i] for i in np.argsort(sparse["doc_id"].to_numpy(), kind="stable")])


def _scores(model: Model):
    def make():
        def step(batch):
            return batch.column(0), [model.score(raw) for raw in raw_texts(batch.column(1))]

        return step

    return make


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``, a row for each row, repeated rows alike; a null text is as
    an empty one, whose score is that of the bias. An empty table gives no rows."""
    return arrow_map(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)}, _scores(model), "doc_id long, score double")


def score_column(model: Model, text: Column) -> Column:
    """The score as a column, for filters."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.score((t or "").encode()))

    return score(text)
