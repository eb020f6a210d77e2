"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``K`` least distinct 32-bit hashes of a text's five-word shingles,
ascending, as eight hex digits each. Sketches of parts merge into the sketch of
the union, and estimate resemblance, containment and the number of shingles.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .frames import arrow_map, numbered, ranked, raw_texts

K = 128
WIDTH = 5


def sketch(raw: bytes, k: int = K, width: int = WIDTH) -> np.ndarray:
    """Bottom-k of the text's shingles; texts of fewer words: one shingle of all
    of them; without words: an empty sketch."""
    hashes = hashing.shingles(hashing.words(raw.lower()), width) >> np.uint64(32)
    hashes = hashes.astype(np.uint32)
    if len(hashes) > 4 * k:
        # The k least distinct ones are among these, unless many repeat.
        few = np.unique(np.partition(hashes, 3 * k)[: 3 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what ``a`` and ``b`` are sketches of."""
    return np.union1d(a, b)[:k]


def _met(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The merged sketch, and how many of its hashes both have; from one sort."""
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.ones(len(both), bool)
    first[1:] = ~twice
    merged = both[first][:k]
    shared = np.count_nonzero(twice & (both[1:] <= merged[-1])) if len(merged) else 0
    return merged, shared


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; both empty: 1, one empty: 0."""
    return compared(a, b, k)[0]


def count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) / ((float(a[k - 1]) + 1) / 2**32)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; ``a`` empty: 1."""
    return compared(a, b, k)[1]


def compared(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float]:
    """Resemblance and containment."""
    merged, shared = _met(a, b, k)
    alike = shared / len(merged) if len(merged) else 1.0
    return alike, min(1.0, alike * count(merged, k) / count(a, k)) if len(a) else 1.0


def shown(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def read(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def _sketches():
    def step(batch):
        found = [sketch(raw) for raw in raw_texts(batch.column(1))]
        return batch.column(0), [shown(x) for x in found], [count(x) for x in found]

    return step


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, n_shingles double)``, a row for each row; null text:
    as an empty one, whose fingerprint is the empty string."""
    return arrow_map(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)}, _sketches, "doc_id long, fingerprint string, n_shingles double")


def merged(parts: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """``(key, fingerprint)``: sketches of all rows of a key merged, in SQL: the k
    least distinct hashes. Hot keys are reduced in 64 parts first, and no part
    gathers more than its distinct hashes' k least."""
    hashes = parts.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(fingerprint, F.lit("([0-9a-f]{8})"), 1)).alias("h")).distinct()

    def least(df, *by):
        from pyspark.sql import Window

        return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= k).drop("r")

    few = least(least(hashes.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(64))), "key", "part").drop("part"), "key")
    return few.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the
    next text, or all of it."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


def _in_order():
    """Over the sorted rows of one bucket, which end with a copy of the row that
    follows its last one (``copy`` 1)."""
    held = None

    def step(batch):
        nonlocal held
        rows = []
        for bucket, copy, doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), raw_texts(batch.column(3)), strict=True):
            text, mark = raw.decode(errors="replace"), sketch(raw)
            if held is not None and held[0] == bucket:
                _, before_id, before, before_mark = held
                other = edited(before, text)
                other_mark = sketch(other.encode())
                alike, kept = compared(before_mark, other_mark)
                rows.append((before_id, len(before), hashlib.sha256(other.encode()).hexdigest(), shown(before_mark), shown(other_mark), alike, resemblance(before_mark, mark), kept, count(before_mark)))
            held = None if copy else (bucket, doc_id, text, mark)
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(9)]

    return step


def _targets(cuts: list[tuple], first: tuple):
    """Buckets of each row: its own, and the one before if the row opens its own.
    ``cuts`` are the keys of the rows that open the second and later buckets."""

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for key in zip([(0, 0) if x is None else (1, int(x)) for x in ids], a.tolist(), b.tolist(), strict=True):
            own = bisect.bisect_right(cuts, key)
            opens = own > 0 and cuts[own - 1] == key
            out.append([own, own - 1] if opens else [own, len(cuts)] if key == first else [own])
        return pd.Series(out)

    return lambda *c: targets(F.col(c[0]).cast("string"), *map(F.col, c[1:]))


def _key(doc_id: int | None, a: int, b: int) -> tuple:
    return (0, 0) if doc_id is None else (1, doc_id), a, b


def edit_check(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_in_bucket: int = 2000) -> DataFrame:
    """Each row's fingerprint, that of its edited text (see ``edited``), how alike its
    fingerprint is to the edited text's and to the next row's, the share of its
    shingles that the edited text has, and its number of distinct shingles.

    The order is by doc_id ascending, null ids first, then by a hash of the row and
    its place, so that rows of one id split over tasks like any other; the last row
    is followed by the first. Rows are ranked by these narrow keys alone, and every
    so many of them one opens a bucket: ``rows_in_bucket``, or more where there would
    be over four buckets a shuffle partition. Whole texts move once, to their bucket;
    a copy of the row that opens a bucket goes to the bucket before it. A task streams
    its sorted rows and holds two. Null text: as an empty one. Repeated rows each
    return. An empty table gives no rows.
    """
    keyed, names = numbered(docs)
    place = F.xxhash64(*names[1:])
    rows = keyed.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.col(names[0]).alias("a"), place.alias("b"))
    keys = ranked(rows.select("doc_id", "a", "b"), [F.col("doc_id").asc_nulls_first(), F.col("a"), F.col("b")], "n")
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = keys.count()
    size = max(rows_in_bucket, -(-total // parts))
    opening = [_key(*r) for r in keys.where(F.col("n") % size == 0).orderBy("n").select("doc_id", "a", "b").collect()]
    targets = _targets(opening[1:], opening[0] if opening else ())("doc_id", "a", "b")
    dealt = rows.select("doc_id", "a", "b", "text", F.posexplode(targets).alias("copy", "bucket")).repartitionById(max(1, len(opening)), F.col("bucket"))
    return arrow_map(
        dealt.sortWithinPartitions("copy", "doc_id", "a", "b"), {"bucket": F.col("bucket"), "copy": F.col("copy"), "doc_id": F.col("doc_id"), "text": F.col("text")}, _in_order,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_in_edited double, n_shingles double", batch_rows=500,
    )
