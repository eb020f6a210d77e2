"""Exact top-k by inner product over a vector-approximation file.

Components become the integers floor(1024 * x). The approximation file has one
byte for each: the number of the cell of its dimension (``CELLS`` equal cells
between the least and the greatest component of all vectors). The middle of a
vector's cells gives its score with a query up to a reach that the query alone
fixes, half the cells' widths times the sizes of its components.

Queries go to all tasks in blocks of a checked size. A task scans its part of the
file once for each block and keeps, for each query, the vectors whose upper bound is
not below the k-th best lower bound that it, or a small sample before, has seen. Of what the tasks kept, the
vectors that pass the k-th best lower bound of all are joined to their exact
components and read in the order of their bounds until the k-th best score is above
what any vector not yet read can reach. Up to ``SENT_ROWS`` survivors their numbers
are sent, so that only their vectors move; beyond that the join moves all once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import arrow_map, cut

SCALE = 1024.0
CELLS = 256
#: Queries in a block, and bytes of their components at most (one query at least).
QUERY_BLOCK, BLOCK_BYTES = 4096, 1 << 25
#: Queries answered together by one task.
ANSWERED = 256
#: One in so many vectors, and at most so many, set a first bar for all tasks with
#: their cells; any will do.
SHARE, SAMPLE = 32, 1 << 13
#: Numbers of surviving vectors that are sent to every task at most (8 bytes each).
SENT_ROWS = 1 << 21
#: Candidates that a task holds before it drops those that have fallen behind.
HELD = 1 << 21
#: Sizes of scaled components up to which products of floats are safe.
SAFE = 1e140


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(sound, F.lit(False))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) exactly: as 64-bit integers, or Python's if any is larger."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore"):
        s = np.floor(x * SCALE)
    if s.size == 0 or np.abs(s).max() < 2.0**62:
        return s.astype(np.int64)
    exact = [int(a) if np.isfinite(a) else int(b) * int(SCALE) for a, b in zip(s.ravel(), x.ravel(), strict=True)]
    return np.array(exact, object).reshape(x.shape)


def _rough(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * SCALE), -2 * SAFE, 2 * SAFE)


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """The vectors in ``rows`` of a list column, all of length ``dim``."""
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(rows), dim)


def _by_dim(dims: np.ndarray):
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


class Cells:
    """The cells of one length of vectors."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low
        self.width = np.maximum((high - low) / CELLS, 1.0)
        self.most = np.maximum(np.abs(low), np.abs(high)) + self.width

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.clip((_rough(x) - self.low) // self.width, 0, CELLS - 1).astype(np.uint8)

    def middles(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Score of each query (row) with the middle of each vector's cells."""
        return (queries * self.width) @ codes.T.astype(np.float64) + (queries @ (self.low + self.width / 2))[:, None]

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """How far a score can be from that of the middle, rounding included."""
        size = np.abs(queries)
        out = size @ self.width * 0.5 * (1 + 1e-9) + size @ self.most * (len(self.low) + 8) * 2.0**-50 + 1
        safe = np.all(size < SAFE, axis=1) & bool(np.all(self.most < SAFE))
        return np.where(safe, out, np.inf)


def _extremes():
    def step(batch):
        dims = batch.column(0).to_numpy()
        found = [(dim, _rough(_matrix(batch.column(1), rows, dim))) for dim, rows in _by_dim(dims)]
        return [d for d, _ in found], [x.min(axis=0) for _, x in found], [x.max(axis=0) for _, x in found]

    return step


def learn_cells(exact: DataFrame) -> dict[int, Cells]:
    """Cells of each length of vectors, from all of them; two numbers for each
    dimension reach the driver."""
    parts = arrow_map(exact, {"dim": F.col("dim"), "v": F.col("v")}, _extremes, "dim int, low array<double>, high array<double>", batch_rows=8192)
    ends = parts.select("dim", F.posexplode_outer(F.arrays_zip("low", "high"))).groupBy("dim", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    out: dict[int, list] = {}
    for r in sorted(ends.collect(), key=lambda r: (r["dim"], r["pos"] or 0)):
        out.setdefault(r["dim"], []).extend([(r["low"], r["high"])] if r["pos"] is not None else [])
    return {dim: Cells(*np.array(ends, float).reshape(-1, 2).T) for dim, ends in out.items()}


def _coded(cells: dict[int, Cells]):
    def make():
        def step(batch):
            dims = batch.column(1).to_numpy()
            out: list[bytes] = [b""] * len(dims)
            for dim, rows in _by_dim(dims):
                for i, code in zip(rows, cells[dim].code(_matrix(batch.column(2), rows, dim)), strict=True):
                    out[i] = code.tobytes()
            return batch.column(0), batch.column(1), out

        return step

    return make


class Scan:
    """The candidates of one block of queries of one length, over a part of the file."""

    def __init__(self, cells: Cells, queries: np.ndarray, k: int, bar: np.ndarray | None = None):
        self.cells, self.queries, self.k = cells, queries, k
        self.bar = np.full(len(queries), -np.inf) if bar is None else bar
        self.reach = cells.reach(queries)
        self.top = np.full((len(queries), k), -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def read(self, rows: np.ndarray, codes: np.ndarray) -> None:
        middles = np.nan_to_num(self.cells.middles(self.queries, codes), nan=0.0)
        both = np.concatenate([self.top, middles], axis=1)
        self.top = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        q, at = np.nonzero(middles >= self._least()[:, None])
        self.kept.append((q, rows[at], middles[q, at]))
        self.held += len(q)
        if self.held > HELD:
            self.drop()

    def _least(self) -> np.ndarray:
        """Middles below this can't be among the best: their upper bound is below
        the k-th best lower bound. (Infinite reach: none is.)"""
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(self.reach), np.maximum(self.top.min(axis=1), self.bar) - 2 * self.reach, -np.inf)

    def drop(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, row, middle = (np.concatenate(x) if self.kept else np.zeros(0) for x in (zip(*self.kept, strict=True) if self.kept else [()] * 3))
        near = middle >= self._least()[q.astype(int)]
        self.kept = [(q[near], row[near], middle[near])]
        self.held = int(near.sum())
        return self.kept[0]


def _scan(sent, k: int):
    """Over a part of the approximation file; ``sent`` has the cells and, for each
    length, numbers and components of the block's queries and their first bars."""

    def run(batches):
        cells, block, bars = sent.value
        scans = {dim: Scan(cells[dim], queries, k, bars.get(dim)) for dim, (_, queries) in block.items()}
        for whole_batch in batches:
            for low in range(0, whole_batch.num_rows, 1024):
                batch = whole_batch.slice(low, 1024)
                dims, rows = batch.column(1).to_numpy(), batch.column(0).to_numpy()
                for dim, at in _by_dim(dims):
                    if dim in scans:
                        joined = b"".join(batch.column(2).take(pa.array(at)).to_pylist())
                        scans[dim].read(rows[at], np.frombuffer(joined, np.uint8).reshape(len(at), dim))
        for dim, scan in scans.items():
            q, row, middle = scan.drop()
            if len(q):
                q = q.astype(int)
                yield pa.RecordBatch.from_arrays([pa.array(block[dim][0][q]), pa.array(row.astype(np.int64)), pa.array(middle), pa.array(scan.reach[q])], names=["q", "row", "middle", "reach"])

    return run


def _bars(cells: dict[int, Cells], block: dict, sample: list[tuple[int, bytes]], k: int) -> dict[int, np.ndarray]:
    """For each query the k-th best middle of a sample of the file: that of all is no
    lower."""
    bars = {}
    for dim, (_, queries) in block.items():
        codes = np.frombuffer(b"".join(code for d, code in sample if d == dim), np.uint8).reshape(-1, dim) if dim else np.zeros((0, 0), np.uint8)
        if len(codes) >= k:
            bars[dim] = np.sort(np.nan_to_num(cells[dim].middles(queries, codes), nan=0.0), axis=1)[:, -k]
    return bars


def best(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, upper: np.ndarray, k: int) -> tuple[list[int], list[int], int]:
    """Places and scores of the k best, ties to the smaller id, and how many vectors
    were read: in the order of their upper bounds, in growing pieces."""
    order = np.argsort(-upper, kind="stable")
    places: list[int] = []
    scores: list[int] = []
    read, piece = 0, max(2 * k, 16)
    exact_query = whole(query)
    while read < len(order):
        some = order[read : read + piece]
        exact = whole(vectors[some])
        if exact.dtype == object or exact_query.dtype == object or float(np.abs(exact).max(initial=0)) * float(np.abs(exact_query).max(initial=0)) * max(1, len(query)) >= 2.0**62:
            exact, own = exact.astype(object), exact_query.astype(object)
        else:
            own = exact_query
        found = [int(s) for s in (exact * own).sum(axis=1)] if len(query) else [0] * len(some)
        ranked = sorted(zip([*scores, *found], [*places, *some.tolist()], strict=True), key=lambda x: (-x[0], ids[x[1]]))[:k]
        scores, places = [s for s, _ in ranked], [p for _, p in ranked]
        read += len(some)
        piece *= 2
        if read < len(order) and len(scores) == k and scores[-1] > float(upper[order[read]]):
            break
    return places, scores, read


def _answers(k: int):
    most = np.iinfo(np.int64)

    def answer(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        near = near.sort_values(["q", "vec_id", "row"])
        for query in asked.itertuples(index=False):
            low, high = near["q"].searchsorted([query.q, query.q + 1])
            if low == high:
                continue
            ids, upper = near["vec_id"].to_numpy()[low:high], (near["middle"] + near["reach"]).to_numpy()[low:high]
            vectors = np.stack(near["v"].to_numpy()[low:high])
            # The query's own row: one of those that are as it.
            same = np.flatnonzero((ids == query.query_id) & (vectors == query.v).all(axis=1))
            keep = np.arange(len(ids)) != (same[0] if len(same) else -1)
            ids, upper, vectors = ids[keep], upper[keep], vectors[keep]
            places, scores, _ = best(np.asarray(query.v), vectors, ids, upper, k)
            out += [(query.query_id, n + 1, int(ids[p]), min(max(s, most.min), most.max), query.n) for n, (p, s) in enumerate(zip(places, scores, strict=True))]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score", "n"])

    return answer


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of ``vectors`` for each row of
    ``queries``.

    Both tables have ``vec_id`` and ``embedding``. Rows that aren't ``usable`` or
    have a null id take no part; vectors are compared with those of their length
    only, empty ones too (score 0). For each query one row of ``vectors`` that
    equals it in id and components is its own and is left out; all others are
    candidates, also those with its id, and repeated rows each return. Rows with
    equal vectors tie for every query, so the k + 1 first of them by id stand for
    all. Scores outside 64 bits are ranked exactly and returned as the nearest long.
    No candidates: no rows.
    """
    def read(df: DataFrame) -> DataFrame:
        v = F.col(embedding)
        kind = "float" if df.schema[embedding].dataType.simpleString() == "array<float>" else "double"
        # Minus zero becomes zero, so that equal vectors are alike bit by bit.
        return df.where(usable(v) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: x.cast(kind) + F.lit(0).cast(kind)).alias("v"))

    alike = Window.partitionBy("h", "v").orderBy("id")
    firsts = read(vectors).withColumn("h", F.xxhash64("v")).withColumn("turn", F.row_number().over(alike)).where(F.col("turn") <= k + 1)
    exact = cut(firsts.select("id", "v", F.size("v").alias("dim")).withColumn("row", F.monotonically_increasing_id()))
    asked = cut(read(queries).groupBy("id", "v").agg(F.count("*").alias("n")).withColumn("dim", F.size("v")).withColumn("q", F.monotonically_increasing_id()))
    cells = learn_cells(exact)
    file = cut(arrow_map(exact, {"row": F.col("row"), "dim": F.col("dim"), "v": F.col("v")}, _coded(cells), "row long, dim int, code binary"))

    sample = [(r["dim"], bytes(r["code"])) for r in file.where(F.pmod(F.xxhash64("row"), F.lit(SHARE)) == 0).limit(SAMPLE).collect()]
    spark, found, n_asked = vectors.sparkSession, None, 0
    for block in _blocks(asked, cells):
        n_asked += sum(len(q) for q, _ in block.values())
        sent = spark.sparkContext.broadcast((cells, block, _bars(cells, block, sample, k + 1)))
        kept = cut(file.mapInArrow(_scan(sent, k + 1), "q long, row long, middle double, reach double"))
        sent.destroy()
        found = kept if found is None else found.unionByName(kept)
    if found is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)

    # The k-th best lower bound of all parts (one more, for the query's own row).
    by_query = Window.partitionBy("q")
    placed = found.withColumn("turn", F.row_number().over(by_query.orderBy(F.desc("middle"))))
    bar = F.max(F.when(F.col("turn") == k + 1, F.col("middle") - 2 * F.col("reach"))).over(by_query)
    near = cut(placed.withColumn("bar", bar).where(F.col("bar").isNull() | (F.col("middle") >= F.col("bar"))).select("q", "row", "middle", "reach"))
    # Where the survivors' numbers are few enough to be sent, no other vector moves.
    alive = exact.join(F.broadcast(near.select("row").distinct()), "row", "left_semi") if near.count() <= SENT_ROWS else exact
    with_vectors = near.join(alive, "row").select("q", "row", "middle", "reach", F.col("id").alias("vec_id"), "v")
    n_groups = max(1, n_asked // ANSWERED)
    group = F.pmod(F.xxhash64("q"), F.lit(n_groups)).alias("g")
    left = asked.select("q", F.col("id").alias("query_id"), "v", "n", group).groupBy("g")
    answers = left.cogroup(with_vectors.select("*", group).groupBy("g")).applyInPandas(lambda a, b: _answers(k)(a, b), "query_id long, rank int, vec_id long, score long, n long")
    return answers.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("query_id", "rank", "vec_id", "score")


def _blocks(asked: DataFrame, cells: dict[int, Cells]):
    """Blocks of queries, as numbers and scaled components for each length: so many
    rows at most that they may be sent to every task."""
    block: dict[int, list] = {}
    rows = size = 0
    for r in asked.where(F.col("dim").isin(*cells) if cells else F.lit(False)).select("q", "v").toLocalIterator():
        if rows and (rows >= QUERY_BLOCK or size + 8 * len(r["v"]) > BLOCK_BYTES):
            yield _packed(block)
            block, rows, size = {}, 0, 0
        block.setdefault(len(r["v"]), []).append((r["q"], r["v"]))
        rows, size = rows + 1, size + 8 * len(r["v"])
    if rows:
        yield _packed(block)


def _packed(block: dict[int, list]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {dim: (np.array([q for q, _ in got], np.int64), _rough(np.array([v for _, v in got], float).reshape(len(got), dim))) for dim, got in block.items()}
