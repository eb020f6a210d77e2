"""Near-duplicate groups by SimHash, found through a byte-position inverted index.

A fingerprint has eight bytes. Two that differ in at most two bits differ in at
most two bytes, so they share six positional bytes at least: the guaranteed
minimum of the count filter. A list for one (position, byte) would hold 1/256 of
all fingerprints, hence the index is kept by six positional bytes at once: each of
the 28 choices of six positions has a list for the bytes there, and a pair with a
tally of six or more shared positional bytes meets in one at least. Members of a
list get their tally, pairs that reach the minimum are verified bit by bit.

Members of a list differ in 16 bits only, so that none has more than 65,536. Every
list is dealt into sub-lists of ``SUB`` members, and pairs of sub-lists are tallied
apart, so that a long list is no task of its own.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import arrow_map, cut, numbered, raw_texts
from .graph import forest

SEED = 42
WIDTH = 3
BYTES = 8
BITS = 2
#: Members of a sub-list.
SUB = 64


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """SimHash of UTF-8 bytes: ASCII lower case, words between ASCII white space,
    shingles of ``width`` words with repeats; fewer words: all of them; none: 0."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(text, SEED)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hash_of = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    votes = np.zeros(64, np.int64)
    for low in range(0, n, 65536):
        high = min(n, low + 65536)
        h = np.array([hash_of(text[a : b - 1], SEED) for a, b in zip(starts[low:high], ends[low + width - 1 : high + width - 1], strict=True)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints():
    def step(batch):
        values = np.fromiter((fingerprint(raw) for raw in raw_texts(batch.column(1))), np.uint64, batch.num_rows)
        return batch.column(0), values.view(np.int64)

    return step


def _with_rest(step):
    return lambda batch: (*step(batch), *batch.columns[2:])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp long)``, a row for each row; null text: as an empty one."""
    return arrow_map(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)}, _fingerprints, "doc_id long, fp long")


def _postings(distinct: DataFrame) -> DataFrame:
    """``(fp, choice, bytes)``: a row for each choice of six positions."""
    fp = F.col("fp")
    pairs = itertools.combinations(range(BYTES), BYTES - 6)
    kept = [(1 << 64) - 1 - sum(255 << 8 * k for k in left_out) for left_out in pairs]
    masked = [fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in kept]
    return distinct.select("fp", F.posexplode(F.array(*masked)).alias("choice", "bytes"))


def _tally(delta: Column) -> Column:
    same = [(F.shiftrightunsigned(delta, 8 * k).bitwiseAND(F.lit(255).cast("long")) == 0).cast("int") for k in range(BYTES)]
    return sum(same[1:], same[0])


def links(distinct: DataFrame, sub: int = SUB) -> DataFrame:
    """All pairs ``(u, v)``, u < v, of the distinct fingerprints ``fp`` that are
    within ``BITS`` bits of each other; a pair may come more than once."""
    of = Window.partitionBy("choice", "bytes").orderBy("fp")
    listed = _postings(distinct).select("*", F.row_number().over(of).alias("turn"), F.count("*").over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / sub).cast("int")
    dealt = listed.select("fp", "choice", "bytes", F.pmod(F.col("turn"), parts).alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    met = dealt.groupBy("choice", "bytes", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("own") >= F.col("other"), F.col("fp"))).alias("right")
    )

    def partners(x: Column) -> Column:
        near = F.filter("right", lambda y: ((F.col("a") < F.col("b")) | (x < y)) & (_tally(x.bitwiseXOR(y)) >= BYTES - BITS) & (F.bit_count(x.bitwiseXOR(y)) <= BITS))
        return F.transform(near, lambda y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")))

    return met.select(F.explode(F.flatten(F.transform("left", partners))).alias("e")).select("e.u", "e.v")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sub: int = SUB) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other. A
    null doc_id never names a component; one without any id gets null. Repeated
    rows each return. An empty table gives no rows. Other columns of ``docs``,
    whatever their names, are unread.
    """
    marked = cut(fingerprints(docs, doc_id, text))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    trees = forest(links(distinct.select("fp"), sub)).withColumnRenamed("node", "fp")
    placed = distinct.join(trees, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written out, so that both sides of the joins below are plain exchanges: a
    # large component and a fingerprint of very many documents split over tasks.
    least = cut(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(placed.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with its columns as they are: the
    least by doc_id (null ids last), fingerprint and hash of all columns; of rows
    alike in all that, one. Ids may be null or repeat: a group is told by its
    texts. Null and empty texts are one group. An empty table gives no rows. Texts
    move once, to the list of the rows that stay."""
    keyed, key = numbered(docs)
    columns = {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)} | {f"k{n}": F.col(k) for n, k in enumerate(key)}
    marked = cut(arrow_map(keyed, columns, lambda: _with_rest(_fingerprints()), "doc_id long, fp long, k0 long, k1 string, k2 long"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "k0", "k1", "k2")
    distinct = cut(marked.groupBy("fp").agg(F.min(order).alias("least")))
    trees = forest(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    stay = distinct.join(trees, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    chosen = cut(stay.select(*[F.col(f"least.k{n}").alias(k) for n, k in enumerate(key)]))
    return keyed.join(chosen.hint("shuffle_hash"), key, "left_semi").select(*[f"`{c}`" for c in docs.columns])
