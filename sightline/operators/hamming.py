"""The two nearest codes by Hamming distance, without caps and without a row a pair.

Codes are cut into three parts of their low 31 bits. Two codes that differ in at most
five bits differ in at most one bit of some part, so those that share such a part are
compared first; a code whose second is farther than that meets all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of the left and of the right side that a task compares at once.
LEFT, RIGHT = 1 << 15, 1 << 18
#: Lowest bit and width of each part; the distance up to which the parts find all.
PARTS, SURE = ((0, 11), (11, 10), (21, 10)), 5
#: Right codes up to which all are compared at once.
FEW = 1 << 13
_NONE = np.iinfo(np.int64).max


def _two_of(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each left code the two least of distance << 32 | place over all of ``right``,
    whose places are ``at``."""
    out = np.full((len(left), 2), _NONE)
    if not len(right):
        return out
    # Positions within ``right`` are ascending places, so they break ties alike.
    position = np.arange(len(right), dtype=np.uint32)
    for k in range(0, len(left), step := max(1, (1 << 18) // len(right))):
        low = left[k : k + step, None] ^ right[None]
        key = np.bitwise_count(low).astype(np.uint32)
        key <<= 25
        key |= position
        rows = np.arange(len(key))
        for turn in range(min(2, len(right))):
            best = key.argmin(axis=1)
            d = (key[rows, best] >> 25).astype(np.int64)
            out[k : k + step, turn] = d << 32 | at[best]
            key[rows, best] = np.iinfo(np.uint32).max
    return out


def two_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each left code the two least of distance << 32 | index of the right code."""
    every = np.arange(len(right))
    if len(right) <= FEW:
        return _two_of(left, right, every)
    best = np.full((len(left), 2), _NONE)
    for low, width in PARTS:
        pl, pr = ((v >> low & ((1 << width) - 1)).astype(np.int64) for v in (left, right))
        by_l, by_r = np.argsort(pl, kind="stable"), np.argsort(pr, kind="stable")
        cuts_l, cuts_r = (np.searchsorted(p[by], np.arange((1 << width) + 1)) for p, by in ((pl, by_l), (pr, by_r)))
        for part in np.unique(pl):
            own = by_l[cuts_l[part] : cuts_l[part + 1]]
            near = np.sort(np.concatenate([by_r[cuts_r[q] : cuts_r[q + 1]] for q in (part, *(part ^ (1 << k) for k in range(width)))]))
            # One right code may come by several parts.
            both = np.sort(np.hstack([best[own], _two_of(left[own], right[near], near)]), axis=1)
            best[own, 0] = both[:, 0]
            best[own, 1] = np.where(both > both[:, :1], both, _NONE).min(axis=1)
    open_ = np.flatnonzero(best[:, 1] >> 32 > SURE)
    best[open_] = _two_of(left[open_], right, every)
    return best


def two_nearest(a: DataFrame, b: DataFrame, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """``(i, j, d1, d2)`` for ``a(i, code)`` and ``b(j, code)``, longs: the nearest ``j`` (of
    equal distances the least), its distance and the second's, NULL where there is
    none. Slices of both sides meet; the best two of each meeting are merged."""
    (i, da), (j, db) = left, right
    a, b = a.dropna(subset=[i, da]), b.dropna(subset=[j, db])
    m, n = (max(1, -(-df.count() // most)) for df, most in ((a, LEFT), (b, RIGHT)))

    def slices(df: DataFrame, key: str, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        # Both sides' numbers are ints: keys of another type would hash elsewhere.
        mine, every = F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias(names[0]), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1])
        return df.select("*", mine, every)

    def meet(these: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        those = those.sort_values(j)
        codes, others, number = these[da].to_numpy(np.int64).view(np.uint64), those[db].to_numpy(np.int64).view(np.uint64), those[j].to_numpy(np.int64)
        if max(int(c.max(initial=0)) for c in (codes, others)) < 1 << 32:
            codes, others = codes.astype(np.uint32), others.astype(np.uint32)
        best = two_of(codes, others)
        own, turn = np.nonzero(best < _NONE)
        key = best[own, turn]
        return pd.DataFrame({"i": these[i].to_numpy()[own], "d": key >> 32, "j": number[key & 0xFFFFFFFF]})

    met = slices(a, i, m, n, ("_l", "_r")).groupBy("_l", "_r").cogroup(slices(b, j, n, m, ("_r", "_l")).groupBy("_l", "_r")).applyInPandas(meet, "i long, d int, j long")
    two = met.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "j"))), 1, 2).alias("n"))
    return two.select("i", F.get("n", F.lit(0))["j"].alias("j"), F.get("n", F.lit(0))["d"].alias("d1"), F.get("n", F.lit(1))["d"].alias("d2"))
