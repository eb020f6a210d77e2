"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. Every document of a source is taken as
often as its budget allows in full; the words that remain are fitted by length
counts: an even share of each length first, longest first, each passing on what it
leaves over, then a bounded-knapsack dynamic program for the remaining budget.
Documents are then chosen by seeded hash within their length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, ranked

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 7
#: Words that the even share gives back to the program, and documents of a length
#: that it gives back, both at first.
GIVEN_BACK, SPARE = 1 << 14, 8
#: Words given back above which a miss is let be: it is below the shortest length
#: that has documents left.
MOST_BACK = 1 << 18
#: Documents of equal length are ranked in parts of about this many.
PART = 200
#: Sources up to which their totals are broadcast.
MAX_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """``totals(source, source_size)`` with ``target``: shares by weight of the sum
    of all sizes, none above three times its size, the excess reshared.

    Round by round, sources whose share at the present level (words a weight) is
    above their cap are held there and the others share the rest, until none is
    above; the level only rises. Sources are ranked in ranges, and a round is one
    sum over them, so there may be any number.
    """
    placed = ranked(totals, [F.col("source").isNull(), F.col("source")], "turn")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("turn") % len(WEIGHTS) + 1).cast("int"))
    weighed = placed.select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * MOST_COPIES).cast("double").alias("cap"))
    level, held = 0.0, -1
    while True:
        above = F.col("w") * level > F.col("cap")
        got = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap"))).alias("fixed"), F.sum(F.when(~above, F.col("w"))).alias("open"), F.count_if(above).alias("held")).first()
        if got["held"] == held or not got["open"]:
            return weighed.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))
        level, held = (float(got["all"]) - (got["fixed"] or 0.0)) / got["open"], got["held"]


def subset(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near
    ``budget`` from below as can be: an even share of each length, of which the
    program gets some back to fit the rest, the more the less well it fits.

    The nearest sum of all is sure once everything is given back, which happens
    unless a sum fits without it. What the even share leaves is below the shortest
    length that has documents left, so the program's size follows the longest
    document, not the number of documents."""
    have = dict(zip(lengths, counts, strict=True))
    total = sum(n * c for n, c in have.items())
    if budget >= total:
        return have
    # All sums are multiples of what the lengths have in common.
    unit = math.gcd(*have)
    if unit > 1:
        return {n * unit: k for n, k in subset([n // unit for n in lengths], counts, budget // unit).items()}
    even, rest = {}, 0.0
    for n in sorted(have, reverse=True):
        rest += have[n] * n * budget / total
        even[n] = min(have[n], int(rest // n)) if n else 0
        rest -= even[n] * n
    # Shares are rounded as floats; what is over goes back, shortest first.
    over = sum(n * k for n, k in even.items()) - budget
    for n in sorted(n for n in even if n):
        while over > 0 and even[n]:
            even[n] -= 1
            over -= n
    back, spare, best, best_short = GIVEN_BACK, SPARE, even, budget + 1
    while True:
        take, all_back = _fitted(have, even, budget, back, spare)
        short = budget - sum(n * k for n, k in take.items())
        if short < best_short:
            best, best_short = take, short
        # Longer programs are tried while a sum of the shortest lengths misses.
        if not best_short or all_back or back > MOST_BACK:
            return best
        back, spare = back * 4, spare * 4


def _fitted(have: dict[int, int], even: dict[int, int], budget: int, back: int, spare: int) -> tuple[dict[int, int], bool]:
    """The even share with up to ``back`` words of it, ``spare`` documents of a
    length, fitted anew; and whether all of it was."""
    take = dict(even)
    for n in sorted(n for n in take if n):
        k = min(take[n], spare, max(1, back // n))
        if back <= 0:
            break
        take[n] -= k
        back -= n * k
    rest = budget - sum(n * k for n, k in take.items())
    fits = _knapsack({n: c - take[n] for n, c in have.items() if 0 < n <= rest and c > take[n]}, rest)
    all_back = not any(take[n] for n in take if n)
    for n, k in fits.items():
        take[n] += k
    return take, all_back


def _knapsack(free: dict[int, int], budget: int) -> dict[int, int]:
    """Counts whose sum is the greatest not above ``budget``. Each length's count
    is dealt into powers of two; of each sum, the step that first reached it is
    kept: four bytes a word of the budget. Stops once the budget is reached."""
    first = np.full(budget + 1, -1, np.int32)
    first[0] = 0
    steps = [(0, 0)]
    for n in sorted(free):
        left, k = min(free[n], budget // n), 1
        while left > 0 and first[budget] < 0:
            k = min(k, left)
            w = n * k
            if w <= budget:
                new = (first[: budget + 1 - w] >= 0) & (first[w:] < 0)
                first[w:][new] = len(steps)
            steps.append((n, k))
            left -= k
            k *= 2
        if first[budget] >= 0:
            break
    at, chosen = int(np.flatnonzero(first >= 0)[-1]), {}
    while at:
        n, k = steps[first[at]]
        chosen[n] = chosen.get(n, 0) + k
        at -= n * k
    return chosen


_PLAN = "source string, size long, docs long, copies long, more long"


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """For one source, whose rows are its distinct lengths."""
    rows = rows.sort_values("size")
    lengths, counts = rows["size"].astype(int).tolist(), rows["docs"].astype(int).tolist()
    size, target = sum(n * c for n, c in zip(lengths, counts, strict=True)), float(rows["target"].iloc[0])
    copies = min(MOST_COPIES, int(target // size)) if size else 0
    more = subset(lengths, counts, round(target - copies * size)) if size and copies < MOST_COPIES else {}
    return pd.DataFrame({"source": rows["source"], "size": lengths, "docs": counts, "copies": copies, "more": [more.get(n, 0) for n in lengths]})


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies)``, a row for each row.

    ``copies`` is how often the mix takes the row, 0 to 3. Null texts have size 0
    and aren't taken; a null source is a source of its own, last in order; rows
    alike in id, source and size are interchangeable, but for columns to ``carry``,
    which come along with their row and break ties. Same input, same result. An
    empty table gives no rows.
    """
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), *carry))
    counted = sized.groupBy("source", "size").agg(F.count("*").alias("docs"))
    aims = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")))
    n_sources = max(1, aims.count())
    same = F.col("c.source").eqNullSafe(F.col("a.source"))
    lengths = counted.alias("c").join(aims.alias("a"), same).select("c.source", "c.size", "c.docs", "a.target")
    plan = cut(lengths.groupBy("source").applyInPandas(_plan, _PLAN).coalesce(n_sources))

    # A length that many documents have is ranked in parts by the seeded hash.
    mark = F.xxhash64(F.lit(seed), "doc_id")
    parts = F.greatest(F.lit(1), (F.col("p.docs") / PART).cast("long"))
    open_ = F.col("p.more").between(1, F.col("p.docs") - 1)
    planned = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
    placed = planned.select("doc_id", "d.source", "d.size", "copies", "more", open_.alias("open"), mark.alias("mark"), F.when(open_, F.pmod(F.shiftright(mark, 20), parts)).alias("part"), *carry)
    part = ["source", "size", "part"]
    many = placed.where("open").groupBy(*part, "more").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = many.withColumn("quota", F.col("more") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(*part, "quota")
    ranked = placed.where("open").withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("mark", "doc_id", *carry)))
    q = quota.alias("q")
    on = F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.size") == F.col("q.size")) & (F.col("r.part") == F.col("q.part"))
    fitted = ranked.alias("r").join(q, on).select("doc_id", "r.source", "r.size", (F.col("copies") + (F.col("r") <= F.col("quota")).cast("long")).alias("copies"), *carry)
    whole = placed.where("NOT open").select("doc_id", "source", "size", (F.col("copies") + (F.col("more") > 0).cast("long")).alias("copies"), *carry)
    taken = whole.unionByName(fitted)
    return taken.alias("t").join(F.broadcast(aims.alias("a")) if n_sources <= MAX_SOURCES else aims.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source"))).select("doc_id", "size", "t.source", "source_size", "target", "copies", *carry)

