"""Toxicity classifier: gradient-boosted trees over a few dense features.

Features are rates over the whole text: words of a small fixed lexicon, words of a
lexicon learned from the labelled sample, both also after undoing obfuscation,
second-person words and those near an insult, capitals, punctuation, obfuscation.
Trees grow on binned features with a logistic loss; isotonic regression on
out-of-fold predictions turns their sums into probabilities. Out of fold means
without the fold in the lexicon too: each fold has a lexicon and trees of its own
that have seen nothing of it.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_map, cut, raw_texts
from .quality import labelled

#: Labelled documents that training takes at most; which ones, a hash decides.
SAMPLE = 20_000
#: Entries in the learned lexicon at most, toxic documents of the sample that must
#: have one, and the log of the least lift, two standard errors off, to be learned.
LEXICON = 1000
SUPPORT = 4
LIFT = 1.5
#: Lengths of the word beginnings that are learned beside whole words.
STEMS = range(4, 9)
TREES, DEPTH, RATE, BINS, FOLDS, LEAST = 60, 3, 0.15, 32, 4, 8.0

# Insults in the languages of the corpora, lower case.
INSULTS = frozenset(
    """
    idiot idiots moron morons stupid dumb loser losers worthless disgusting pathetic scum trash clown garbage
    filth vermin imbecile jerk bastard bitch crap shit fuck fucking asshole hate kill
    dumm idioten abschaum arschloch scheisse stupide connard merde imbécile salaud ordure estúpido idiota basura mierda imbécil
    """.split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dein deine euch ihr tu toi ton ta vous votre vos te tú usted ustedes".split())
_SEPARATORS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
_OBFUSCATED = re.compile(rb"(?<![A-Za-z])[A-Za-z]++[0-9@$!*|][0-9@$!*|A-Za-z]*[A-Za-z]|[0-9@$|][A-Za-z][0-9@$!*|A-Za-z]*[A-Za-z]|(?<![A-Za-z])(?:[A-Za-z][ .*_-]){3,}[A-Za-z](?![A-Za-z])")
FEATURES = 16


def words(raw: bytes) -> list[str]:
    """Lower-cased runs of letters; characters above ASCII count as letters."""
    return raw.translate(_SEPARATORS).decode(errors="replace").lower().split()


def hidden(raw: bytes) -> list[str]:
    """Words written with digits, signs or gaps between letters, undone."""
    return [re.sub(rb"[^a-z]", b"", m.translate(_LEET).lower()).decode() for m in _OBFUSCATED.findall(raw)]


class Lexicon:
    """Learned words, and learned beginnings of words (written with a final ``*``)."""

    def __init__(self, entries):
        self.words = frozenset(e for e in entries if not e.endswith("*"))
        self.stems = frozenset(e[:-1] for e in entries if e.endswith("*"))
        self.lengths = sorted({len(s) for s in self.stems})

    def begun(self, own: set[str]) -> set[str]:
        """The words that begin with a learned stem."""
        found: set[str] = set()
        for n in self.lengths:
            if hits := {w[:n] for w in own} & self.stems:
                found |= {w for w in own if w[:n] in hits}
        return found


def _places(own: list[str], hits: set[str]) -> list[int]:
    return [i for i, w in enumerate(own) if w in hits] if hits else []


def near_count(places: list[int], others: list[int], within: int = 5) -> int:
    """How many of ``places`` have one of the ``others`` within so many words; both
    ascend, so it is one search for each place."""
    if not places or not others:
        return 0
    at, to = np.array(places), np.array([-(10**12), *others, 10**12])
    after = np.searchsorted(to, at)
    return int((np.minimum(at - to[after - 1], to[after] - at) <= within).sum())


def features(raw: bytes, learned: Lexicon) -> list[float]:
    return featured(raw, [learned])[0]


def featured(raw: bytes, lexicons: list[Lexicon]) -> list[list[float]]:
    """The features under each lexicon; the text is read once."""
    own, masked = words(raw), hidden(raw)
    n = max(len(own), 1)
    a = np.frombuffer(raw, np.uint8)
    size = max(len(a), 1)
    upper = int(((a >= 65) & (a <= 90)).sum())
    lower = int(((a >= 97) & (a <= 122)).sum())
    distinct = set(own)
    fixed, you = _places(own, distinct & INSULTS), _places(own, distinct & SECOND_PERSON)
    signs = [100 * raw.count(b"!") / size, 100 * (raw.count(b"?") + raw.count(b"*") + raw.count(b"#")) / size, np.log1p(n)]
    out = []
    for learned in lexicons:
        taught, begun = _places(own, distinct & learned.words), _places(own, learned.begun(distinct))
        masked_hits = sum(w in INSULTS or w in learned.words for w in masked)
        insults = sorted({*fixed, *taught, *begun})
        out.append([
            len(fixed), 100 * len(fixed) / n, len(taught), 100 * len(taught) / n, len(begun), 100 * len(begun) / n, len({own[i] for i in insults}),
            masked_hits, 100 * masked_hits / n, 100 * len(masked) / n, 100 * len(you) / n, near_count(you, insults), upper / max(upper + lower, 1), *signs,
        ])
    return out


def entries(raw: bytes) -> set[str]:
    """What a text could teach: its words and their beginnings."""
    own = {*words(raw), *hidden(raw)}
    return own | {w[:n] + "*" for w in own for n in STEMS if len(w) > n}


def _word_sets():
    def step(batch):
        return batch.column(1), batch.column(2), [sorted(entries(raw)) for raw in raw_texts(batch.column(0))]

    return step


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """A lexicon of the whole ``sample(text, y, fold)``, and one for each fold of all
    but that fold.

    Words and beginnings of words that occur far oftener in toxic documents: in at
    least ``SUPPORT`` of them, at most ``LEXICON`` entries, best first. Counts by
    fold are partial aggregates; only the chosen reach the driver."""
    sets = arrow_map(sample, {"text": F.col("text"), "y": F.col("y"), "fold": F.col("fold")}, _word_sets, "y int, fold int, words array<string>")

    def counts(kind: int) -> list:
        return [F.count_if((F.col("y") == kind) & (F.col("fold") == k)) for k in range(FOLDS)]

    both = [c.alias(f"{name}{k}") for name, kind in (("bad", 1), ("good", 0)) for k, c in enumerate(counts(kind))]
    totals = sample.agg(*both).first()
    by_word = cut(sets.select("y", "fold", F.explode("words").alias("word")).groupBy("word").agg(*both).where(sum((F.col(f"bad{k}") for k in range(1, FOLDS)), F.col("bad0")) >= SUPPORT))

    def chosen(folds: list[int]) -> Lexicon:
        bad, good = (sum((F.col(f"{name}{k}") for k in folds[1:]), F.col(f"{name}{folds[0]}")) for name in ("bad", "good"))
        toxic, clean = (sum(totals[f"{name}{k}"] or 0 for k in folds) + 1 for name in ("bad", "good"))
        lift = F.log((bad + 0.5) / toxic) - F.log((good + 0.5) / clean)
        # Two standard errors of the log ratio below the lift.
        sure = lift - 2 * F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        best = by_word.where(bad >= SUPPORT).select("word", sure.alias("sure")).where(F.col("sure") > LIFT).orderBy(F.desc("sure"), "word").limit(LEXICON)
        return Lexicon([r["word"] for r in best.collect()])

    everyone = list(range(FOLDS))
    return [chosen(everyone), *(chosen([k for k in everyone if k != out]) for out in everyone)]


class Trees:
    """Boosted trees: for each tree the features and bounds of its inner nodes, in
    level order, and the values of its leaves."""

    def __init__(self, base: float):
        self.base, self.trees = base, []

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feature, bound, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > bound[node])
            total += leaf[node - len(feature)]
        return total


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), model.base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, bound, cell = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for f, e in enumerate(edges):
                at = (node - first) * BINS + bins[:, f]
                gs, hs = (np.bincount(at, w, n * BINS).reshape(n, BINS).cumsum(axis=1) for w in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                gain[(hs < LEAST / 10) | (ha - hs < LEAST / 10)] = 0
                gain = gain[:, : len(e)]
                if not gain.size:
                    continue
                k = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(n), k] > best)
                best[better] = gain[better, k[better]]
                feature[first + better], bound[first + better], cell[first + better] = f, e[k[better]], k[better]
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cell[node])
        leaf_of = node - inner
        leaf = -RATE * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + 1)
        score += leaf[leaf_of]
        model.trees.append((feature, bound, leaf))
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps ``(lowest score, value)``, ascending."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum, weight, lowest score
    for s, v in zip(score[order], y[order], strict=True):
        if pools and pools[-1][2] == s:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([float(v), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v2, w2, _ = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += w2
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees, steps: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.steps = lexicon, trees, steps

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; within a step the raw score still orders, by a thousandth."""
        raw = self.trees.raw_score(x)
        at, value = self.steps
        if not len(at):
            return 1 / (1 + np.exp(-raw))
        level = value[np.maximum(np.searchsorted(at, raw, "right") - 1, 0)]
        return 0.999 * level + 0.001 / (1 + np.exp(-raw))


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicons: list[Lexicon]) -> Model:
    """``x``: for each row its features under each lexicon, the whole one first."""
    trees = boost(x[:, 0], y)
    if len(y) < 10 * FOLDS or y.min() == y.max():
        return Model(lexicons[0], trees, (np.array([]), np.array([])))
    out = np.zeros(len(y))
    for k in range(FOLDS):
        out[fold == k] = boost(x[fold != k, 1 + k], y[fold != k]).raw_score(x[fold == k, 1 + k])
    return Model(lexicons[0], trees, isotonic(out, y))


def _rows(lexicons: list[Lexicon]):
    def make():
        def step(batch):
            return batch.column(0), [list(itertools.chain.from_iterable(featured(raw, lexicons))) for raw in raw_texts(batch.column(1))], batch.column(2), batch.column(3)

        return step

    return make


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out fifth
    (see ``quality.labelled``), which are written out once; their feature rows
    (``FEATURES`` numbers for each lexicon) reach the driver. Without usable labels
    every score is 0.5."""
    rows = cut(labelled(docs, labels, label, sample, doc_id, text).withColumn("fold", F.pmod(F.xxhash64(F.lit(FOLDS), "doc_id"), F.lit(FOLDS)).cast("int")))
    lexicons = learn_lexicons(rows)
    got = arrow_map(rows, {c: F.col(c) for c in rows.columns}, _rows(lexicons), "doc_id long, x array<double>, y int, fold int").toArrow().sort_by("doc_id").combine_chunks()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, 1 + FOLDS, FEATURES) if len(got) else np.zeros((0, 1 + FOLDS, FEATURES))
    return train(x, got["y"].to_numpy().astype(float), got["fold"].to_numpy(), lexicons)


def _scores(model: Model):
    def make():
        def step(batch):
            x = np.array([features(raw, model.lexicon) for raw in raw_texts(batch.column(1))], float)
            return batch.column(0), model.score(x)

        return step

    return make


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``, a row for each row, repeated rows alike; a null text is as
    an empty one, whose rates are all 0. An empty table gives no rows."""
    return arrow_map(docs, {"doc_id": F.col(doc_id).cast("long"), "text": F.col(text)}, _scores(model), "doc_id long, score double")
