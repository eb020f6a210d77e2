"""Vectorised hashes of words, word shingles and character n-grams of one text.

A text's prefix sums of a polynomial run on from one piece to the next, so words
and n-grams over the border of a piece are as any other; only a piece at a time
takes room beside the text.
"""

from __future__ import annotations

import numpy as np

#: Bytes or characters hashed at once.
CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE_BASE = pow(_BASE, -1, 1 << 64)
_SPACES = (32, 9, 10, 11, 12, 13)


def _powers(base: int) -> np.ndarray:
    steps = np.full(CHUNK + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(_INVERSE_BASE)


def mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_WORD = np.ones(256, bool)
_WORD[list(_SPACES)] = False


def _inside(a: np.ndarray) -> np.ndarray:
    """True where not ASCII white space."""
    return _WORD.take(a) if a.dtype == np.uint8 else _WORD.take(np.minimum(a, 255))


def _sums(a: np.ndarray) -> np.ndarray:
    """Prefix sums of ``(a[i] + 1) * base**i``."""
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _POWER[: len(a)], out=sums[1:])
    return sums


def word_hashes(a: np.ndarray):
    """Hashes of the words between ASCII white space, a piece of ``a`` at a time;
    a word of any length has one hash."""
    total, begun = 0, None
    for low in range(0, len(a), CHUNK):
        piece = a[low : low + CHUNK]
        sums, back_by = _sums(piece), _INVERSE
        if low:
            sums = sums * np.uint64(pow(_BASE, low, 1 << 64)) + np.uint64(total)
            back_by = _INVERSE * np.uint64(pow(_INVERSE_BASE, low, 1 << 64))
        inside = _inside(piece)
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(begun is not None))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first, back = sums[starts], back_by[starts]
        if begun is not None:
            first, back = np.insert(first, 0, begun[0]), np.insert(back, 0, begun[1])
        n = len(ends)
        begun = (first[n], back[n]) if len(first) > n else None
        total = int(sums[-1])
        yield mixed((sums[ends] - first[:n]) * back[:n])
    if begun is not None:
        yield mixed((np.array([total], np.uint64) - begun[0]) * begun[1])


def words(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space."""
    return np.concatenate([np.empty(0, np.uint64), *word_hashes(np.frombuffer(raw, np.uint8))])


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; fewer: of all; none: empty."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(n, width)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * _POWER[j + 1]
    return mixed(total)


def characters(raw: bytes) -> np.ndarray:
    """Code points, with white space as blanks and a blank before and after."""
    points = np.frombuffer(f" {raw.decode(errors='replace')} ".encode("utf-32-le"), np.uint32).copy()
    points[~_inside(points)] = 32
    return points


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """The upper bits of a multiplied hash; ``buckets`` is a power of two."""
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(65 - buckets.bit_length())).astype(np.int32)


def features(raw: bytes, buckets: int, grams: tuple[int, ...]):
    """Bucket numbers of a text's words, pairs of neighbouring words and character
    n-grams of its words, a piece at a time. An n-gram lies within one word, whose
    first and last character have a blank beside them that counts as one."""
    points = characters(raw)
    before = np.empty(0, np.uint64)
    for own in word_hashes(points):
        run = np.concatenate([before, own]) if len(before) else own
        yield _buckets(own, buckets)
        if len(run) > 1:
            yield _buckets(run[1:] + run[:-1] * _POWER[1], buckets)
        before = run[-1:]
    most = max(grams)
    for low in range(0, len(points), CHUNK - most):
        a = points[low : low + CHUNK - 1]
        sums = _sums(a)
        blanks = np.zeros(len(a) + 1, np.int32)
        np.cumsum(a == 32, out=blanks[1:])
        for n in grams:
            # Windows that begin in this piece and have no blank inside.
            count = min(CHUNK - most, len(a) - n + 1)
            if count > 0:
                h = (sums[n : n + count] - sums[:count]) * _INVERSE[:count] + np.uint64(n)
                yield _buckets(h[blanks[n - 1 : n - 1 + count] == blanks[1 : 1 + count]], buckets)
