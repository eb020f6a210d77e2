"""Dense image kernels in NumPy, from published descriptions.

Frames are arrays (height, width) of 0..255, or (height, width, 3). Results follow
the cited methods, not any library bit by bit.
"""

from __future__ import annotations

from collections import deque

import numpy as np


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur with mirrored borders."""
    radius = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = np.asarray(image, float)
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (radius, radius)
        wide = np.pad(out, pad, mode="symmetric")
        out = sum(w * np.take(wide, np.arange(k, k + image.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return out


def unsharp(image, amount: float = 0.6, sigma: float = 1.2, keep: np.ndarray | None = None) -> np.ndarray:
    """(1 + a) v - a blur(v); pixels of ``keep`` stay as they are."""
    out = np.clip((1 + amount) * image - amount * gaussian(image, sigma), 0, 255)
    return out if keep is None else np.where(keep, image, out)


def laplacian(image) -> np.ndarray:
    p = np.pad(np.asarray(image, float), 1, mode="symmetric")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def equalise(image, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation (Zuiderveld): clipped histograms of
    tiles, their curves blended bilinearly."""
    image = np.asarray(image)
    h, w = image.shape
    rows, cols = np.array_split(np.arange(h), min(tiles, h)), np.array_split(np.arange(w), min(tiles, w))
    curves = np.empty((len(rows), len(cols), 256))
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            counts = np.bincount(image[np.ix_(r, c)].astype(np.uint8).ravel(), minlength=256).astype(float)
            limit = max(clip * counts.sum() / 256, 1.0)
            extra = np.maximum(counts - limit, 0).sum()
            counts = np.minimum(counts, limit) + extra / 256
            curves[i, j] = 255 * counts.cumsum() / counts.sum()
    y = np.interp(np.arange(h), [r.mean() for r in rows], np.arange(len(rows)))
    x = np.interp(np.arange(w), [c.mean() for c in cols], np.arange(len(cols)))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, len(rows) - 1), np.minimum(x0 + 1, len(cols) - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    v = image.astype(np.uint8)

    def of(a, b):
        return curves[a[:, None], b[None], v]

    return (1 - fy) * ((1 - fx) * of(y0, x0) + fx * of(y0, x1)) + fy * ((1 - fx) * of(y1, x0) + fx * of(y1, x1))


class Mixture:
    """Adaptive Gaussian mixture a pixel (Stauffer and Grimson; Zivkovic)."""

    def __init__(self, shape, history: int = 500, bound: float = 16.0, k: int = 3, background: float = 0.9):
        self.rate, self.bound, self.share = 1 / history, bound, background
        self.weight, self.mean, self.var = np.zeros((k, *shape)), np.zeros((k, *shape)), np.full((k, *shape), 225.0)
        self.seen = 0

    def apply(self, frame) -> np.ndarray:
        """True where the frame fits no background mode."""
        frame = np.asarray(frame, float)
        self.seen += 1
        rate = max(self.rate, 1 / self.seen)
        gap = (frame - self.mean) ** 2 / self.var
        fits = (gap < self.bound) & (self.weight > 0)
        order = np.argsort(-self.weight / np.sqrt(self.var), axis=0)
        ranked = np.take_along_axis(self.weight, order, 0)
        ground = np.zeros_like(fits)
        np.put_along_axis(ground, order, ranked.cumsum(axis=0) - ranked < self.share, 0)
        front = ~(fits & ground).any(axis=0)
        first = fits & (np.cumsum(np.take_along_axis(fits, order, 0), axis=0) == 1).any(axis=0)
        best = np.where(fits, self.weight, -1).argmax(axis=0)
        own = (np.arange(len(fits))[:, None, None] == best) & first
        self.weight += rate * (own - self.weight)
        step = np.where(own, rate / np.maximum(self.weight, 1e-6), 0).clip(0, 1)
        delta = frame - self.mean
        self.mean += step * delta
        self.var = np.where(own, np.clip(self.var + step * (delta**2 - self.var), 4, 1125), self.var)
        none = ~fits.any(axis=0)
        new = (np.arange(len(fits))[:, None, None] == self.weight.argmin(axis=0)) & none
        self.weight, self.mean, self.var = np.where(new, rate, self.weight), np.where(new, frame, self.mean), np.where(new, 225.0, self.var)
        self.weight /= self.weight.sum(axis=0)
        return front


def flow(before, after, window: float = 2.0, steps: int = 5) -> np.ndarray:
    """Dense optical flow (Lucas and Kanade over a Gaussian window, iterated):
    (height, width, 2) displacements x, y; of stacks (height, width, n), with the
    frames along the last axis, (height, width, n, 2)."""
    a, b = gaussian(before, 1.0), gaussian(after, 1.0)
    gy, gx = np.gradient(a, axis=(0, 1))
    xx, xy, yy = (gaussian(p, window) for p in (gx * gx, gx * gy, gy * gy))
    det = xx * yy - xy * xy + 1e-3 * (xx + yy) + 1e-6
    u = np.zeros((*a.shape, 2))
    ys, xs = (g.reshape(*g.shape, *[1] * (a.ndim - 2)) for g in np.mgrid[: a.shape[0], : a.shape[1]].astype(float))
    for _ in range(steps):
        d = bilinear(b, xs + u[..., 0], ys + u[..., 1]) - a
        bx, by = gaussian(gx * d, window), gaussian(gy * d, window)
        u[..., 0] -= (yy * bx - xy * by) / det
        u[..., 1] -= (xx * by - xy * bx) / det
    return u


def bilinear(image, x, y) -> np.ndarray:
    """Values at places between pixels; of a stack, places in each of its frames."""
    h, w = image.shape[:2]
    own = (np.arange(image.shape[2]),) if image.ndim > 2 else ()
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), w - 2 if w > 1 else 0), np.minimum(y.astype(int), h - 2 if h > 1 else 0)
    fx, fy = x - x0, y - y0
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)

    def of(ys, xs):
        return image[(ys, xs, *own)]

    return (1 - fy) * ((1 - fx) * of(y0, x0) + fx * of(y0, x1)) + fy * ((1 - fx) * of(y1, x0) + fx * of(y1, x1))


def bilateral(image, radius: int = 2, space: float = 9.0, tone: float = 40.0) -> np.ndarray:
    """Edge-keeping smoothing (Tomasi and Manduchi)."""
    image = np.asarray(image, float)
    h, w = image.shape
    wide = np.pad(image, radius, mode="symmetric")
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            v = wide[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
            k = np.exp(-(dx * dx + dy * dy) / (2 * space**2) - (v - image) ** 2 / (2 * tone**2))
            total += k * v
            weight += k
    return total / weight


def to_lab(rgb) -> np.ndarray:
    """sRGB to CIE L*a*b* under D65."""
    c = np.asarray(rgb, float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]]) / np.array([0.95047, 1.0, 1.08883])
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (24389 / 27 * xyz + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def superpixels(image, size: int = 28, rounds: int = 4, compact: float = 10.0) -> np.ndarray:
    """SLIC (Achanta et al.): k-means over tone and place near grid seeds."""
    image = np.asarray(image, float)
    h, w = image.shape[:2]
    tone = image.reshape(h, w, -1)
    ys, xs = np.arange(min(size // 2, h // 2), h, size), np.arange(min(size // 2, w // 2), w, size)
    seeds = np.array([(y, x, *tone[y, x]) for y in ys for x in xs], float)
    gy, gx = np.mgrid[:h, :w]
    label = np.zeros((h, w), int)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for k, (y, x, *t) in enumerate(seeds):
            y0, y1, x0, x1 = max(0, int(y) - size), min(h, int(y) + size + 1), max(0, int(x) - size), min(w, int(x) + size + 1)
            far = ((tone[y0:y1, x0:x1] - t) ** 2).sum(axis=-1) / compact**2 + ((gy[y0:y1, x0:x1] - y) ** 2 + (gx[y0:y1, x0:x1] - x) ** 2) / size**2
            near = far < best[y0:y1, x0:x1]
            best[y0:y1, x0:x1][near] = far[near]
            label[y0:y1, x0:x1][near] = k
        n = np.maximum(np.bincount(label.ravel(), minlength=len(seeds)), 1)
        seeds = np.stack([np.bincount(label.ravel(), v.ravel(), len(seeds)) / n for v in (gy, gx, *np.moveaxis(tone, -1, 0))], axis=1)
    return label


def dilate(mask, radius: int = 1) -> np.ndarray:
    wide = np.pad(mask, radius)
    h, w = mask.shape
    return np.maximum.reduce([wide[y : y + h, x : x + w] for y in range(2 * radius + 1) for x in range(2 * radius + 1)])


def erode(mask, radius: int = 1) -> np.ndarray:
    return ~dilate(~np.asarray(mask, bool), radius)


def closed(mask, radius: int = 1) -> np.ndarray:
    wide = np.pad(mask, radius)
    return erode(dilate(wide, radius), radius)[radius : radius + mask.shape[0], radius : radius + mask.shape[1]]


def opened(mask, radius: int = 1) -> np.ndarray:
    return dilate(erode(mask, radius), radius)


def blobs(mask) -> tuple[np.ndarray, int]:
    """Eight-neighbour components by flood: labels from 1, and how many."""
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x]:
            continue
        n += 1
        label[y, x] = n
        queue = deque([(y, x)])
        while queue:
            a, b = queue.popleft()
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not label[c, d]:
                        label[c, d] = n
                        queue.append((c, d))
    return label, n


def hull(points) -> np.ndarray:
    """Convex hull by Andrew's monotone chain, counter-clockwise."""
    p = sorted(set(map(tuple, np.asarray(points, float))))
    if len(p) < 3:
        return np.array(p)

    def half(ps):
        out = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points) -> np.ndarray:
    """Rectangle of least area around points: one side lies on a hull edge."""
    h = hull(points)
    if len(h) < 3:
        return np.repeat(h[:1], 4, axis=0) if len(h) else h
    best = None
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        d = (b - a) / np.hypot(*(b - a))
        r = np.array([d, (-d[1], d[0])])
        low, high = (h @ r.T).min(axis=0), (h @ r.T).max(axis=0)
        size = (high - low).prod()
        if best is None or size < best[0] - 1e-9:
            best = (size, np.array([low, (high[0], low[1]), high, (low[0], high[1])]) @ r)
    return best[1]


def simplified(line, slack: float) -> np.ndarray:
    """Douglas and Peucker's simplification of an open line."""
    line = np.asarray(line, float)
    keep, spans = np.zeros(len(line), bool), [(0, len(line) - 1)]
    keep[[0, -1]] = True
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        off = line[a + 1 : b] - line[a]
        far = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / np.hypot(*d) if np.hypot(*d) else np.hypot(*off.T)
        k = int(far.argmax())
        if far[k] > slack:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def xdog(image, sigma: float = 3.0, k: float = 1.6, tau: float = 0.985, epsilon: float = 0.30, phi: float = 2.5, tone: float = 0.55) -> np.ndarray:
    """Extended difference of Gaussians (Winnemoeller) mixed into the tone."""
    v = np.asarray(image, float) / 255
    d = gaussian(v, sigma) - tau * gaussian(v, sigma * k)
    d = d / max(float(np.percentile(np.abs(d), 99)), 1e-6)
    ink = np.where(d >= epsilon, 1.0, 1 + np.tanh(phi * (d - epsilon)))
    return 255 * np.clip(ink * (1 - tone + tone * v), 0, 1)


def edge_overlay(image, strength: float = 0.75, sigma: float = 1.0, gamma: float = 0.65) -> np.ndarray:
    """Edges by a difference of Gaussians, scaled to the 99th percentile, taken off."""
    d = np.abs(gaussian(image, sigma) - gaussian(image, sigma * 1.6))
    top = float(np.percentile(d, 99))
    return np.clip(image - 255 * strength * np.clip(d / max(top, 1e-6), 0, 1) ** gamma, 0, 255)


def line_drawing(image, levels: int = 4, smooth: float = 2.0) -> np.ndarray:
    """Boundaries of luminance bands, white on black."""
    v = gaussian(image, smooth)
    band = np.minimum((v / 256 * levels).astype(int), levels - 1)
    edge = np.zeros(band.shape, bool)
    edge[:, :-1] |= band[:, :-1] != band[:, 1:]
    edge[:-1] |= band[:-1] != band[1:]
    return np.where(edge, 255.0, 0.0)


def illumination(image, power: float = 0.7, sigma: float | None = None) -> np.ndarray:
    """Gain (mean / field)^power with a wide blur as the field."""
    field = np.maximum(gaussian(image, sigma or max(0.12 * min(np.shape(image)), 0.5)), 1)
    return np.clip(image * (field.mean() / field) ** power, 0, 255)


def artifact_mask(frames, threshold: float = 18.0, radius: int = 2, most: float = 0.04) -> np.ndarray | None:
    """Marks that stay while the scene moves: high-pass of the median, grown; None
    if they would cover too much."""
    median = np.median(np.asarray(frames, float), axis=0)
    mask = dilate(np.abs(median - gaussian(median, 2.0)) > threshold, radius)
    return None if mask.mean() > most else mask


def filled(image, mask) -> np.ndarray:
    """Masked pixels from the surroundings: a blur that leaves them out."""
    free = (~mask).astype(float)
    return np.where(mask, gaussian(image * free, 2.0) / np.maximum(gaussian(free, 2.0), 1e-6), image)


def motion_boxes(before, after, threshold: float = 18.0, least: float = 0.004, most: int = 6) -> list[dict]:
    """Boxes around what changed, largest first; more area, more confidence."""
    mask = closed(np.abs(np.asarray(after, float) - before) > threshold, 1)
    label, n = blobs(dilate(mask, 1))
    out = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(label == k)
        if len(ys) >= least * mask.size:
            w, h = int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
            out.append({"x": int(xs.min()), "y": int(ys.min()), "w": w, "h": h, "area": len(ys), "confidence": min(0.99, 0.4 + 3 * w * h / mask.size)})
    return sorted(out, key=lambda b: (-b["area"], b["y"], b["x"]))[:most]


def suppressed(boxes, scores, bound: float = 0.45) -> list[int]:
    """Greedy non-maximum suppression: indices kept, best first."""
    from ..streaming.machines import box_iou

    kept: list[int] = []
    for i in np.lexsort((np.arange(len(scores)), -np.asarray(scores, float))):
        if all(box_iou(boxes[i], boxes[k]) <= bound for k in kept):
            kept.append(int(i))
    return kept


def suppressed_groups(group, boxes, scores, order, bound: float = 0.45) -> tuple[np.ndarray, np.ndarray]:
    """``suppressed`` within each group of rows, all groups at once: indices kept,
    group by group and best first (of equal scores the least ``order``), and each
    one's turn from 1.

    A round keeps the best row that is left of every group and drops what it covers,
    so there are as many rounds as the most rows that one group keeps. Boxes without
    a place cover nothing.
    """
    sequence = rows = np.lexsort((order, -np.asarray(scores, float), group))
    g, b = np.asarray(group)[rows], np.asarray(boxes, float)[rows].T
    kept = np.zeros(len(g), bool)
    while len(rows):
        first = np.r_[True, g[1:] != g[:-1]]
        kept[rows[first]] = True
        best = b[:, np.flatnonzero(first)[np.cumsum(first) - 1]]
        wide, high = (np.minimum(b[k] + b[k + 2], best[k] + best[k + 2]) - np.maximum(b[k], best[k]) for k in (0, 1))
        both = wide * high
        union = np.maximum(0, b[2]) * np.maximum(0, b[3]) + np.maximum(0, best[2]) * np.maximum(0, best[3]) - both
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = ~first & ~((wide > 0) & (high > 0) & (union > 0) & (both / union > bound))
        rows, g, b = rows[stay], g[stay], b[:, stay]
    rows = sequence[kept[sequence]]
    g = np.asarray(group)[rows]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
    return rows, np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) + 1


def keypoints(image, most: int = 2000, patch: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Corners by Harris' measure with oriented binary descriptors of 256 bits
    (after Rublee et al.): places x, y and packed descriptors."""
    v = gaussian(image, 1.0)
    gy, gx = np.gradient(v)
    xx, xy, yy = (gaussian(p, 1.5) for p in (gx * gx, gx * gy, gy * gy))
    score = xx * yy - xy**2 - 0.04 * (xx + yy) ** 2
    peak = (score >= dilate(score, 1)) & (score > 1e-3 * max(float(score.max()), 1e-9))
    ys, xs = np.nonzero(peak)
    order = np.argsort(-score[ys, xs], kind="stable")[:most]
    ys, xs = ys[order], xs[order]
    pairs = np.random.default_rng(seed).integers(-patch, patch + 1, (256, 4))
    angle = np.arctan2(gy[ys, xs], gx[ys, xs])
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]

    def at(dx, dy):
        return bilinear(v, xs[:, None] + c * dx - s * dy, ys[:, None] + s * dx + c * dy)

    bits = at(pairs[:, 0], pairs[:, 1]) < at(pairs[:, 2], pairs[:, 3])
    return np.stack([xs, ys], axis=1), np.packbits(bits, axis=1)


def acuity_sigma(image, wanted: float, slack: float = 0.15, most: float = 8.0, steps: int = 8) -> float:
    """Blur that brings the variance of the Laplacian to ``wanted``, by bisection."""
    if laplacian(image).var() <= wanted:
        return 0.0
    low, high = 0.0, most
    for _ in range(steps):
        mid = (low + high) / 2
        got = laplacian(gaussian(image, max(mid, 0.05))).var()
        if abs(got - wanted) <= slack * wanted:
            return mid
        low, high = (mid, high) if got > wanted else (low, mid)
    return (low + high) / 2
