"""Kernels against what their methods promise."""

import numpy as np
import pytest

from sightline.functions import kernels as K
from sightline.functions import tone
from sightline.operators import detectors

RNG = np.random.default_rng(3)
NOISE = RNG.integers(0, 256, (24, 32)).astype(float)
STEP = np.where(np.arange(32) < 16, 40.0, 200.0) * np.ones((24, 1))


def test_gaussian_keeps_the_mean_and_flat_areas():
    assert np.allclose(K.gaussian(np.full((9, 9), 7.0), 1.5), 7)
    spot = np.zeros((21, 21))
    spot[10, 10] = 1
    out = K.gaussian(spot, 2.0)
    assert out.sum() == pytest.approx(1) and out[10, 10] / out[10, 12] == pytest.approx(np.exp(0.5), rel=1e-6)


def test_unsharp_and_masks():
    keep = np.zeros(STEP.shape, bool)
    keep[:4] = True
    out = K.unsharp(STEP, keep=keep)
    assert (out[:4] == STEP[:4]).all() and out[10, 15] < 40 and out[10, 16] > 200
    hot = K.filled(np.where(keep, 255.0, 10.0), keep)
    assert np.allclose(hot[:4], 10, atol=1e-6)


def test_equalise_spreads_a_narrow_range():
    dull = 100 + NOISE / 16
    assert np.ptp(K.equalise(dull, clip=40, tiles=2)) > 5 * np.ptp(dull)


def test_mixture_learns_a_background():
    model = K.Mixture((6, 6))
    for _ in range(60):
        model.apply(np.full((6, 6), 90.0) + RNG.normal(0, 2, (6, 6)))
    frame = np.full((6, 6), 90.0)
    frame[2:4, 2:4] = 220
    front = model.apply(frame)
    assert front[2:4, 2:4].all() and front.sum() == 4


def test_flow_finds_a_shift():
    y, x = np.mgrid[:40, :40].astype(float)
    wave = lambda dx: 128 + 60 * np.sin((x - dx) / 4) + 40 * np.cos(y / 5 + (x - dx) / 9)
    u = K.flow(wave(0), wave(1.0), steps=12)
    assert np.median(u[8:-8, 8:-8, 0]) == pytest.approx(1.0, abs=0.15)
    assert abs(np.median(u[8:-8, 8:-8, 1])) < 0.1


def test_bilateral_keeps_edges():
    noisy = STEP + RNG.normal(0, 5, STEP.shape)
    out = K.bilateral(noisy)
    assert out[:, :15].std() < noisy[:, :15].std() / 2 and out[:, 17:].mean() - out[:, :15].mean() > 150


def test_lab_of_known_colours():
    assert np.allclose(K.to_lab([[255, 255, 255], [0, 0, 0]]), [[100, 0, 0], [0, 0, 0]], atol=0.02)
    assert np.allclose(K.to_lab([255, 0, 0]), [53.24, 80.09, 67.20], atol=0.05)


def test_superpixels_follow_edges():
    label = K.superpixels(STEP, size=8)
    assert not set(label[:, :14].ravel()) & set(label[:, 18:].ravel())


def test_morphology_and_blobs():
    m = np.zeros((8, 8), bool)
    m[1, 1] = m[2, 2] = m[6, 6] = True
    label, n = K.blobs(m)
    assert n == 2 and label[1, 1] == label[2, 2] != label[6, 6]
    assert K.dilate(m).sum() == 9 + 9 - 4 + 9
    assert (K.erode(K.dilate(m)) >= m).all() and (K.opened(m) <= m).all() and (K.closed(m) >= m).all()


def test_outlines():
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)]
    assert len(K.hull(square)) == 4
    tilted = np.array([(0, 1), (1, 0), (3, 2), (2, 3)])
    r = K.least_rectangle(tilted)
    assert np.hypot(*(r[1] - r[0])) * np.hypot(*(r[2] - r[1])) == pytest.approx(4.0)
    assert K.simplified([(0, 0), (1, 0.1), (2, 0), (3, 3)], 0.5).tolist() == [[0, 0], [2, 0], [3, 3]]


@pytest.mark.parametrize("kernel", [K.xdog, K.edge_overlay, K.line_drawing, K.illumination])
def test_drawings_stay_in_range(kernel):
    out = kernel(NOISE)
    assert out.shape == NOISE.shape and out.min() >= 0 and out.max() <= 255


def test_artifacts():
    frames = [RNG.normal(128, 3, (30, 30)) for _ in range(30)]
    assert not K.artifact_mask(frames).any()
    for f in frames:
        f[10, 10] = 250
    assert K.artifact_mask(frames)[10, 10]
    for f in frames:
        f[::4, ::4] = 250
    assert K.artifact_mask(frames) is None


def test_motion_and_suppression():
    after = np.zeros((48, 64))
    after[10:20, 30:40] = 255
    (box,) = detectors.detector("motion")(after, np.zeros((48, 64)))
    assert box["x"] <= 30 and box["y"] <= 10 and box["cls"] == "motion" and 0.4 < box["confidence"] <= 0.99
    assert detectors.detector("motion")(after, None) == [] and detectors.detector("bogus")(after, after) == []
    assert K.suppressed([(0, 0, 10, 10), (1, 0, 10, 10), (30, 0, 5, 5)], [0.5, 0.9, 0.1]) == [1, 2]


def test_decoding_of_model_rows():
    rows = np.array([[50, 50, 20, 20, 0.9, 0.1], [52, 50, 20, 20, 0.8, 0.1], [10, 10, 4, 4, 0.1, 0.7], [90, 90, 4, 4, 0.2, 0.1]])
    got = detectors.decode(rows, {0: "human"}, 0.35, 0.45)
    assert got == [{"cls": "human", "confidence": 0.9, "x": 40, "y": 40, "w": 20, "h": 20}]


def test_keypoints_match_after_a_shift():
    big = K.gaussian(RNG.integers(0, 256, (60, 60)).astype(float), 1.2)
    (pa, da), (pb, db) = K.keypoints(big[:50, :50], 80), K.keypoints(big[4:54, 3:53], 80)
    far = np.unpackbits(da[:, None] ^ db[None], axis=2).sum(axis=2)
    near = far.argmin(axis=1)
    sure = far.min(axis=1) < 20
    assert sure.sum() > 15 and (np.abs(pa[sure] - pb[near[sure]] - [3, 4]).max(axis=1) <= 1).mean() > 0.9


def test_acuity_blur():
    sigma = K.acuity_sigma(NOISE, K.laplacian(NOISE).var() / 10)
    assert K.laplacian(K.gaussian(NOISE, sigma)).var() == pytest.approx(K.laplacian(NOISE).var() / 10, rel=0.16)
    assert K.acuity_sigma(NOISE, 1e9) == 0


def test_tone_curves():
    assert tone.roll_off() == list(range(256))
    curve = tone.roll_off(threshold=200, ceiling=230, gamma=2.0)
    assert curve[200] == 200 and curve[255] == 230 and curve == sorted(curve)
    assert tone.tone(lift=20.0)[0] == 20 and tone.tone(lift=20.0)[110] == 110
    assert tone.gamma(1.0) == list(range(256))
