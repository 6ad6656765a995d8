import numpy as np
import pytest

from tests.images import picture
from twinlens.kernels import crops, pixels


def bits(a: int, b: int) -> int:
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_hashes_survive_scaling_and_tell_pictures_apart():
    a, b = picture(1), picture(2)
    small = pixels.resize(a, 300, 225)
    for x, y, z in zip(pixels.hashes(a), pixels.hashes(small), pixels.hashes(b), strict=True):
        assert -(2**63) <= x < 2**63
        assert bits(x, y) <= 6
        assert bits(x, z) > 12


def test_dct_and_bits_against_direct_sums():
    rng = np.random.default_rng(0)
    x = rng.random((32, 32))
    c = pixels._dct_matrix(32)
    k, m = 3, 5
    direct = sum(x[i, j] * 2 * np.cos(np.pi * k * (2 * i + 1) / 64) * 2 * np.cos(np.pi * m * (2 * j + 1) / 64) for i in range(32) for j in range(32))
    assert np.isclose((c @ x @ c.T)[k, m], direct)
    first = np.zeros((8, 8), bool)
    first[0, 0] = True
    assert pixels._packed(first) == -(2**63)
    first[0, 0], first[7, 7] = False, True
    assert pixels._packed(first) == 1


def test_histogram():
    solid = np.full((40, 30, 3), (128, 64, 32), np.uint8)
    h = pixels.color_histogram(solid)
    assert h.shape == (64,) and np.isclose(np.linalg.norm(h), 1) and (h > 0).sum() == 1
    # orange: hue 10 of 180, saturation 191, value 128
    assert h.argmax() == 0 * 16 + 2 * 4 + 2


def test_ssim_against_direct_windows():
    rng = np.random.default_rng(3)
    a, b = rng.random((12, 11, 3)), rng.random((12, 11, 3))
    x, y = a @ pixels.LUMA, b @ pixels.LUMA
    total = []
    for i in range(6):
        for j in range(5):
            p, q = x[i : i + 7, j : j + 7].ravel(), y[i : i + 7, j : j + 7].ravel()
            cov = np.cov(p, q)
            total.append((2 * p.mean() * q.mean() + 1e-4) * (2 * cov[0, 1] + 9e-4) / ((p.mean() ** 2 + q.mean() ** 2 + 1e-4) * (cov[0, 0] + cov[1, 1] + 9e-4)))
    assert np.isclose(pixels.ssim(a, b), np.clip(np.mean(total), 0, 1))
    assert pixels.ssim(a, a) == pytest.approx(1)
    with pytest.raises(ValueError):
        pixels.ssim(a[:4], b[:4])


def test_simple_metrics():
    a = np.zeros((10, 10, 3))
    assert pixels.normalized_mse(a, a + 1) == 1
    assert pixels.histogram_correlation(a, a) == 1
    tint = np.tile(np.random.default_rng(1).random((20, 20, 1)), 3) * 0.9 + np.array([0.0, 0.05, 0.1])
    assert pixels.is_grayscale(tint)
    rows = np.zeros((4, 4, 3))
    rows[::2, :, 0], rows[1::2, :, 1] = 1, 1
    assert not pixels.is_grayscale(rows)


def test_tiles():
    assert len(pixels.tiles(600, 500)) == 29
    assert len(pixels.tiles(100, 3000)) == 0
    number, x, y, w, h = pixels.tiles(601, 500)[1].tolist()
    assert (number, x, y, w, h) == (1, 300, 0, 301, 250)


def test_template_and_region():
    large = picture(5)
    small = large[100:220, 200:360]
    score, box = crops.detect_template(large, small)
    assert box == (200, 100, 160, 120) and score > 0.9
    assert crops.detect_template(small, large) == (0.0, None)
    assert crops.scale_box((10, 20, 100, 200), (500, 500), (1000, 1000)) == (20, 40, 200, 400)
    from twinlens.operators.scoring import compare_region

    ssim, hist, mse = compare_region(large, small, box)
    assert ssim > 0.99 and hist > 0.99 and mse < 0.01
    assert compare_region(large, small, (0, 0, 4, 4)) == (0.0, 0.0, 1.0)


def test_keypoints_find_a_zoomed_crop():
    large = picture(9, 900, 700)
    part = large[150:600, 250:800]
    assert crops.detect_keypoints(large, pixels.resize(part, 330, 270)) == (0.2, None)  # a crop isn't shrunk
    small = pixels.resize(part, 770, 630)
    score, box = crops.detect_keypoints(large, small)
    assert box is not None and score > 0.5
    x, y, w, h = box
    ix = max(0, min(x + w, 800) - max(x, 250)) * max(0, min(y + h, 600) - max(y, 150))
    assert ix / (w * h + 550 * 450 - ix) > 0.7
    assert crops.detect_keypoints(np.zeros((200, 200, 3), np.uint8), small) == (0.0, None)


def test_homography_rules():
    shape = (100, 100)
    half = np.diag([0.5, 0.5, 1.0])
    assert crops.plausible(half, (200, 200), shape)
    assert not crops.plausible(np.eye(3), (200, 200), shape)
    assert not crops.plausible(np.diag([0.05, 0.05, 1.0]), (200, 200), shape)
    assert not crops.plausible(np.diag([-0.5, 0.5, 1.0]), (200, 200), shape)
    assert crops.box_of(half, shape) == (0, 0, 50, 50)


def test_lightness_is_evened_and_colours_stay():
    gray = np.random.default_rng(0).integers(100, 121, (512, 512)).astype(np.uint8)  # little contrast within each cell
    out = crops.evened(np.repeat(gray[..., None], 3, 2))
    assert out.std() > 1.5 * gray.std() and (crops.evened(gray) == out).all()
    coloured = picture(3, 160, 120)
    assert crops.evened(coloured).shape == (120, 160) and abs(int(crops.evened(np.full((64, 64, 3), 255, np.uint8)).mean()) - 255) <= 2
