"""Pixel arithmetic: resampling, colour, hashes, histograms, similarity."""

from __future__ import annotations

import numpy as np

LUMA = np.array([0.299, 0.587, 0.114])


def _filter_matrix(size: int, new: int) -> np.ndarray:
    """Lanczos (3 lobes) weights, widened when shrinking: new x size."""
    scale = size / new
    reach = 3 * max(1.0, scale)
    centre = (np.arange(new) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / max(1.0, scale)
    w = np.where(np.abs(x) * max(1.0, scale) <= reach, np.sinc(x) * np.sinc(x / 3), 0.0)
    w[np.abs(x) >= 3] = 0
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos resampling of an 8-bit image, rounded to 8 bits after each direction."""
    out = image.astype(np.float64)
    if image.shape[1] != width:
        out = np.clip(np.rint(np.einsum("ws,hs...->hw...", _filter_matrix(image.shape[1], width), out)), 0, 255)
    if image.shape[0] != height:
        out = np.clip(np.rint(np.einsum("hs,sw...->hw...", _filter_matrix(image.shape[0], height), out)), 0, 255)
    return out.astype(np.uint8)


def shrink_area(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean over each target pixel's area."""

    def weights(size: int, new: int) -> np.ndarray:
        edge = np.arange(new + 1) * size / new
        low, high = np.maximum(edge[:-1, None], np.arange(size)[None, :]), np.minimum(edge[1:, None], np.arange(size)[None, :] + 1)
        w = np.maximum(high - low, 0)
        return w / w.sum(1, keepdims=True)

    out = np.einsum("hs,sw...->hw...", weights(image.shape[0], height), image.astype(float))
    out = np.einsum("ws,hs...->hw...", weights(image.shape[1], width), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def gray8(rgb: np.ndarray) -> np.ndarray:
    """Luminance as 8-bit integers (fixed-point weights in 65536ths)."""
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def _packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel()[:64].astype(np.uint8)).view(">i8")[0])


def _dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    return 2 * np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def phash(gray: np.ndarray) -> int:
    """Signs of the 8 x 8 lowest frequencies of a 32 x 32 copy against their median."""
    return phash_of_square(resize(gray, 32, 32))


def phash_of_square(square: np.ndarray) -> int:
    """The same of a square copy whose pixels stand for equal parts of the 32 x 32.

    Equal pixels share one weight and sums run left to right, then down, as in the SQL: where the two middle frequencies
    are equal, the rounding of these sums decides.
    """
    side = len(square)
    waves = _dct_matrix(32)[:8].reshape(8, side, 32 // side).sum(2)
    rows = (square[:, None, :] * waves).cumsum(2)[:, :, -1]
    low = (waves[:, :, None] * rows).cumsum(1)[:, -1]
    return _packed(low > np.median(low))


def dhash(gray: np.ndarray) -> int:
    """Brighter than the left neighbour, on a copy of 9 x 8."""
    small = resize(gray, 9, 8).astype(int)
    return _packed(small[:, 1:] > small[:, :-1])


def whash(gray: np.ndarray) -> int:
    """Low-pass Haar coefficients at 8 x 8 without the overall mean, against their median."""
    side = 1 << max(3, int(np.log2(max(1, min(gray.shape)))))
    square = resize(gray, side, side) / 255.0
    step = side // 8
    blocks = square.reshape(8, step, 8, step).mean((1, 3))
    low = np.round(blocks - blocks.mean(), 12)
    return _packed(low > np.median(low))


def hashes(rgb: np.ndarray) -> tuple[int, int, int]:
    """Perceptual, difference and wavelet hash as signed 64-bit numbers."""
    gray = rgb if rgb.ndim == 2 else gray8(rgb)
    return phash(gray), dhash(gray), whash(gray)


def hsv8(rgb: np.ndarray) -> np.ndarray:
    """8-bit hue (0-179), saturation and value."""
    x = rgb.astype(float)
    value, least = x.max(-1), x.min(-1)
    spread = value - least
    with np.errstate(divide="ignore", invalid="ignore"):
        saturation = np.where(value > 0, spread / value * 255, 0)
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        hue = np.where(value == r, (g - b) / spread, np.where(value == g, 2 + (b - r) / spread, 4 + (r - g) / spread)) * 30
    hue = np.where(spread > 0, np.where(hue < 0, hue + 180, hue), 0)
    return np.stack([np.rint(hue) % 180, np.rint(saturation), value], -1).astype(np.uint8)


def color_histogram(rgb: np.ndarray) -> np.ndarray:
    """4 x 4 x 4 bins of hue, saturation and value, of unit length; place = hue * 16 + saturation * 4 + value."""
    hsv = hsv8(rgb).reshape(-1, 3).astype(int)
    place = hsv[:, 0] // 45 * 16 + hsv[:, 1] // 64 * 4 + hsv[:, 2] // 64
    counts = np.bincount(place, minlength=64).astype(np.float32)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


def luminance(image: np.ndarray) -> np.ndarray:
    return image @ LUMA


def _box(x: np.ndarray, n: int) -> np.ndarray:
    """Means of all n x n windows, by a summed-area table."""
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    s[1:, 1:] = x.cumsum(0).cumsum(1)
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Structural similarity of two RGB images in 0..1, on luminance, clipped to 0..1.

    Uniform windows, sample covariance, constants 0.01 and 0.03; windows lie wholly inside.
    """
    x, y = luminance(a), luminance(b)
    if min(x.shape) < window:
        raise ValueError(f"a side is shorter than {window} pixels")
    n = window * window
    mx, my = _box(x, window), _box(y, window)
    fix = n / (n - 1)
    vx, vy, vxy = fix * (_box(x * x, window) - mx * mx), fix * (_box(y * y, window) - my * my), fix * (_box(x * y, window) - mx * my)
    c1, c2 = 0.01**2, 0.03**2
    s = ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    return float(np.clip(s.mean(), 0, 1))


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of the 64-bin histograms of two channels; equal flat ones correlate fully."""
    ha, hb = (np.bincount((np.clip(c, 0, 1) * 255).astype(np.uint8).ravel() // 4, minlength=64).astype(float) for c in (a, b))
    da, db = ha - ha.mean(), hb - hb.mean()
    norm = np.sqrt((da @ da) * (db @ db))
    return float(da @ db / norm) if norm > 0 else 1.0


def histogram_correlation(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.clip(np.mean([_correlation(a[..., k], b[..., k]) for k in range(3)]), 0, 1))


def luminance_correlation(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.clip(_correlation(luminance(a), luminance(b)), 0, 1))


def normalized_mse(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.clip(np.mean((a - b) ** 2), 0, 1))


def is_grayscale(image: np.ndarray, most: float = 0.02) -> bool:
    """Channels move together; a uniform tint counts as gray."""
    return bool(np.std(image[..., 0] - image[..., 1]) < most and np.std(image[..., 0] - image[..., 2]) < most)


def tiles(width: int, height: int, grids=(2, 3, 4), least: int = 64) -> np.ndarray:
    """Tiles as rows (number, x, y, w, h): n x n cells per grid, numbered row by row through all grids.

    A cell is the side's n-th part cut off to whole pixels; the last row and column take what is left over.  Grids whose
    cells have a side below ``least`` are left out and take no numbers.
    """
    out = np.zeros((0, 5), np.int64)
    for n in (n for n in grids if min(width, height) // n >= least):
        row, col = np.divmod(np.arange(n * n), n)
        edges = [np.r_[np.arange(n) * (side // n), side] for side in (width, height)]
        low, high = (np.stack([edges[0][col + k], edges[1][row + k]], 1) for k in (0, 1))
        out = np.concatenate([out, np.c_[len(out) + np.arange(n * n), low, high - low]])
    return out
