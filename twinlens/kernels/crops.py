"""Where one image lies in another: template matching, and keypoints with a robust homography."""

from __future__ import annotations

import math

import numpy as np

from twinlens.kernels.pixels import resize

Box = tuple[int, int, int, int]


def sharpen(x: float, center: float, steepness: float) -> float:
    return 1 / (1 + math.exp(-steepness * (x - center)))


def scale_box(box: Box, from_shape: tuple[int, int], to_shape: tuple[int, int]) -> Box:
    """A box (x, y, w, h) in an image of another (height, width); fractions are cut off."""
    sy, sx = to_shape[0] / from_shape[0], to_shape[1] / from_shape[1]
    x, y, w, h = box
    return int(x * sx), int(y * sy), int(w * sx), int(h * sy)


def gray_of(image: np.ndarray) -> np.ndarray:
    return image.astype(float) if image.ndim == 2 else image[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def correlation_map(large: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of a template at every place, by FFT and summed-area tables."""
    h, w = small.shape
    template = small - small.mean()
    norm = math.sqrt(float((template**2).sum()))
    shape = (large.shape[0] + h - 1, large.shape[1] + w - 1)
    product = np.fft.irfft2(np.fft.rfft2(large, shape) * np.fft.rfft2(template[::-1, ::-1], shape), shape)[h - 1 : large.shape[0], w - 1 : large.shape[1]]

    def sums(x: np.ndarray) -> np.ndarray:
        s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        s[1:, 1:] = x.cumsum(0).cumsum(1)
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    spread = np.sqrt(np.maximum(sums(large**2) - sums(large) ** 2 / (h * w), 0))
    out = np.zeros_like(product)
    good = spread * norm > 1e-6 * h * w
    out[good] = product[good] / (spread[good] * norm)
    return np.clip(out, -1, 1)


def _best_place(large: np.ndarray, template: np.ndarray) -> tuple[float, Box]:
    """Greatest correlation of a template in a larger image, and its box."""
    found = correlation_map(large, template)
    y, x = np.unravel_index(int(found.argmax()), found.shape)
    return float(found[y, x]), (int(x), int(y), template.shape[1], template.shape[0])


def detect_template(large: np.ndarray, small: np.ndarray, scales=(1.0, 0.9, 0.8, 0.7)) -> tuple[float, Box | None]:
    """Confidence and box of the best match over some scales of the template; no box below a correlation of 0.4.

    Scales whose template has a side below 8 or doesn't fit are left out; of equal matches the first scale's counts.
    """
    a, b = gray_of(large), gray_of(small)
    sizes = [(int(b.shape[1] * s), int(b.shape[0] * s)) for s in scales]
    fitting = [size for size in sizes if min(size) >= 8 and size[0] <= a.shape[1] and size[1] <= a.shape[0]]
    templates = [b if size == b.shape[::-1] else resize(b, *size).astype(float) for size in fitting]
    best, box = max((_best_place(a, t) for t in templates), key=lambda m: m[0], default=(0.0, None))
    return (sharpen(best, 0.7, 8), box) if best >= 0.4 else (max(0.0, best), None)


def equalized(gray: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive equalisation of an 8-bit channel: tile-wise curves, blended between tile centres."""
    h, w = gray.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    curves = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            cell = gray[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            counts = np.bincount(cell.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * cell.size / 256)
            spare = np.maximum(counts - limit, 0).sum()
            curves[i, j] = np.cumsum(np.minimum(counts, limit) + spare / 256) * 255 / max(1, cell.size)
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda y, x: curves[y[:, None], x[None, :], gray]
    out = (1 - wy) * ((1 - wx) * at(y0, x0) + wx * at(y0, x1)) + wy * ((1 - wx) * at(y1, x0) + wx * at(y1, x1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


#: Linear sRGB to XYZ over the white point D65 (fixed values), rows X, Y, Z.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])
_BEND = 6 / 29


def evened(image: np.ndarray) -> np.ndarray:
    """Gray values of an image whose lightness (of L*a*b*) was equalised, colours kept."""
    rgb = (image if image.ndim == 3 else np.repeat(image[..., None], 3, 2))[..., :3].astype(float) / 255
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = linear @ _XYZ.T / _WHITE
    f = np.where(xyz > _BEND**3, np.cbrt(xyz), xyz / (3 * _BEND**2) + 4 / 29)
    lightness = 116 * f[..., 1] - 16
    new = equalized(np.clip(np.rint(lightness * 2.55), 0, 255).astype(np.uint8)) / 2.55
    f = f + ((new + 16) / 116 - f[..., 1])[..., None]  # a* and b* are differences to the middle one
    linear = np.where(f > _BEND, f**3, 3 * _BEND**2 * (f - 4 / 29)) * _WHITE @ np.linalg.inv(_XYZ).T
    linear = np.clip(linear, 0, 1)
    rgb = np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)
    return np.clip(np.rint(gray_of(rgb * 255)), 0, 255).astype(np.uint8)


#: A circle of 16 pixels with radius 3, clockwise from the top (dy, dx).
_ANGLES = np.arange(16) * np.pi / 8
CIRCLE = np.stack([-np.rint(3 * np.cos(_ANGLES)), np.rint(3 * np.sin(_ANGLES))], 1).astype(int)
_EDGE = 20


def _corners(gray: np.ndarray, most: int, threshold: int = 20) -> np.ndarray:
    """Places (y, x) where nine neighbouring circle pixels are all brighter or all darker, strongest first."""
    h, w = gray.shape
    if min(h, w) <= 2 * _EDGE + 2:
        return np.zeros((0, 2), int)
    g = gray.astype(int)
    ring = np.stack([g[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] for dy, dx in CIRCLE])
    centre = g[3 : h - 3, 3 : w - 3]
    strength = np.zeros(centre.shape)
    for difference in (ring - centre - threshold, centre - ring - threshold):
        run = np.stack([np.min(np.stack([difference[(k + s) % 16] for s in range(9)]), 0) for k in range(16)]).max(0)
        strength = np.maximum(strength, run)
    strength[: _EDGE - 3] = strength[3 - _EDGE :] = 0
    strength[:, : _EDGE - 3] = strength[:, 3 - _EDGE :] = 0
    padded = np.pad(strength, 1)
    peak = np.max(np.stack([padded[1 + dy : padded.shape[0] - 1 + dy, 1 + dx : padded.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]), 0)
    y, x = np.nonzero((strength > 0) & (strength == peak))
    order = np.argsort(-strength[y, x], kind="stable")[:most]
    return np.stack([y[order] + 3, x[order] + 3], 1)


_RNG = np.random.default_rng(7)
#: Pairs of places whose brightness is compared, drawn once around the centre.
_PATTERN = np.clip(_RNG.normal(0, 5, (256, 2, 2)), -12, 12)
_DISC = np.array([(dy, dx) for dy in range(-15, 16) for dx in range(-15, 16) if dy * dy + dx * dx <= 225])


def keypoints(gray: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) over a pyramid and their oriented binary descriptors (256 bits as bytes)."""
    places, descriptors = [], []
    level, scale = gray, 1.0
    share = max(8, most // 4)
    while min(level.shape) > 2 * _EDGE + 2 and scale < 4:
        at = _corners(level, share)
        if len(at):
            box = np.pad(level.astype(float), 2, mode="edge").cumsum(0).cumsum(1)
            box = np.pad(box, ((1, 0), (1, 0)))
            smooth = (box[5:, 5:] - box[:-5, 5:] - box[5:, :-5] + box[:-5, :-5]) / 25
            patch = level[at[:, 0, None] + _DISC[:, 0], at[:, 1, None] + _DISC[:, 1]].astype(float)
            angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
            c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            py, px = _PATTERN[None, :, :, 0], _PATTERN[None, :, :, 1]
            y = np.rint(s * px + c * py).astype(int) + at[:, 0, None, None]
            x = np.rint(c * px - s * py).astype(int) + at[:, 1, None, None]
            values = smooth[np.clip(y, 0, level.shape[0] - 1), np.clip(x, 0, level.shape[1] - 1)]
            descriptors.append(np.packbits(values[:, :, 0] < values[:, :, 1], axis=1))
            places.append(at[:, ::-1] * scale)
        scale *= 1.2
        level = resize(gray, max(1, round(gray.shape[1] / scale)), max(1, round(gray.shape[0] / scale)))
    if not places:
        return np.zeros((0, 2)), np.zeros((0, 32), np.uint8)
    return np.concatenate(places), np.concatenate(descriptors)


def _homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Least squares from points a to points b."""
    ma, mb = a.mean(0), b.mean(0)
    sa, sb = (max(1e-9, np.sqrt(((p - m) ** 2).sum(1)).mean() / math.sqrt(2)) for p, m in ((a, ma), (b, mb)))
    ta = np.array([[1 / sa, 0, -ma[0] / sa], [0, 1 / sa, -ma[1] / sa], [0, 0, 1]])
    tb = np.array([[1 / sb, 0, -mb[0] / sb], [0, 1 / sb, -mb[1] / sb], [0, 0, 1]])
    p, q = (a - ma) / sa, (b - mb) / sb
    one, zero = np.ones(len(p)), np.zeros((len(p), 3))
    left = np.c_[p, one]
    rows = np.concatenate([np.c_[left, zero, -q[:, :1] * left], np.c_[zero, left, -q[:, 1:] * left]])
    try:
        h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
        h = np.linalg.inv(tb) @ h @ ta
    except np.linalg.LinAlgError:
        return None
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.c_[points, np.ones(len(points))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return out[:, :2] / out[:, 2:]


def robust_homography(a: np.ndarray, b: np.ndarray, within: float = 5.0, rounds: int = 400, seed: int = 1) -> tuple[np.ndarray | None, np.ndarray]:
    """Homography that most pairs of points agree with to ``within`` pixels, and which do."""
    rng, best = np.random.default_rng(seed), np.zeros(len(a), bool)
    for _ in range(rounds):
        some = rng.choice(len(a), 4, replace=False)
        h = _homography(a[some], b[some])
        if h is None:
            continue
        d = project(h, a) - b
        good = (d**2).sum(1) <= within**2
        if good.sum() > best.sum():
            best = good
            if best.mean() > 0.95:
                break
    if best.sum() < 4:
        return None, best
    return _homography(a[best], b[best]), best


def plausible(h: np.ndarray | None, large: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """The small image, unmirrored, shrinks to 0.15-0.99 of its size and lands inside the large one, give or take 15 %."""
    if h is None or not np.isfinite(h).all():
        return False
    det = float(np.linalg.det(h[:2, :2]))
    if det <= 0 or not 0.15 <= math.sqrt(det) <= 0.99:
        return False
    corners = project(h, _corner_points(small))
    room = np.array([large[1], large[0]])
    return bool(np.isfinite(corners).all() and (corners >= -0.15 * room).all() and (corners <= 1.15 * room).all())


def _corner_points(shape: tuple[int, ...]) -> np.ndarray:
    h, w = shape[:2]
    return np.array([[0, 0], [w, 0], [w, h], [0, h]], float)


def box_of(h: np.ndarray, small: tuple[int, ...]) -> Box:
    """Upright hull of the small image's corners in the large one; may reach outside."""
    corners = project(h, _corner_points(small))
    (x0, y0), (x1, y1) = corners.min(0), corners.max(0)
    return int(x0), int(y0), int(x1 - x0), int(y1 - y0)


def detect_keypoints(large: np.ndarray, small: np.ndarray, features: int = 2000, ratio: float = 0.75, least: int = 15) -> tuple[float, Box | None]:
    """Confidence and box of the small image in the large one, by matched keypoints and a robust homography."""
    (pa, da), (pb, db) = (keypoints(evened(x), features) for x in (large, small))
    if len(pa) < 8 or len(pb) < 8:
        return 0.0, None
    pairs = []
    for at in range(0, len(db), 256):
        d = np.bitwise_count(db[at : at + 256, None, :] ^ da[None, :, :]).sum(2, dtype=np.int32)
        two = np.argpartition(d, 1, axis=1)[:, :2]
        dist = np.take_along_axis(d, two, 1)
        first = dist.argmin(1)
        rows = np.arange(len(d))
        near, next_ = dist[rows, first], dist[rows, 1 - first]
        good = near < ratio * next_
        pairs += [(at + i, int(two[i, first[i]])) for i in np.flatnonzero(good)]
    if len(pairs) < least:
        return len(pairs) / least * 0.3, None
    i, j = np.array(pairs).T
    h, inliers = robust_homography(pb[i], pa[j])
    n = int(inliers.sum())
    if h is None:
        return 0.1, None
    if n < least:
        return n / least * 0.4, None
    if not plausible(h, large.shape, small.shape):
        return 0.2, None
    return sharpen(n / len(pairs), 0.5, 6), box_of(h, small.shape)
