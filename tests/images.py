"""PNG files from arrays, and generated pictures."""

import struct
import zlib

import numpy as np


def write_png(path, image: np.ndarray) -> None:
    kind = {2: 0, 3: 2, 4: 6}[3 if image.ndim == 3 and image.shape[2] == 3 else 4 if image.ndim == 3 else 2]
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b""))


def picture(seed: int, width: int = 600, height: int = 450) -> np.ndarray:
    """Random rectangles on a gradient: many corners, no two pictures alike."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    tint = rng.random((2, 3))
    out = 255 * (x[..., None] / width * tint[0] + y[..., None] / height * tint[1]) / 2
    for _ in range(160):
        w, h = rng.integers(8, width // 5), rng.integers(8, height // 5)
        cx, cy = rng.integers(0, width - w), rng.integers(0, height - h)
        out[cy : cy + h, cx : cx + w] = rng.integers(0, 256, 3)
    return out.astype(np.uint8)
