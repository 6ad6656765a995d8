"""Scalar expressions: everything here is a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name extensions that a scan accepts.
RASTER_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif")
RAW_EXTENSIONS = (".cr2", ".cr3", ".nef", ".arw", ".dng", ".raf", ".orf", ".rw2", ".pef")
SUPPORTED_EXTENSIONS = RASTER_EXTENSIONS + RAW_EXTENSIONS


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty without one.  A leading dot of a name starts no extension."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def is_supported(path: Column, extensions=SUPPORTED_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sigmoid(x: Column, center: float = 0.65, steepness: float = 8.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-steepness) * (x - F.lit(center))))


def area(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height.cast("bigint")


def size_ratio(a: Column, b: Column) -> Column:
    """Larger over smaller area; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def modification_hints(gray_a: Column, gray_b: Column, area_a: Column, area_b: Column, path_a: Column, path_b: Column) -> Column:
    """What probably happened between two images, in a fixed order."""
    gray = F.when(gray_a != gray_b, F.lit("grayscale")).when(gray_a & gray_b, F.lit("both_grayscale"))
    size = F.when(size_ratio(area_a, area_b) >= 1.25, F.lit("size_difference"))
    code = F.when(extension(path_a) != extension(path_b), F.lit("reencoded"))
    return F.array_compact(F.array(gray, size, code))


def base_score(ssim: Column, hist_corr: Column, lum_corr: Column, mse: Column, agreement: Column, one_gray: Column) -> Column:
    """Weighted similarity, sharpened.  A gray image beside a coloured one is compared by luminance."""
    gray = 0.50 * ssim + 0.20 * lum_corr + 0.20 * (1 - mse) + 0.10 * agreement
    colour = 0.35 * ssim + 0.25 * hist_corr + 0.25 * (1 - mse) + 0.15 * agreement
    return sigmoid(F.when(one_gray, gray).otherwise(colour))


def wants_crop_check(area_a: Column, area_b: Column, score: Column, via_tile: Column, via_orb: Column, ratio: float = 1.25, low: float = 0.35, high: float = 0.85) -> Column:
    """Pairs worth a crop check: found by a part, clearly different in size, or neither clearly alike nor clearly not."""
    return via_tile | via_orb | F.coalesce(size_ratio(area_a, area_b) >= ratio, F.lit(False)) | score.between(low, high)


def crop_alignment(ssim: Column, hist_corr: Column, mse: Column) -> Column:
    return 0.5 * ssim + 0.25 * hist_corr + 0.25 * (1 - mse)


def refined_score(alignment: Column, crop_score: Column, old: Column) -> Column:
    """Score after a crop was located; never below the old one."""
    return F.greatest(sigmoid(0.5 * alignment + 0.5 * crop_score, 0.55, 6.0), old)


def format_bytes(n: Column) -> Column:
    """Size with a binary unit; whole units, cut off rather than rounded."""
    step = lambda k: F.format_string("%d.0 %s", F.expr("0") + F.floor(n / F.lit(1024**k)), F.lit(("B", "KB", "MB", "GB", "TB")[k]))
    out = F.when(n < 1024, step(0))
    for k in (1, 2, 3):
        out = out.when(n < 1024 ** (k + 1), step(k))
    return out.otherwise(step(4))


def format_dimensions(width: Column, height: Column) -> Column:
    return F.concat_ws("×", width.cast("string"), height.cast("string"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.95, "bright_green").when(score >= 0.85, "green").when(score >= 0.70, "yellow").otherwise("red")


def signed64(hex_text: Column) -> Column:
    """A hash written as up to 16 hexadecimal digits, as a signed number."""
    text = F.lpad(hex_text, 16, "0")
    high, low = (F.conv(F.substring(text, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def hex64(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def cosine_of_units(a: Column, b: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
