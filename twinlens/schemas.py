"""Tables of the engine.  Hashes are signed 64-bit numbers throughout; a distance is the popcount of their xor."""

from pyspark.sql import types as T

_HASHES = [T.StructField(n, T.LongType()) for n in ("phash", "dhash", "whash")]

FILE_LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("file_size", T.LongType()), T.StructField("mtime", T.DoubleType())])
IMAGE_RECORDS = T.StructType(
    [
        *FILE_LISTING.fields,
        *_HASHES,
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("is_raw", T.BooleanType()),
        T.StructField("scanned_at", T.DoubleType()),
        T.StructField("color_hist", T.ArrayType(T.FloatType())),
        T.StructField("tiles_computed", T.BooleanType()),
    ]
)
TILE_HASHES = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("tile_idx", "tx", "ty", "tw", "th")), *_HASHES])
CANDIDATE_PAIRS = T.StructType(
    [
        T.StructField("path_a", T.StringType()),
        T.StructField("path_b", T.StringType()),
        T.StructField("min_hash_dist", T.IntegerType()),
        T.StructField("hash_agreement", T.DoubleType()),
        T.StructField("via_tile", T.BooleanType()),
        T.StructField("via_orb", T.BooleanType()),
    ]
)
BBOX = T.StructType([T.StructField(n, T.IntegerType()) for n in "xywh"])
SCORED_PAIRS = T.StructType(
    [
        T.StructField("path_a", T.StringType()),
        T.StructField("path_b", T.StringType()),
        *(T.StructField(n, T.DoubleType()) for n in ("ssim", "histogram_corr", "normalized_mse", "crop_score")),
        T.StructField("crop_bbox", BBOX),
        T.StructField("final_score", T.DoubleType()),
        T.StructField("modification_hints", T.ArrayType(T.StringType())),
    ]
)
