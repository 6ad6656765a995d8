"""The engine's operators as queries over the driver's tables, each with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions import expressions as X
from twinlens.operators import candidates as C
from twinlens.operators import groups as G
from twinlens.plans.fixture import DUCK_RECORDS, SPARK_RECORDS
from twinlens.sources import store
from twinlens.sources.scratch import written

#: Score from which the queries group pairs.
MIN_SCORE = 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_RECORDS.replace("from embeddings", "from {embeddings}"), embeddings=table(spark, sf_dir, "embeddings"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile per original image, filed under the image seven further on, two bits off."""
    parent = F.concat(F.lit("/img/"), (F.col("vec_id") + 7).cast("string"), F.lit("_0.jpg"))
    off = [F.col(c).bitwiseXOR(F.lit(3).cast("bigint")).alias(c) for c in C.THRESHOLDS]
    return records(spark, sf_dir).where("k = 0").select(parent.alias("path"), F.lit(0).alias("tile_idx"), *off)


DUCK_TILES = "select concat('/img/', cast(vec_id + 7 as varchar), '_0.jpg') as path, 0 as tile_idx, xor(phash, 3::bigint) as phash, xor(dhash, 3::bigint) as dhash, xor(whash, 3::bigint) as whash from image_records where k = 0"
DUCK_FULL = """
select path_a, path_b, cast(list_min([x for x in [case when dp <= 10 then dp end, case when dd <= 10 then dd end, case when dw <= 12 then dw end] if x is not null]) as int) as min_hash_dist,
  ((dp <= 10)::int + (dd <= 10)::int + (dw <= 12)::int) / 3.0::double as hash_agreement, false as via_tile, false as via_orb
from (select a.path as path_a, b.path as path_b, bit_count(xor(a.phash, b.phash))::int as dp, bit_count(xor(a.dhash, b.dhash))::int as dd, bit_count(xor(a.whash, b.whash))::int as dw
  from image_records a join image_records b on a.path < b.path) where dp <= 10 or dd <= 10 or dw <= 12
"""
DUCK_TILE_PAIRS = """
select path_a, path_b, cast(min(d) as int) as min_hash_dist, 1 / 3.0::double as hash_agreement, true as via_tile, false as via_orb from (
  select least(r.path, t.path) as path_a, greatest(r.path, t.path) as path_b,
    unnest([case when bit_count(xor(r.phash, t.phash)) <= 10 then bit_count(xor(r.phash, t.phash))::int end,
      case when bit_count(xor(r.dhash, t.dhash)) <= 10 then bit_count(xor(r.dhash, t.dhash))::int end,
      case when bit_count(xor(r.whash, t.whash)) <= 12 then bit_count(xor(r.whash, t.whash))::int end]) as d
  from image_records r join tiles t on r.path <> t.path)
where d is not null and not exists (select 1 from full_pairs f where f.path_a = least(x.path_a, x.path_b) and f.path_b = x.path_b) group by path_a, path_b
""".replace(")\nwhere d is", ") x\nwhere d is").replace("f.path_a = least(x.path_a, x.path_b)", "f.path_a = x.path_a")
_ROUNDED = "round({}, 6)"


def _with(body: str, *names: str) -> str:
    """SQL over the stand-in tables it names."""
    known = {"image_records": DUCK_RECORDS, "tiles": DUCK_TILES, "full_pairs": DUCK_FULL, "tile_pairs": DUCK_TILE_PAIRS, "metrics": DUCK_METRICS, "scored_pairs": DUCK_SCORED, "edges": DUCK_EDGES, "members": DUCK_MEMBERS}
    needs = {"tiles": ["image_records"], "full_pairs": ["image_records"], "tile_pairs": ["full_pairs", "tiles"], "metrics": ["full_pairs"], "scored_pairs": ["metrics"], "edges": ["scored_pairs"], "members": ["edges"]}
    order: list[str] = []

    def add(name: str) -> None:
        for n in needs.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    recursive = "recursive " if "members" in order else ""
    return f"with {recursive}" + ", ".join(f"{n} as ({known[n]})" for n in order) + body


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs with metrics that follow from their distance, as if pixels had been compared."""
    r = records(spark, sf_dir)
    pairs = C.with_records(C.hash_candidates(r), r, ["file_size", "mtime", "width", "height"])
    d = F.col("min_hash_dist")
    return pairs.select(
        "*", (1 - d / 64).alias("ssim"), (1 - d / 32).alias("hist_corr"), (1 - d / 40).alias("lum_corr"), (d / 200).alias("mse"),
        (F.col("file_size_a") % 3 == 0).alias("gray_a"), (F.col("file_size_b") % 4 == 0).alias("gray_b"),
    )


DUCK_METRICS = """
select f.*, a.file_size as file_size_a, b.file_size as file_size_b, a.width::bigint * a.height as area_a, b.width::bigint * b.height as area_b,
  1 - min_hash_dist / 64.0::double as ssim, 1 - min_hash_dist / 32.0::double as hist_corr, 1 - min_hash_dist / 40.0::double as lum_corr, min_hash_dist / 200.0::double as mse,
  a.file_size % 3 = 0 as gray_a, b.file_size % 4 = 0 as gray_b
from full_pairs f join image_records a on a.path = path_a join image_records b on b.path = path_b
"""


def _score() -> F.Column:
    return X.base_score(F.col("ssim"), F.col("hist_corr"), F.col("lum_corr"), F.col("mse"), F.col("hash_agreement"), F.col("gray_a") != F.col("gray_b"))


_DUCK_SCORE = """1 / (1 + exp(-8 * (case when gray_a <> gray_b then 0.5 * ssim + 0.2 * lum_corr + 0.2 * (1 - mse) + 0.1 * hash_agreement
  else 0.35 * ssim + 0.25 * hist_corr + 0.25 * (1 - mse) + 0.15 * hash_agreement end::double - 0.65::double)))"""
DUCK_SCORED = f"select *, round({_DUCK_SCORE}, 6) as final_score from metrics"
DUCK_EDGES = f"select path_a as u, path_b as v from scored_pairs where final_score >= {MIN_SCORE} union select path_b, path_a from scored_pairs where final_score >= {MIN_SCORE}"
DUCK_MEMBERS = "select u as path, min(r) as component from (with recursive reach(u, r) as (select u, u from edges union select e.v, reach.r from reach join edges e on e.u = reach.u) select u, r from reach) group by u"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: reports and groups use scored pairs several times."""
    return written(metrics(spark, sf_dir).withColumn("final_score", F.round(_score(), 6)))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return note


_PAIR = "path_a, path_b, min_hash_dist::bigint as min_hash_dist, round(hash_agreement, 6) as hash_agreement, via_tile, via_orb"


def _pair(df: DataFrame) -> DataFrame:
    return df.select("path_a", "path_b", F.col("min_hash_dist").cast("bigint").alias("min_hash_dist"), F.round("hash_agreement", 6).alias("hash_agreement"), "via_tile", "via_orb")


@_query(_with(f" select {_PAIR} from full_pairs", "full_pairs"))
def hamming_candidates(spark, sf_dir):
    return _pair(C.hash_candidates(records(spark, sf_dir)))


@_query(ORACLE_SQL["hamming_candidates"])
def hamming_candidates_banded(spark, sf_dir):
    return _pair(C.hash_candidates(records(spark, sf_dir), nested_rows=0))


@_query(_with(f" select {_PAIR} from tile_pairs", "tile_pairs"))
def tile_candidates(spark, sf_dir):
    r = records(spark, sf_dir)
    return _pair(C.tile_candidates(r, tiles(spark, sf_dir), C.hash_candidates(r)))


@_query(_with(f" select {_PAIR} from full_pairs union all select {_PAIR} from tile_pairs", "tile_pairs"))
def all_candidates(spark, sf_dir):
    return _pair(C.query_candidates(records(spark, sf_dir), tiles(spark, sf_dir)))


_MISMATCH = """from (select path, width::bigint * height as area, color_hist from image_records) s join (select path, width::bigint * height as area, color_hist from image_records) l
on l.area >= 4 * s.area and s.area > 0 and (s.area, s.path) < (l.area, l.path) where not exists (select 1 from full_pairs f where f.path_a = least(s.path, l.path) and f.path_b = greatest(s.path, l.path))"""


@_query(_with(f" select s.path as small_path, l.path as large_path {_MISMATCH}", "full_pairs"))
def size_mismatch_pairs(spark, sf_dir):
    r = records(spark, sf_dir)
    return C.size_mismatches(r, C.hash_candidates(r)).select("small_path", "large_path")


@_query(_with(f""" select small_path, large_path, round(similarity, 6) as similarity from (select s.path as small_path, l.path as large_path,
list_dot_product(s.color_hist::double[], l.color_hist::double[]) as similarity, row_number() over (partition by s.path order by list_dot_product(s.color_hist::double[], l.color_hist::double[]) desc, l.path) as place {_MISMATCH}) where place <= 20""", "full_pairs"))  # fmt: skip
def color_prefilter_topk(spark, sf_dir):
    r = records(spark, sf_dir)
    return C.size_mismatch_candidates(r, C.hash_candidates(r)).select("small_path", "large_path", F.round("similarity", 6).alias("similarity"))


def _listing(r: DataFrame) -> DataFrame:
    """What a second scan finds: some files are new, some have changed."""
    return r.select(F.when(F.col("vec_id") % 11 == 0, F.concat("path", F.lit(".new.jpg"))).otherwise(F.col("path")).alias("path"), "file_size", F.when(F.col("vec_id") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"))


_DUCK_LISTING = "select case when vec_id % 11 = 0 then path || '.new.jpg' else path end as path, file_size, case when vec_id % 7 = 0 then mtime + 1 else mtime end as mtime from image_records"


@_query(_with(f""", listing as ({_DUCK_LISTING}) select l.path, l.file_size, l.mtime,
coalesce(r.color_hist is not null and (r.width::bigint * r.height < 250000 or t.path is not null), false) as cached
from listing l left join image_records r on r.path = l.path and r.file_size = l.file_size and r.mtime = l.mtime left join (select distinct path from tiles) t on t.path = l.path""", "tiles"))  # fmt: skip
def cache_diff(spark, sf_dir):
    r = records(spark, sf_dir)
    return store.cache_status(_listing(r), r, tiles(spark, sf_dir))


@_query(_with(f""", listing as ({_DUCK_LISTING}), fresh as (select * from listing where path like '%.new.jpg' or file_size % 2 = 0)
select path, file_size, mtime from fresh union all select path, file_size, mtime from image_records where path not in (select path from fresh)""", "image_records"))  # fmt: skip
def cache_upsert(spark, sf_dir):
    r = records(spark, sf_dir)
    fresh = _listing(r).where("path like '%.new.jpg' or file_size % 2 = 0").withColumn("scanned_at", F.lit(2.0))
    return store.upserted(r.select("path", "file_size", "mtime", F.lit(1.0).alias("scanned_at")), fresh).drop("scanned_at")


_EXT = ", ".join(f"'{x}'" for x in X.SUPPORTED_EXTENSIONS)
_RAW = ", ".join(f"'{x}'" for x in X.RAW_EXTENSIONS)
_ENDINGS = "['.JPG', '.cr2', '.html', '', '.tar.PNG', '.NEF', '.jpeg']"


@_query(f"""with f as (select concat(regexp_replace(url, '[.]+', '_', 'g'), {_ENDINGS}[(page_id % 7 + 1)::int]) as path from pages),
e as (select path, lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]*)$', 1)) as extension from f) select path, extension, extension in ({_EXT}) as supported, extension in ({_RAW}) as raw from e""")  # fmt: skip
def supported_files(spark, sf_dir):
    endings = F.array(*(F.lit(x) for x in (".JPG", ".cr2", ".html", "", ".tar.PNG", ".NEF", ".jpeg")))
    path = F.concat(F.regexp_replace("url", "[.]+", "_"), F.get(endings, (F.col("page_id") % 7).cast("int")))
    f = table(spark, sf_dir, "pages").select(path.alias("path"))
    return f.select("path", X.extension(F.col("path")).alias("extension"), X.is_supported(F.col("path")).alias("supported"), X.is_raw(F.col("path")).alias("raw"))


@_query(_with(""", g as (select path, width as w, height as h, n, width // n as tw, height // n as th from image_records, (values (2), (3), (4)) grid(n) where width::bigint * height >= 250000),
cells as (select *, cy, cx from g, range(0, 4) y(cy), range(0, 4) x(cx) where tw >= 64 and th >= 64 and cy < n and cx < n)
select path, (row_number() over (partition by path order by n, cy, cx) - 1)::bigint as tile_idx, (cx * tw)::bigint as tx, (cy * th)::bigint as ty,
(case when cx = n - 1 then w - cx * tw else tw end)::bigint as tw, (case when cy = n - 1 then h - cy * th else th end)::bigint as th from cells""", "image_records"))  # fmt: skip
def tile_geometry(spark, sf_dir):
    from twinlens.operators.features import tile_regions

    return tile_regions(records(spark, sf_dir)).select("path", *(F.col(c).cast("bigint").alias(c) for c in ("tile_idx", "tx", "ty", "tw", "th")))


# Kernels on images made of vectors: pixels of a, and of b, the next vector, both about 0.5; eight pixels a row.
_IMAGES = """images as (select a.vec_id::varchar as path, a.embedding::double[] as e, [0.5::double + 2 * x::double for x in a.embedding] as a, [0.5::double + 2 * x::double for x in b.embedding] as b
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
p as (select path, i, a[i + 1] as x, b[i + 1] as y from (select *, unnest(range(0, 64)) as i from images))"""


def _images(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    shade = lambda c: F.transform(c, lambda x: F.lit(0.5) + 2 * x.cast("double"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), shade("embedding").alias("b"))
    return e.join(other, "vec_id").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").cast("array<double>").alias("e"), shade("embedding").alias("a"), "b")


def _coloured(images: DataFrame) -> DataFrame:
    """Each gray value three times, as red, green and blue."""
    return images.select("path", *(F.flatten(F.transform(c, lambda x: F.array(x, x, x))).alias(c) for c in ("a", "b") if c in images.columns))


def _kernel(images: DataFrame, kernel, shape: tuple[int, ...], name: str, digits: int = 6) -> DataFrame:
    from twinlens.operators.features import kernel_values

    return kernel_values(images, kernel, shape).select("path", F.round("value", digits).alias(name))


@_query(f"with {_IMAGES} select path, round(least(1, greatest(0, avg((x - y) * (x - y)))), 6) as mse from p group by path")
def pixel_mse(spark, sf_dir):
    from twinlens.kernels import pixels

    return _kernel(_coloured(_images(spark, sf_dir)), pixels.normalized_mse, (8, 8, 3), "mse")


@_query(f"with {_IMAGES} select path, stddev_pop(0.16::double * (y - 0.5::double)) < 0.04 as gray from p group by path")
def pixel_grayscale(spark, sf_dir):
    """Green and blue leave red by a part of another vector; half the usual spread is allowed for."""
    from twinlens.kernels import pixels
    from twinlens.operators.features import kernel_values

    off = lambda x, y, sign: x + sign * 0.08 * (y - 0.5)
    pixel = F.zip_with("a", "b", lambda x, y: F.array(x, off(x, y, 1), off(x, y, -1)))
    images = _images(spark, sf_dir).select("path", F.flatten(pixel).alias("a"))
    return kernel_values(images, pixels.is_grayscale, (8, 8, 3), "bool").select("path", F.col("value").alias("gray"))


_BINS = """bins as (select path, bin, count(*) filter (where floor(floor(least(1, greatest(0, x)) * 255) / 4) = bin) as m, count(*) filter (where floor(floor(least(1, greatest(0, y)) * 255) / 4) = bin) as n
from p, (select unnest(range(0, 64)) as bin) group by path, bin)"""


@_query(f"with {_IMAGES}, {_BINS} select path, round(least(1, greatest(0, corr(m, n))), 6) as corr from bins group by path")
def pixel_hist_corr(spark, sf_dir):
    from twinlens.kernels import pixels

    return _kernel(_coloured(_images(spark, sf_dir)), pixels.histogram_correlation, (8, 8, 3), "corr")


@_query(f"""with {_IMAGES}, w as (select path, wi, wj, avg(x) as mx, avg(y) as my, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as c
from p, range(0, 2) r(wi), range(0, 2) s(wj) where i // 8 between wi and wi + 6 and i % 8 between wj and wj + 6 group by path, wi, wj)
select path, round(least(1, greatest(0, avg((2 * mx * my + 0.0001::double) * (2 * c + 0.0009::double) / ((mx * mx + my * my + 0.0001::double) * (vx + vy + 0.0009::double))))), 6) as ssim from w group by path""")  # fmt: skip
def pixel_ssim(spark, sf_dir):
    from twinlens.kernels import pixels

    return _kernel(_coloured(_images(spark, sf_dir)), pixels.ssim, (8, 8, 3), "ssim")


#: Bits, the first one highest, as a signed number.
_SIGNED = "(sum(case when bit then 1::hugeint << (63 - place) else 0 end) - case when bool_or(bit and place = 0) then 1::hugeint << 64 else 0 end)::bigint"
_GRAY = "g as (select vec_id::varchar as path, [least(255, greatest(0, round((x + 0.5) * 255)))::int for x in embedding] as pixels from embeddings)"


@_query(f"""with {_GRAY}, q as (select path, i, list_concat(pixels, pixels[1:8])[i + 1] as v from (select *, unnest(range(0, 72)) as i from g)),
b as (select q.path, r.v > q.v as bit, q.i // 9 * 8 + q.i % 9 as place from q join q r on r.path = q.path and r.i = q.i + 1 where q.i % 9 < 8) select path, {_SIGNED} as value from b group by path""")  # fmt: skip
def dhash_kernel(spark, sf_dir):
    """Nine by eight pixels, so that nothing is resampled."""
    from twinlens.kernels import pixels
    from twinlens.operators.features import kernel_values

    images = _gray(spark, sf_dir).select("path", F.concat("pixels", F.slice("pixels", 1, 8)).alias("a"))
    return kernel_values(images, lambda a: pixels.dhash(a.astype("uint8")), (8, 9), "int64")


def _enlarged(kernel):
    """Each pixel four by four times: 32 by 32, so that nothing is resampled."""
    import numpy as np

    return lambda a: kernel(np.kron(a, np.ones((4, 4))).astype("uint8"))


@_query(f"""with {_GRAY}, waves as (select k, c, sum(2 * cos(pi() * k * (2 * (4 * c + d) + 1) / 64)) as w from range(0, 8) r(k), range(0, 8) s(c), range(0, 4) t(d) group by k, c),
q as (select path, i // 8 as y, i % 8 as x, pixels[i + 1] as v from (select *, unnest(range(0, 64)) as i from g)),
rows as (select path, y, k, sum(v * w) as s from q join waves on c = x group by path, y, k), low as (select path, u.k as ky, rows.k as kx, sum(s * w) as f from rows join waves u on u.c = y group by path, u.k, rows.k),
b as (select path, f > median(f) over (partition by path) as bit, ky * 8 + kx as place from low) select path, {_SIGNED} as value from b group by path""")  # fmt: skip
def phash_kernel(spark, sf_dir):
    """Each pixel stands for four by four of the 32 by 32, so that nothing is resampled."""
    from twinlens.kernels import pixels
    from twinlens.operators.features import kernel_values

    return kernel_values(_gray(spark, sf_dir).withColumnRenamed("pixels", "a"), pixels.phash_of_square, (8, 8), "int64")


@_query(f"""with {_GRAY}, q as (select path, i as place, pixels[i + 1] as v from (select *, unnest(range(0, 64)) as i from g)),
b as (select path, place, v > median(v) over (partition by path) as bit from q) select path, {_SIGNED} as value from b group by path""")
def whash_kernel(spark, sf_dir):
    from twinlens.kernels import pixels
    from twinlens.operators.features import kernel_values

    return kernel_values(_gray(spark, sf_dir).withColumnRenamed("pixels", "a"), _enlarged(pixels.whash), (8, 8), "int64")


_COLOURS = """c as (select a.vec_id::varchar as path, unnest(range(0, 64)) as i, a.embedding as ea, b.embedding as eb, d.embedding as ed from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 join embeddings d on d.vec_id = a.vec_id + 2),
rgb as (select path, i, [least(255, greatest(0, round((x[i + 1] + 0.25) * 500)))::int for x in [ea, eb, ed]] as t from c), v as (select path, i, t[1] as r, t[2] as g, t[3] as b, list_max(t) as v, list_max(t) - list_min(t) as d from rgb),
h as (select path, v, case when v > 0 then round_even(d / v::double * 255, 0) else 0 end as s,
case when d = 0 then 0 else case when v = r then (g - b) / d::double when v = g then 2 + (b - r) / d::double else 4 + (r - g) / d::double end * 30 end as hue from v),
n as (select path, floor(round_even(case when hue < 0 then hue + 180 else hue end, 0) % 180 / 45) * 16 + floor(s / 64) * 4 + floor(v / 64) as bin, count(*) as n from h group by all)"""


@_query(f"with {_COLOURS} select path, bin::bigint as bin, round(n / sqrt(sum(n * n) over (partition by path))::double, 5) as weight from n")
def color_histogram(spark, sf_dir):
    from twinlens.kernels import pixels
    from twinlens.operators.features import kernel_values

    e = table(spark, sf_dir, "embeddings")
    shade = lambda x: _shade(x, 0.25, 500)
    of = lambda step, name: e.select((F.col("vec_id") - step).alias("vec_id"), F.transform("embedding", shade).alias(name))
    three = of(0, "r").join(of(1, "g"), "vec_id").join(of(2, "b"), "vec_id")
    images = three.select(F.col("vec_id").cast("string").alias("path"), F.flatten(F.transform(F.arrays_zip("r", "g", "b"), lambda x: F.array(x.r, x.g, x.b))).alias("a"))
    found = kernel_values(images, lambda a: pixels.color_histogram(a.astype("uint8")).astype(float), (8, 8, 3), "array<double>")
    bins = found.select("path", F.posexplode("value").alias("bin", "weight")).where("weight > 0")
    return bins.select("path", F.col("bin").cast("bigint").alias("bin"), F.round("weight", 5).alias("weight"))


@_query(_with(" select path_a, path_b, final_score from scored_pairs", "scored_pairs"))
def score_pairs(spark, sf_dir):
    return scored(spark, sf_dir).select("path_a", "path_b", "final_score")


@_query(_with(r""" select path_a, path_b, array_to_string([x for x in [case when gray_a <> gray_b then 'grayscale' when gray_a and gray_b then 'both_grayscale' end,
case when area_a > 0 and area_b > 0 and greatest(area_a, area_b) / least(area_a, area_b) >= 1.25 then 'size_difference' end,
case when lower(regexp_extract(path_a, '\.[^./]*$')) <> lower(regexp_extract(path_b, '\.[^./]*$')) then 'reencoded' end] if x is not null], ',') as hints from metrics""", "metrics"))  # fmt: skip
def modification_hints(spark, sf_dir):
    a, b = (X.area(F.col(f"width_{s}"), F.col(f"height_{s}")) for s in "ab")
    hints = X.modification_hints(F.col("gray_a"), F.col("gray_b"), a, b, F.col("path_a"), F.col("path_b"))
    return metrics(spark, sf_dir).select("path_a", "path_b", F.array_join(hints, ",").alias("hints"))


_DUCK_DECISION = "via_tile or via_orb or coalesce(greatest(area_a, area_b) / least(area_a, area_b) >= 1.25, false) or final_score between 0.35 and 0.85"


@_query(_with(f" select path_a, path_b, {_DUCK_DECISION} as checked from scored_pairs", "scored_pairs"))
def crop_decision(spark, sf_dir):
    a, b = (X.area(F.col(f"width_{s}"), F.col(f"height_{s}")) for s in "ab")
    return scored(spark, sf_dir).select("path_a", "path_b", X.wants_crop_check(a, b, F.col("final_score"), F.col("via_tile"), F.col("via_orb")).alias("checked"))


@_query(_with(""" select path_a, path_b, round(greatest(final_score, 1 / (1 + exp(-6 * (0.5 * (0.5 * ssim + 0.25 * hist_corr + 0.25 * (1 - mse)) + 0.5 * lum_corr - 0.55::double)))), 6) as final_score from scored_pairs""", "scored_pairs"))
def crop_refine(spark, sf_dir):
    alignment = X.crop_alignment(F.col("ssim"), F.col("hist_corr"), F.col("mse"))
    return scored(spark, sf_dir).select("path_a", "path_b", F.round(X.refined_score(alignment, F.col("lum_corr"), F.col("final_score")), 6).alias("final_score"))


@_query(_with(" select path, component from members", "members"))
def duplicate_components(spark, sf_dir):
    return G.duplicate_components(scored(spark, sf_dir), MIN_SCORE)


def _duck_keys(strategy: str) -> str:
    pixels, size = "coalesce(r.width::bigint * r.height, 0) desc", "coalesce(r.file_size, 0) desc"
    order = {"oldest": ("coalesce(-r.mtime, 0) desc", pixels, size), "newest": ("coalesce(r.mtime, 0) desc", pixels, size)}
    return ", ".join(order.get(strategy, (pixels, size, "coalesce(-r.mtime, 0) desc")))


def _canonical_sql(strategy: str) -> str:
    """The kept files; every thirteenth image has no record."""
    return f"select component, path as canonical from (select m.component, m.path, row_number() over (partition by m.component order by {_duck_keys(strategy)}, m.path) as place from members m left join (select * from image_records where vec_id % 13 <> 0) r on r.path = m.path) where place = 1"


def _canonical(strategy: str):
    def run(spark, sf_dir):
        known = records(spark, sf_dir).where("vec_id % 13 <> 0")
        return G.canonical(G.duplicate_components(scored(spark, sf_dir), MIN_SCORE), known, strategy)

    run.__name__ = f"canonical_{strategy}"
    return run


for _strategy in G.STRATEGIES:
    _query(_with(" " + _canonical_sql(_strategy), "members"))(_canonical(_strategy))

_KEPT = f"(select component, path as canonical from (select m.component, m.path, row_number() over (partition by m.component order by {_duck_keys('largest')}, m.path) as place from members m left join image_records r on r.path = m.path) where place = 1)"


@_query(_with(f""" select c.component, canonical, size::bigint as size, max_score, min_score from {_KEPT} c join (select component, count(*) as size from members group by component) n on n.component = c.component
join (select m.component, max(final_score) as max_score, min(final_score) as min_score from scored_pairs s join members m on m.path = s.path_a where final_score >= {MIN_SCORE} group by m.component) s on s.component = c.component""", "members"))  # fmt: skip
def duplicate_groups(spark, sf_dir):
    return G.duplicate_groups(scored(spark, sf_dir), records(spark, sf_dir), MIN_SCORE)


_TOLD = f"""kept as {_KEPT}, ends as (select m.component, canonical, path, other, s.path_a, s.path_b, final_score from (select path_a as path, path_b as other, path_a, path_b, final_score from scored_pairs union all select path_b, path_a, path_a, path_b, final_score from scored_pairs) s
join members m using (path) join kept k on k.component = m.component where final_score >= {MIN_SCORE}), direct as (select distinct path from ends where other = canonical),
told as (select * from (select e.*, other = canonical as direct, row_number() over (partition by e.path order by other = canonical desc, d.path is not null desc, final_score desc, path_a, path_b) as place from ends e left join direct d on d.path = e.other where e.path <> canonical) where place = 1)"""


@_query(_with(f", {_TOLD} select component, path, canonical, path_a, path_b, final_score, direct from told", "members"))
def member_attribution(spark, sf_dir):
    pairs = scored(spark, sf_dir)
    return G.member_attribution(pairs, G.group_members(pairs, records(spark, sf_dir), MIN_SCORE), MIN_SCORE)


@_query(_with(f", {_TOLD} select component, told.path, canonical, coalesce(file_size, 0) as file_size, direct, final_score from told left join image_records r on r.path = told.path", "members"))
def clean_plan(spark, sf_dir):
    return G.clean_plan(scored(spark, sf_dir), records(spark, sf_dir), MIN_SCORE)


@_query(_with(f", {_TOLD} select (select count(*) from image_records) as images, (select count(*) from kept) as groups, count(*) as duplicates, coalesce(sum(file_size), 0)::bigint as reclaimable from told left join image_records r on r.path = told.path", "members"))
def report_summary(spark, sf_dir):
    from twinlens.plans.report import summary

    pairs, r = scored(spark, sf_dir), records(spark, sf_dir)
    return summary(r, G.clean_plan(pairs, r, MIN_SCORE))


_UNIT = "case when n < 1024 then concat(n, '.0 B') when n < 1048576 then concat(n // 1024, '.0 KB') when n < 1073741824 then concat(n // 1048576, '.0 MB') when n < 1099511627776 then concat(n // 1073741824, '.0 GB') else concat(n // 1099511627776, '.0 TB') end"


@_query(f"with s as (select o_orderkey, (o_orderkey * o_orderkey * o_orderkey)::bigint as n from orders) select o_orderkey, n, {_UNIT} as text from s")
def format_bytes(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") * F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).withColumn("text", X.format_bytes(F.col("n")))


@_query(_with(" select path_a, path_b, case when final_score >= 0.95 then 'bright_green' when final_score >= 0.85 then 'green' when final_score >= 0.7 then 'yellow' else 'red' end as band from scored_pairs", "scored_pairs"))
def score_bands(spark, sf_dir):
    return scored(spark, sf_dir).select("path_a", "path_b", X.score_band(F.col("final_score")).alias("band"))


@_query(_with(" select path, concat(width, '×', height) as dimensions, lower(printf('%016x', phash)) as phash from image_records", "image_records"))
def format_dimensions(spark, sf_dir):
    return records(spark, sf_dir).select("path", X.format_dimensions(F.col("width"), F.col("height")).alias("dimensions"), X.hex64(F.col("phash")).alias("phash"))


def _shade(x: F.Column, add: float, times: int) -> F.Column:
    """A number as a gray value, in single precision throughout as in the SQL; numbers beside a half would round otherwise."""
    value = F.round((x + F.lit(add).cast("float")) * F.lit(times).cast("float"))
    return F.least(F.lit(255), F.greatest(F.lit(0), value)).cast("int")


def _gray(spark, sf_dir) -> DataFrame:
    """Vectors as 8 x 8 gray images."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.transform("embedding", lambda x: _shade(x, 0.5, 255)).alias("pixels"))


@_query(f"with {_GRAY} select path, round(1 / (1 + exp(-8 * (1 - 0.7::double))), 6) as confidence, 5::bigint as x, 3::bigint as y from g")
def template_match(spark, sf_dir):
    """Every image, doubled, is found where it was put."""
    from twinlens.operators.features import locate_in_gray_arrays

    return locate_in_gray_arrays(_gray(spark, sf_dir), 8)


@_query(_with(f""", {_TOLD} select k.component, n.size::bigint as size, round(max_score, 4) as max_score, k.canonical, string_agg(concat(told.path, ' ', printf('%.4f', round(told.final_score, 4))), ',' order by told.path) as duplicates
from kept k join told on told.component = k.component join (select component, count(*) as size, from members group by component) n on n.component = k.component
join (select component, max(final_score) as max_score from told group by component) m on m.component = k.component group by all""", "members"))  # fmt: skip
def json_report(spark, sf_dir):
    """The JSON report, parsed again."""
    from twinlens.plans.report import groups_json

    pairs, r = scored(spark, sf_dir), records(spark, sf_dir)
    report = groups_json(pairs.withColumn("modification_hints", F.array().cast("array<string>")), r, MIN_SCORE)
    body = F.from_json("group", "canonical struct<path: string>, size long, max_score double, duplicates array<struct<path: string, score: double>>")
    told = report.select("component", body.alias("g"))
    lines = F.transform(F.array_sort("g.duplicates"), lambda x: F.concat(x.path, F.lit(" "), F.format_string("%.4f", x.score)))
    return told.select("component", "g.size", "g.max_score", F.col("g.canonical.path").alias("canonical"), F.array_join(lines, ",").alias("duplicates"))
