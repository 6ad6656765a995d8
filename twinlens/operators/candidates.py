"""Candidate search: Hamming joins of full and tile hashes, and the size-mismatch join.

A Hamming join at or below t has two exact plans.  Up to ``NESTED_ROWS`` rows one side is broadcast and every pair is
tested; that side's size is checked first.  Beyond, hashes are cut into m bands: two hashes within t agree in some band up
to r = t // m bits, so one side probes each band with all changes of up to half of r bits, the other with the other half,
and the join is an equi-join on (band, bits).  m is chosen by what rows and comparisons cost.  Equal hashes are joined
once and expanded at the end.

Joins whose sides grow with the input carry a merge hint, here and in the other operators: Spark takes a side for small by
its compressed file, or by its rows before an explode, and would send the driver many times its broadcast threshold.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.expressions import area, cosine_of_units, hamming

NESTED_ROWS = 20_000
#: Default thresholds: two hashes within so many bits count as alike.
THRESHOLDS = {"phash": 10, "dhash": 10, "whash": 12}
#: Distance that size-mismatch candidates carry instead of one.
NO_DISTANCE = 64


#: What a row in a shuffle costs, in comparisons of two hashes.
ROW_COST = 20


def bands(rows: int, threshold: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each band, the cheapest for a table of so many rows."""

    def cost(count: int) -> float:
        bits, radius = 64 // count, threshold // count
        x, y = (sum(math.comb(bits, r) for r in range(half + 1)) for half in ((radius + 1) // 2, radius // 2))
        return count * (ROW_COST * (x + y) + x * y * rows / 2**bits)

    count = min(range(1, threshold + 2), key=cost)
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, b - a, threshold // count) for a, b in itertools.pairwise(edges)]


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in some) for r in range(radius + 1) for some in itertools.combinations(range(bits), r)]


def _band_values(h: Column, cut: list[tuple[int, int, int]], upper: bool) -> Column:
    return F.explode(F.concat(*(_one_band(h, k, band, upper) for k, band in enumerate(cut))))


def _one_band(h: Column, number: int, band: tuple[int, int, int], upper: bool) -> Column:
    """Array of (band, bits): all that differ from the band's own bits by up to a half of the radius."""
    shift, bits, radius = band
    value = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else h
    changes = F.array(*(F.lit(m).cast("bigint") for m in _masks(bits, (radius + upper) // 2)))
    return F.transform(changes, lambda m: F.struct(F.lit(number).alias("band"), value.bitwiseXOR(m).alias("bits")))


def over_all_cores(streamed: DataFrame) -> DataFrame:
    """The streamed side of a nested loop; a small table lies in one file and would be one task."""
    return streamed.repartition(streamed.sparkSession.sparkContext.defaultParallelism)


def near_hashes(left: DataFrame, right: DataFrame, threshold: int, rows: int) -> DataFrame:
    """Distinct (x, y) with x a hash of ``left``, y one of ``right``, at most ``threshold`` bits apart; frames have column h."""
    x, y = left.select(F.col("h").alias("x")).distinct(), right.select(F.col("h").alias("y")).distinct()
    if rows <= NESTED_ROWS:
        return over_all_cores(x).join(F.broadcast(y), hamming(F.col("x"), F.col("y")) <= threshold)
    cut = bands(rows, threshold)
    probes = x.select("x", _band_values(F.col("x"), cut, True).alias("key")).select("x", "key.*")
    stored = y.select("y", _band_values(F.col("y"), cut, False).alias("key")).select("y", "key.*")
    return probes.join(stored.hint("merge"), ["band", "bits"]).where(hamming(F.col("x"), F.col("y")) <= threshold).select("x", "y").distinct()


def hash_candidates(records: DataFrame, thresholds: dict[str, int] | None = None, nested_rows: int = NESTED_ROWS) -> DataFrame:
    """Pairs of images of which any of the three hashes is within its threshold, each pair once.

    min_hash_dist is the least distance among the hashes that qualify, hash_agreement how many of the three do.
    """
    limit = THRESHOLDS | (thresholds or {})
    slim = records.select("path", *limit)
    rows = slim.count()
    a, b = (slim.select(*(F.col(c).alias(f"{c}_{s}") for c in slim.columns)) for s in "ab")
    distance = {k: hamming(F.col(f"{k}_a"), F.col(f"{k}_b")) for k in limit}
    any_near = F.lit(False)
    for k, t in limit.items():
        any_near = any_near | (distance[k] <= t)
    if rows <= nested_rows:
        pairs = over_all_cores(a).join(F.broadcast(b), (F.col("path_a") < F.col("path_b")) & any_near)
    else:
        found = None
        for k, t in limit.items():
            h = slim.select(F.col(k).alias("h"))
            near = near_hashes(h, h, t, max(rows, NESTED_ROWS + 1))
            some = near.join(slim.select(F.col(k).alias("x"), F.col("path").alias("path_a")).hint("merge"), "x").join(slim.select(F.col(k).alias("y"), F.col("path").alias("path_b")).hint("merge"), "y")
            some = some.where("path_a < path_b").select("path_a", "path_b")
            found = some if found is None else found.union(some)
        pairs = found.distinct().join(a.hint("merge"), "path_a").join(b.hint("merge"), "path_b")
    least = F.least(*(F.when(distance[k] <= t, distance[k]) for k, t in limit.items()), F.lit(None).cast("int"))
    agreement = sum((F.when(distance[k] <= t, 1).otherwise(0) for k, t in limit.items()), F.lit(0)) / F.lit(3.0)
    return pairs.select("path_a", "path_b", least.cast("int").alias("min_hash_dist"), agreement.alias("hash_agreement"), F.lit(False).alias("via_tile"), F.lit(False).alias("via_orb"))


def tile_candidates(records: DataFrame, tiles: DataFrame, full_pairs: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Pairs in which a tile of one image has a hash near the other's full hash, unless ``full_pairs`` has them."""
    limit = THRESHOLDS | (thresholds or {})
    rows, found = max(records.count(), tiles.count()), None
    for k, t in limit.items():
        near = near_hashes(records.select(F.col(k).alias("h")), tiles.select(F.col(k).alias("h")), t, rows)
        some = near.join(records.select(F.col(k).alias("x"), F.col("path").alias("p")).hint("merge"), "x").join(tiles.select(F.col(k).alias("y"), F.col("path").alias("q")).distinct().hint("merge"), "y").where("p <> q")
        some = some.select(F.least("p", "q").alias("path_a"), F.greatest("p", "q").alias("path_b"), hamming(F.col("x"), F.col("y")).alias("d"))
        found = some if found is None else found.union(some)
    best = found.groupBy("path_a", "path_b").agg(F.min("d").cast("int").alias("min_hash_dist"))
    new = best.join(full_pairs.select("path_a", "path_b").hint("merge"), ["path_a", "path_b"], "left_anti")
    return new.select("path_a", "path_b", "min_hash_dist", F.lit(1 / 3).alias("hash_agreement"), F.lit(True).alias("via_tile"), F.lit(False).alias("via_orb"))


def query_candidates(records: DataFrame, tiles: DataFrame | None = None, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Full-image and tile candidates: full ones first, then by distance, ties by path."""
    full = hash_candidates(records, thresholds)
    every = full if tiles is None else full.unionByName(tile_candidates(records, tiles, full, thresholds))
    return every.orderBy("via_tile", "min_hash_dist", "path_a", "path_b")


def _mismatched(small: str, large: str, ratio: float) -> Column:
    """Whether the image whose columns begin with ``large`` has ``ratio`` times the area of the other; of equals, by path."""
    a, b = F.col(f"{small}_area"), F.col(f"{large}_area")
    return (b >= ratio * a) & (a > 0) & ((a < b) | ((a == b) & (F.col(f"{small}_path") < F.col(f"{large}_path"))))


def _known_mismatches(slim: DataFrame, existing: DataFrame, ratio: float) -> DataFrame:
    """(small_path, large_path, large_area) of the known pairs that would be size mismatches."""
    ends = existing.select(F.col("path_a").alias("a_path"), F.col("path_b").alias("b_path"))
    for side in "ab":
        ends = ends.join(slim.select(F.col("path").alias(f"{side}_path"), F.col("area").alias(f"{side}_area")).hint("merge"), f"{side}_path")
    turned = lambda x, y: F.struct(F.col(f"{x}_path").alias("small_path"), F.col(f"{y}_path").alias("large_path"), F.col(f"{y}_area").alias("large_area"))
    way = F.when(_mismatched("a", "b", ratio), turned("a", "b")).when(_mismatched("b", "a", ratio), turned("b", "a"))
    return ends.select(way.alias("known")).where("known is not null").select("known.*")


def size_mismatches(records: DataFrame, existing: DataFrame | None = None, ratio: float = 4.0) -> DataFrame:
    """(small, large) where the large image has at least ``ratio`` times the area, each pair once, known pairs left out.

    Up to NESTED_ROWS images one side is broadcast.  Beyond, images are cut into classes of area; a class meets the
    classes that can hold images so much larger, and each such pair of classes is a part of an equi-join.  A small image
    brings the large ones that it is known to go with, so that no pair is shuffled.
    """
    slim = records.select("path", area(F.col("width"), F.col("height")).alias("area"), "color_hist")
    small, large = (slim.select(*(F.col(c).alias(f"{s}_{c}") for c in slim.columns)) for s in ("small", "large"))
    met = _mismatched("small", "large", ratio)
    known = None if existing is None else _known_mismatches(slim, existing, ratio)
    new = F.lit(True) if existing is None else ~F.coalesce(F.array_contains("known", F.col("large_path")), F.lit(False))
    listed = F.collect_set("large_path").alias("known")
    rows = slim.count()
    if rows <= NESTED_ROWS:
        if known is not None:
            small = small.join(known.groupBy("small_path").agg(listed).hint("merge"), "small_path", "left")
        pairs = over_all_cores(small).join(F.broadcast(large), met & new)
    else:
        step = math.log(max(ratio, 1.25))
        of = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1)).cast("double")) / F.lit(step)).cast("int")
        top = slim.agg(F.max("area")).first()[0] or 1
        last = int(math.log(max(top, 1)) / step) + 1
        low = 0 if ratio < 1.25 else 1
        reach = small.where("small_area > 0").withColumn("class", F.explode(F.sequence(F.greatest(of("small_area") + low - 1, F.lit(0)), F.lit(last))))
        if known is not None:
            known = known.withColumn("class", of("large_area")).groupBy("small_path", "class").agg(listed)
            reach = reach.join(known.hint("merge"), ["small_path", "class"], "left")
        # classes are dealt again by a hash of the small side's path, so that one class isn't one task
        salt = max(16, rows // 10_000)
        reach = reach.withColumn("salt", F.pmod(F.xxhash64("small_path"), F.lit(salt)).cast("int"))
        held = large.withColumn("class", of("large_area")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        # a task's rows are few for their pairs: Spark would put the keys of many tasks into one
        reach, held = (x.repartition(4 * salt, "class", "salt") for x in (reach, held))
        pairs = reach.join(held.hint("merge"), ["class", "salt"]).where(met & new).drop("class", "salt")
    pairs = pairs.withColumn("path_a", F.least("small_path", "large_path")).withColumn("path_b", F.greatest("small_path", "large_path"))
    return pairs.drop("known")


#: Small and large images of a part of the search for the most similar.
SMALL_ROWS, LARGE_ROWS = 30_000, 60_000


def _most_similar(records: DataFrame, existing: DataFrame | None, ratio: float, per_small: int, rows: int, length: int, least: int, top: int) -> DataFrame:
    """(small_path, large_path, similarity), the ``per_small`` most similar of each small image and part of the large ones.

    Both sides are dealt into parts by a hash of their paths, every part of small images meets every part of large ones.
    """
    slim = records.select("path", area(F.col("width"), F.col("height")).alias("area"), F.col("color_hist").alias("hist"))
    across = -(-rows // LARGE_ROWS)
    down = max(-(-rows // SMALL_ROWS), slim.sparkSession.sparkContext.defaultParallelism // across)
    part = lambda n: F.pmod(F.xxhash64("path"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    small, large = slim.where((F.col("area") > 0) & (F.col("area") * ratio <= top)), slim.where(F.col("area") >= ratio * least)
    if existing is None:
        small = small.withColumn("known", F.lit(None).cast("array<string>"))
    else:
        known = _known_mismatches(slim, existing, ratio).groupBy(F.col("small_path").alias("path")).agg(F.collect_set("large_path").alias("known"))
        small = small.join(known.hint("merge"), "path", "left")
    small = small.withColumn("i", part(down)).withColumn("j", every(across))
    large = large.withColumn("j", part(across)).withColumn("i", every(down))
    parts = down * across
    # new names: a column that both sides have of one table would come to one side only
    large = large.select(*(F.col(c).alias(f"large_{c}") for c in large.columns))
    small, large = small.repartition(parts, "i", "j"), large.repartition(parts, "large_i", "large_j")

    def run(a, b):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from twinlens.kernels.nearest import top_larger

        def vectors(column):
            flat = column.combine_chunks()
            return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), length)

        if not a.num_rows or not b.num_rows:
            return pa.table({"small_path": pa.array([], pa.string()), "large_path": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        order = np.empty(b.num_rows, np.int64)
        order[pc.sort_indices(b["large_path"].cast(pa.binary())).to_numpy()] = np.arange(b.num_rows)
        lists = a["known"].combine_chunks()
        to = pc.fill_null(pc.index_in(lists.flatten(), value_set=b["large_path"].combine_chunks()), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(a.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        s, l, similarity = top_larger(vectors(a["hist"]), a["area"].to_numpy(), vectors(b["large_hist"]), b["large_area"].to_numpy(), order, (of[to >= 0], to[to >= 0]), ratio, per_small)
        return pa.table({"small_path": a["path"].take(pa.array(s)), "large_path": b["large_path"].take(pa.array(l)), "similarity": pa.array(similarity)})

    return small.groupBy("i", "j").cogroup(large.groupBy("large_i", "large_j")).applyInArrow(run, "small_path string, large_path string, similarity double")


def size_mismatch_candidates(records: DataFrame, existing: DataFrame | None = None, ratio: float = 4.0, per_small: int = 20) -> DataFrame:
    """The ``per_small`` most similar large images of each small one by colour histogram.

    The limit only holds if every record has a histogram; else all pairs go on.  Ties by path of the large image.  Where
    histograms have one length and finite numbers, NumPy finds the most similar and no other pair is made a row.
    """
    from pyspark.sql import Window

    size = area(F.col("width"), F.col("height"))
    plain = F.forall("color_hist", lambda x: x.isNotNull() & (F.abs(x) < 1e30))
    about = records.agg(F.bool_and(F.col("color_hist").isNotNull()), F.bool_and(F.coalesce(plain, F.lit(False))), F.min(F.size("color_hist")), F.max(F.size("color_hist")), F.count(F.lit(1)), F.min(F.when(size > 0, size)), F.max(size))
    complete, plain, length, longest, rows, least, top = about.first()
    if complete and plain and length == longest and ratio > 1 and per_small > 0 and least is not None:
        ranked = _most_similar(records, existing, ratio, per_small, rows, length, least, top)
        ranked = ranked.withColumn("path_a", F.least("small_path", "large_path")).withColumn("path_b", F.greatest("small_path", "large_path"))
    else:
        pairs = size_mismatches(records, existing, ratio)
        ranked = pairs.withColumn("similarity", cosine_of_units(F.col("small_color_hist"), F.col("large_color_hist")))
    if complete:
        best = Window.partitionBy("small_path").orderBy(F.desc("similarity"), F.col("large_path"))
        ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_small)
    else:
        ranked = ranked.withColumn("rank", F.lit(None).cast("int"))
    return ranked.select("path_a", "path_b", "small_path", "large_path", "similarity", "rank")


def with_records(pairs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with both images' columns as ``<column>_a`` and ``<column>_b``; pairs without a record go."""
    for side in "ab":
        pairs = pairs.join(records.select(F.col("path").alias(f"path_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in columns)).hint("merge"), f"path_{side}")
    return pairs
