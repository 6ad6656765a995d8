import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.images import picture, write_png
from twinlens import cli, schemas
from twinlens.functions import expressions as X
from twinlens.kernels import pixels
from twinlens.operators import candidates as C
from twinlens.operators import groups as G
from twinlens.operators.components import components
from twinlens.plans import jobs, report
from twinlens.sources import store as S
from twinlens.sources.listing import scan_directories, walk


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def rec(path, phash=0, dhash=0, whash=0, width=100, height=100, size=1000, mtime=1.0, hist=None):
    return (path, size, mtime, phash, dhash, whash, width, height, False, 0.0, hist, True)


def recs(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.IMAGE_RECORDS)


def pair(a, b, score, hints=()):
    return (a, b, score, score, 1 - score, None, None, score, list(hints))


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.SCORED_PAIRS)


def test_expressions(spark):
    r = one(
        spark, a=X.sigmoid(F.lit(0.65)), b=X.format_bytes(F.lit(1536)), c=X.format_bytes(F.lit(512)), d=X.format_bytes(F.lit(2 << 20)), e=X.format_bytes(F.lit(3 << 30)),
        f=X.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")), g=X.signed64(F.lit("ffffffffffffffff")), h=X.hex64(F.lit(-1).cast("bigint")), i=X.is_raw(F.lit("/x/A.CR2")), j=X.extension(F.lit("/x/.png")), k=X.extension(F.lit("/a.b/c")),
        l=X.format_dimensions(F.lit(3), F.lit(4)), m=F.array(*(X.score_band(F.lit(s)) for s in (0.95, 0.85, 0.7, 0.69))),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k, r.l) == (0.5, "1.0 KB", "512.0 B", "2.0 MB", "3.0 GB", 64, -1, "f" * 16, True, "", "", "3×4")
    assert r.m == ["bright_green", "green", "yellow", "red"]
    for n in (0, 512, 1023, 1024, 1536, 5 << 20, 3 << 30, 7 << 40, 1 << 55):
        assert report.plain_bytes(n) == one(spark, x=X.format_bytes(F.lit(n).cast("bigint"))).x


def test_score_ceilings_and_decisions(spark):
    best = lambda agreement, gray: one(spark, x=X.base_score(*(F.lit(v) for v in (1.0, 1.0, 1.0, 0.0, agreement)), F.lit(gray))).x
    assert best(1.0, False) == pytest.approx(1 / (1 + math.exp(-2.8))) and best(1 / 3, False) < 0.9 < best(2 / 3, False) and best(1 / 3, True) > 0.9
    check = lambda a, b, s, t=False: one(spark, x=X.wants_crop_check(F.lit(a), F.lit(b), F.lit(s), F.lit(t), F.lit(False))).x
    assert check(100, 100, 0.35) and check(100, 100, 0.85) and check(125, 100, 0.95) and check(100, 100, 0.95, True)
    assert not check(100, 100, 0.95) and not check(0, 100, 0.95)
    hints = lambda ga, gb, a, b, p, q: one(spark, x=X.modification_hints(*(F.lit(v) for v in (ga, gb, a, b, p, q)))).x
    assert hints(True, False, 125, 100, "a.jpg", "b.JPEG") == ["grayscale", "size_difference", "reencoded"]
    assert hints(True, True, 0, 100, "a.jpg", "b.JPG") == ["both_grayscale"]


def test_hamming_candidates(spark):
    assert C.hash_candidates(recs(spark)).count() == 0
    found = C.hash_candidates(recs(spark, rec("/b"), rec("/a"), rec("/c", -1, -1, 2**40 - 1))).collect()
    assert [(r.path_a, r.path_b, r.min_hash_dist, r.hash_agreement) for r in found] == [("/a", "/b", 0, 1.0)]


def test_banded_join_equals_nested(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i, base in enumerate(rng.integers(-(2**63), 2**63, 60)):
        for k in range(3):  # copy 0 as it is, copy 1 four bits off in each hash, copy 2 eight bits off in the first
            flips = [4 * k if k < 2 or not n else 0 for n in range(3)]
            changes = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, f, replace=False).astype(np.uint64), initial=np.uint64(0)) for f in flips]
            rows.append(rec(f"/{i:03d}_{k}", *(int(base ^ c.astype(np.int64)) for c in changes)))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    nested, banded = C.hash_candidates(recs(spark, *rows)), C.hash_candidates(recs(spark, *rows), nested_rows=0)
    assert key(nested) == key(banded) and nested.count() >= 60


def test_tiles_and_suppression(spark):
    records = recs(spark, rec("/a", 0, 0, 0), rec("/b", 0, -1, -1), rec("/c", 2**32 - 1, 2**32 - 1, 2**32 - 1))
    tile = lambda *rows: spark.createDataFrame(list(rows), schemas.TILE_HASHES)
    full = C.hash_candidates(records)
    assert C.tile_candidates(records, tile(("/a", 0, 0, 0, 50, 50, 0, 0, 0)), full).count() == 0
    found = C.tile_candidates(records, tile(("/c", 0, 0, 0, 50, 50, 1, 0, 0)), full).collect()
    assert {(r.path_a, r.path_b, r.min_hash_dist) for r in found} == {("/a", "/c", 0), ("/b", "/c", 1)}
    ordered = C.query_candidates(records, tile(("/c", 0, 0, 0, 50, 50, 1, 0, 0))).collect()
    assert [r.via_tile for r in ordered] == [False, True, True]


def test_size_mismatch(spark):
    hist = [1.0] + [0.0] * 63
    r = recs(spark, rec("/s", hist=hist), rec("/l", width=200, height=200, hist=hist), rec("/m", width=150, hist=hist), rec("/z", width=0, hist=hist))
    assert [(x.small_path, x.large_path) for x in C.size_mismatches(r).collect()] == [("/s", "/l")]
    known = spark.createDataFrame([("/l", "/s")], "path_a string, path_b string")
    assert C.size_mismatches(r, known).count() == 0
    many = recs(spark, rec("/s", hist=hist), *(rec(f"/l{i}", width=400, hist=hist) for i in range(5)))
    assert C.size_mismatch_candidates(many, per_small=2).count() == 2
    gap = recs(spark, rec("/s"), *(rec(f"/l{i}", width=400, hist=hist) for i in range(5)))
    assert C.size_mismatch_candidates(gap, per_small=2).count() == 5
    for ratio in (1.0, 1.5, 4.0):
        sizes = recs(spark, *(rec(f"/{i}", width=20 + 37 * i % 400, height=30 + 91 * i % 300) for i in range(40)))
        near = {tuple(x) for x in C.size_mismatches(sizes, ratio=ratio).select("small_path", "large_path").collect()}
        limit, C.NESTED_ROWS = C.NESTED_ROWS, 0
        assert near == {tuple(x) for x in C.size_mismatches(sizes, ratio=ratio).select("small_path", "large_path").collect()}
        C.NESTED_ROWS = limit


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_groups_and_strategies(spark):
    records = recs(spark, rec("/a", size=5, mtime=3.0), rec("/b", size=9, mtime=1.0), rec("/c", width=300, size=1, mtime=9.0))
    scored = pairs(spark, pair("/a", "/b", 0.91), pair("/b", "/c", 0.99), pair("/c", "/x", 0.5))
    g = G.duplicate_groups(scored, records).first()
    assert (g.canonical, g["size"], g.max_score, g.min_score) == ("/c", 3, 0.99, 0.91)
    keep = {s: G.duplicate_groups(scored, records, strategy=s).first().canonical for s in G.STRATEGIES}
    assert keep == {"largest": "/c", "oldest": "/b", "newest": "/c", "highest_res": "/c"}
    assert G.duplicate_groups(scored, records.where("path <> '/a'"), strategy="oldest").first().canonical == "/a"  # no record
    told = {r.path: (r.path_a, r.path_b, r.direct) for r in G.member_attribution(scored, G.group_members(scored, records)).collect()}
    assert told == {"/b": ("/b", "/c", True), "/a": ("/a", "/b", False)}
    plan = G.clean_plan(scored, records, 0.9).collect()
    assert {(r.path, r.file_size, r.direct) for r in plan} == {("/a", 5, False), ("/b", 9, True)}
    assert G.duplicate_groups(scored, records, 1.0).count() == 0


def test_cache_rules(spark):
    listing = spark.createDataFrame([("/a", 1, 1.0), ("/b", 1, 2.0), ("/c", 1, 1.0), ("/d", 1, 1.0), ("/e", 1, 1.0)], schemas.FILE_LISTING)
    hist = [1.0] * 64
    known = recs(spark, rec("/a", size=1, hist=hist), rec("/b", size=1, hist=hist), rec("/c", size=1), rec("/d", size=1, width=600, height=600, hist=hist)).withColumn("tiles_computed", F.lit(False))
    status = {r.path: r.cached for r in S.cache_status(listing, known).collect()}
    assert status == {"/a": True, "/b": False, "/c": False, "/d": False, "/e": False}
    tiled = spark.createDataFrame([("/d",)], "path string")
    assert {r.path: r.cached for r in S.cache_status(listing, known, tiled).collect()}["/d"]


def test_store_replaces_what_it_reads(spark, tmp_path):
    store = jobs.open_store(spark, str(tmp_path / "db"))
    assert store.read("image_records").isEmpty()
    tile = spark.createDataFrame([("/a", 0, 0, 0, 1, 1, 1, 1, 1)], schemas.TILE_HASHES)
    store.put(recs(spark, rec("/a"), rec("/b")), tile)
    store.put(recs(spark, rec("/a", size=7)), tile.limit(0))
    assert {r.path: r.file_size for r in store.read("image_records").collect()} == {"/a": 7, "/b": 1000}
    assert store.read("tile_hashes").isEmpty()


def test_listing(spark, tmp_path):
    for name in ("b.JPG", ".hidden.png", "x.txt", "sub/r.CR2"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    os.symlink(tmp_path / "gone.png", tmp_path / "broken.png")
    names = [os.path.relpath(p, tmp_path) for p, _, _ in walk(str(tmp_path))]
    assert names == [".hidden.png", "b.JPG", "sub/r.CR2"]
    assert list(walk(str(tmp_path / "none"))) == [] and len(list(walk(str(tmp_path / "b.JPG")))) == 1
    assert scan_directories(spark, [str(tmp_path), str(tmp_path / "sub")]).count() == 4
    assert scan_directories(spark, []).count() == 0


def test_scan_find_report_clean(spark, tmp_path, capsys, monkeypatch):
    top = tmp_path / "pic tures+1%"
    top.mkdir()
    a = picture(1, 640, 480)
    write_png(top / "a.png", a)
    write_png(top / "copy.PNG", a)
    write_png(top / "small.png", pixels.resize(a, 320, 240))
    write_png(top / "gray.png", pixels.gray8(a))
    write_png(top / "other.png", picture(2, 640, 480))
    write_png(top / "thin.png", picture(3, 100, 3000))
    (top / "broken.png").write_bytes(b"no image")
    store = jobs.open_store(spark, str(tmp_path / "db"))
    assert jobs.find(store) is None and jobs.show(store) is None
    done = jobs.scan(store, [str(top)], 2)
    assert (done["files"], done["hashed"], done["failed"]) == (7, 6, 1) and "broken.png" in done["errors"][0][0]
    again = jobs.scan(store, [str(top)], 2)
    assert (again["cached"], again["hashed"], again["failed"]) == (6, 0, 1)
    found = jobs.find(store)
    assert found["candidates"] >= 6 and found["failed"] == 0
    score = {tuple(os.path.basename(p) for p in (r.path_a, r.path_b)): r for r in store.read("scored_pairs").collect()}
    assert score["a.png", "copy.PNG"].final_score == pytest.approx(1 / (1 + math.exp(-2.8)), abs=1e-6)
    assert "grayscale" in score["a.png", "gray.png"].modification_hints and "size_difference" in score["a.png", "small.png"].modification_hints
    lines = list(jobs.show(store, json_path=str(tmp_path / "out.json")))
    assert lines[-1].startswith("1 groups, 3 duplicates") and any("original" in x and "a.png" in x for x in lines)
    with open(tmp_path / "out.json") as f:
        out = json.load(f)
    assert out["total_groups"] == 1 and out["total_duplicates"] == 3
    assert os.path.basename(out["groups"][0]["canonical"]["path"]) == "a.png" and out["groups"][0]["duplicates"][0]["score"] == round(out["groups"][0]["duplicates"][0]["score"], 4)
    plan = jobs.clean(store, 0.9)
    assert plan["files"] >= 1 and plan["removed"] == 0
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "data"))
    moved = jobs.clean(store, 0.9, remove=jobs.move_to_trash)
    assert moved["removed"] == moved["files"] and not (top / "copy.PNG").exists() and (tmp_path / "data/Trash/files/copy.PNG").exists()


def test_crops_are_found_and_refined(spark, tmp_path):
    a = picture(9, 1600, 1200)
    write_png(tmp_path / "a.png", a)
    write_png(tmp_path / "part.png", a[300:800, 400:1000])
    store = jobs.open_store(spark, str(tmp_path / "db"))
    jobs.scan(store, [str(tmp_path)], 2)
    done = jobs.find(store, find_crops=True)
    assert done["candidates"] >= 1 and done["refined"] >= 1
    r = store.read("scored_pairs").first()
    assert "crop" in r.modification_hints and r.crop_score >= 0.4
    assert abs(r.crop_bbox.x - 400) < 40 and abs(r.crop_bbox.y - 300) < 40 and abs(r.crop_bbox.w - 600) < 60


def test_stream_of_images(spark, tmp_path):
    from twinlens.sources.images import decode
    from twinlens.streaming import hash_stream

    (tmp_path / "in").mkdir()
    write_png(tmp_path / "in/a.png", picture(1, 120, 90))
    decode(scan_directories(spark, [str(tmp_path / "in")])).write.parquet(str(tmp_path / "feed"))
    store = jobs.open_store(spark, str(tmp_path / "db"))
    feed = spark.readStream.schema(spark.read.parquet(str(tmp_path / "feed")).schema).parquet(str(tmp_path / "feed"))
    hash_stream(feed, store, str(tmp_path / "check")).awaitTermination()
    assert store.read("image_records").count() == 1


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    p = cli.build_parser()
    find = p.parse_args(["find"])
    assert (find.workers, find.threshold_phash, find.threshold_dhash, find.threshold_whash, find.min_score, find.crop_min_ratio, find.crop_max_per_image, find.crop_min_inliers) == (4, 10, 10, 12, 0.8, 4.0, 20, 12)
    assert p.parse_args(["clean"]).dry_run and p.parse_args(["clean"]).min_score == 0.9 and p.parse_args(["scan", "x"]).workers == 8
    monkeypatch.setattr(cli, "_session", lambda workers: spark)
    db = ["--db", str(tmp_path / "db")]
    assert cli.main([*db, "find"]) == 1 and cli.main([*db, "report"]) == 1
    store = jobs.open_store(spark, str(tmp_path / "db"))
    store.write("image_records", recs(spark, rec("/a"), rec("/b")))
    store.write("scored_pairs", pairs(spark, pair("/a", "/b", 0.93)))
    moved = []
    monkeypatch.setattr(jobs, "move_to_trash", moved.append)
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert cli.main([*db, "report"]) == 0 and cli.main([*db, "clean"]) == 0 and cli.main([*db, "clean", "--force"]) == 0 and not moved
    monkeypatch.setattr("builtins.input", lambda _: "y")
    assert cli.main([*db, "clean", "--force"]) == 0 and moved == ["/b"]
    assert "would move /b" in capsys.readouterr().out


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len([q for q in queries if not q.startswith("op")]) >= 30


def test_only_uncached_files_are_decoded(spark, tmp_path):
    from twinlens.sources.images import load

    (tmp_path / "in").mkdir()
    for k in range(4):
        write_png(tmp_path / "in" / f"p[{k}].png", picture(k, 90, 80))
    (tmp_path / "in" / "broken.png").write_bytes(b"no picture")
    store = S.ImageStore(spark, f"file://{tmp_path}/store")
    first = jobs.scan(store, [str(tmp_path / "in")], 2)
    assert (first["files"], first["hashed"], first["failed"], first["cached"]) == (5, 4, 1, 0)
    write_png(tmp_path / "in" / "new.png", picture(9, 90, 80))
    (tmp_path / "in" / "broken.png").unlink()
    todo = store.uncached(scan_directories(spark, [str(tmp_path / "in")])).where("not cached")
    assert [os.path.basename(f) for f in load(todo).inputFiles()] == ["new.png"]
    second = jobs.scan(store, [str(tmp_path / "in")], 2)
    assert (second["files"], second["hashed"], second["failed"], second["cached"]) == (5, 1, 0, 4)
    assert store.read("image_records").count() == 5


def test_a_table_is_replaced_in_one_step(spark, tmp_path):
    store = S.ImageStore(spark, f"file://{tmp_path}/store")
    for rows in ([rec("/a")], [rec("/a"), rec("/b")], [rec("/c")]):
        held = store.read("image_records")
        n = held.count()
        store.write("image_records", recs(spark, *rows))
        assert held.count() == n and {r.path for r in store.read("image_records").collect()} == {r[0] for r in rows}
    store.write("image_records", store.read("image_records").withColumn("file_size", F.lit(7)))
    assert [r.file_size for r in store.read("image_records").collect()] == [7]
    assert len([d for d in os.listdir(tmp_path / "store/image_records") if d.startswith("version-")]) == 2


def test_bands_are_cheap_and_meet(spark):
    for rows, threshold in ((10**5, 10), (10**6, 10), (10**6, 12), (10**9, 10)):
        cut = C.bands(rows, threshold)
        assert sum(bits for _, bits, _ in cut) == 64 and (threshold // len(cut)) <= cut[0][2]
    assert sum(len(C._masks(b, (r + 1) // 2)) for _, b, r in C.bands(10**6, 10)) < 100
    rng = np.random.default_rng(4)
    x = [int(v) for v in rng.integers(-(2**63), 2**63, 60)]
    y = []
    for v in x:
        flips = rng.choice(64, int(rng.integers(0, 14)), replace=False)
        y.append(int(np.array((v & (2**64 - 1)) ^ sum(1 << int(f) for f in flips), np.uint64).view(np.int64)))
    left, right = (spark.createDataFrame([(v,) for v in h], "h long") for h in (x, y))
    want = {(a, b) for a in x for b in y if ((a ^ b) & (2**64 - 1)).bit_count() <= 10}
    for rows in (10**5, 10**6, 10**8):
        assert {tuple(r) for r in C.near_hashes(left, right, 10, rows).collect()} == want


def test_the_text_report_shows_where_a_crop_lies(spark):
    found = spark.createDataFrame([("/a", "/b", 0.9, 0.9, 0.1, 0.9, (5, 6, 70, 80), 0.95, [])], schemas.SCORED_PAIRS)
    lines = list(report.text_lines(found, recs(spark, rec("/a", width=200), rec("/b"))))
    assert any("at 5,6 70x80" in x for x in lines)


def _beside_halves(add, times):
    """Numbers that single precision rounds to another gray value than double precision does."""
    f = np.float32
    near = [y for k in range(times) for x in [f((k + 0.5) / times - add)] for y in (x, np.nextafter(x, f(9)), np.nextafter(x, f(-9)))]
    return [float(x) for x in near if np.floor(float(f((x + f(add)) * f(times))) + 0.5) != np.floor(float(f(x + f(add))) * times + 0.5) or np.floor(float(f((x + f(add)) * f(times))) + 0.5) != np.floor((float(x) + add) * times + 0.5)]


@pytest.mark.parametrize(("name", "add", "times"), [("color_histogram", 0.25, 500), ("dhash_kernel", 0.5, 255), ("phash_kernel", 0.5, 255), ("whash_kernel", 0.5, 255)])
def test_gray_values_round_as_in_sql(spark, tmp_path, name, add, times):
    duckdb = pytest.importorskip("duckdb")
    from twinlens.plans import queries as Q

    beside, rng = _beside_halves(add, times), np.random.default_rng(3)
    rows = []
    for k in range(300):  # beside a half among neighbours on the gray scale, so that a step of one shows; frequencies of such rows would tie
        x = rng.choice(beside)
        values = rng.choice(beside, 64) if name == "phash_kernel" else rng.permutation([x] * 22 + [x + 1 / times] * 21 + [x - 1 / times] * 21)
        rows.append((k, [float(np.float32(v)) for v in values], 0))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(Q.ORACLE_SQL[name]).fetchall()
    got = Q.QUERIES[name](spark, f"file://{tmp_path}").collect()
    assert sorted(want) == sorted(tuple(r) for r in got)


def test_equal_middle_frequencies_are_told_apart_as_in_sql(spark, tmp_path):
    """Images that equal their transpose; on one thread the SQL's sums have one order, on several they haven't."""
    duckdb = pytest.importorskip("duckdb")
    from twinlens.plans import queries as Q

    rows = []
    for seed in range(200):
        x = np.random.default_rng(seed).integers(0, 256, (8, 8))
        image = np.triu(x) + np.triu(x, 1).T
        rows.append((seed, [float(np.float32(v / 255 - 0.5)) for v in image.ravel()], 0))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(Q.ORACLE_SQL["phash_kernel"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in Q.phash_kernel(spark, f"file://{tmp_path}").collect())


def test_growing_sides_are_not_broadcast(spark):
    """A broadcast goes through the driver, and band keys and written tables are larger than Spark estimates."""
    from twinlens.plans.report import member_rows

    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    records = recs(spark, *(rec(f"/{k:02d}", k, k, k, width=50 + 90 * (k % 2)) for k in range(20)))
    scored = pairs(spark, *(pair(f"/{k:02d}", f"/{k + 1:02d}", 0.9) for k in range(0, 18, 2)))
    tiles = spark.createDataFrame([("/03", 0, 0, 0, 50, 50, 1, 1, 1)], schemas.TILE_HASHES)
    full = C.hash_candidates(records, nested_rows=0)
    members = G.group_members(scored, records)
    limit, C.NESTED_ROWS = C.NESTED_ROWS, 0
    found = [full, C.tile_candidates(records, tiles, full), C.size_mismatches(records, full), C.with_records(full, records, ["width"]), members]
    C.NESTED_ROWS = limit
    found += [G.duplicate_groups(scored, records), G.member_attribution(scored, members), G.clean_plan(scored, records), member_rows(scored, records)]
    assert not [k for k, df in enumerate(found) if "BroadcastHashJoin" in plan(df)]


def test_no_mismatch_is_shuffled(spark):
    """The known pairs are found by the small image, not by a join with all pairs."""
    hashes = (0, -1, 2**32 - 1, 0x5555555555555555)
    records = recs(spark, *(rec(f"/{k:02d}", *[hashes[k % 4]] * 3, width=50 + 90 * (k % 5)) for k in range(30)))
    known = C.hash_candidates(records)
    every = {tuple(x) for x in C.size_mismatches(records).select("small_path", "large_path").collect()}
    seen = {tuple(sorted(x)) for x in known.select("path_a", "path_b").collect()}
    want = {x for x in every if tuple(sorted(x)) not in seen}
    assert want and want != every
    for limit in (C.NESTED_ROWS, 0):
        was, C.NESTED_ROWS = C.NESTED_ROWS, limit
        found = C.size_mismatches(records, known)
        C.NESTED_ROWS = was
        assert sorted(want) == sorted(tuple(x) for x in found.select("small_path", "large_path").collect())
        assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_most_similar_larger_images(spark, monkeypatch):
    """Only the best pairs of each part become rows; many equal histograms are told apart by path."""
    rng = np.random.default_rng(5)
    some = rng.normal(size=(6, 64)).astype(np.float32).tolist()
    records = recs(spark, *(rec(f"/{k:03d}", k % 40, k % 40, k % 40, width=[0, 30, 80, 100, 400, 900][k % 6], hist=some[rng.integers(6)]) for k in range(200)))
    known = C.hash_candidates(records, {"phash": 1, "dhash": 0, "whash": 0})
    whole = C.size_mismatches(records, known).select("small_path", "large_path", "small_color_hist", "large_color_hist").collect()
    want = {}
    for r in whole:
        similarity = 0.0
        for x, y in zip(r.small_color_hist, r.large_color_hist, strict=True):
            similarity += x * y
        want.setdefault(r.small_path, []).append((-similarity, r.large_path))
    want = {(a, b, -s) for a, found in want.items() for s, b in sorted(found)[:7]}
    monkeypatch.setattr(C, "LARGE_ROWS", 70)
    monkeypatch.setattr(C, "SMALL_ROWS", 60)
    found = C.size_mismatch_candidates(records, known, per_small=7)
    assert want == {(r.small_path, r.large_path, r.similarity) for r in found.collect()}
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_written_tables_hand_freed_native_memory_back(spark):
    """The driver's JVM doesn't keep what it has freed."""
    import re
    import time

    from twinlens.sources.scratch import written

    jvm = spark.sparkContext._jvm

    def megabytes():
        with open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    for _ in range(4):  # first runs take heap and classes
        written(spark.range(3)).count()
    stay, go = jvm.java.util.Vector(), jvm.java.util.Vector()
    for k in range(2500):
        (go if k % 10 else stay).add(jvm.java.nio.ByteBuffer.allocateDirect(100_000))
    go.removeAllElements()
    jvm.System.gc()
    time.sleep(1)
    before = megabytes()
    assert written(spark.range(3)).count() == 3
    assert megabytes() < before - 80 and stay.size() == 250
