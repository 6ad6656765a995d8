"""Command line: scan, find, report, clean."""

from __future__ import annotations

import argparse
import sys

from twinlens import __version__
from twinlens.operators.groups import STRATEGIES


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="twinlens", description="Find near-duplicate images.")
    parser.add_argument("--db", default="twinlens-store", help="folder of the feature store")
    parser.add_argument("--version", action="version", version=__version__)
    jobs = parser.add_subparsers(dest="job", required=True)

    scan = jobs.add_parser("scan", help="hash new and changed images")
    scan.add_argument("paths", nargs="+")
    scan.add_argument("--workers", type=int, default=8)

    find = jobs.add_parser("find", help="find and score similar pairs")
    find.add_argument("--workers", type=int, default=4)
    for name, bits in (("phash", 10), ("dhash", 10), ("whash", 12)):
        find.add_argument(f"--threshold-{name}", type=int, default=bits)
    find.add_argument("--min-score", type=float, default=0.80)
    find.add_argument("--no-crops", action="store_true", help="don't refine pairs by crop detection")
    find.add_argument("--find-crops", action="store_true", help="also search small images in much larger ones")
    find.add_argument("--crop-min-ratio", type=float, default=4.0)
    find.add_argument("--crop-max-per-image", type=int, default=20)
    find.add_argument("--crop-min-inliers", type=int, default=12)

    report = jobs.add_parser("report", help="show groups of duplicates")
    report.add_argument("--min-score", type=float, default=0.80)
    report.add_argument("--json", metavar="FILE")
    report.add_argument("--keep", choices=STRATEGIES, default="largest")

    clean = jobs.add_parser("clean", help="move duplicates to the trash; only shows them unless forced")
    clean.add_argument("--min-score", type=float, default=0.90)
    clean.add_argument("--keep", choices=STRATEGIES, default="largest")
    clean.add_argument("--dry-run", action="store_true", default=True)
    clean.add_argument("--force", action="store_true")
    return parser


def _session(workers: int):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("twinlens").config("spark.sql.shuffle.partitions", str(max(8, 2 * workers))).getOrCreate()


def cmd_scan(args, store) -> int:
    from twinlens.plans import jobs

    done = jobs.scan(store, args.paths, args.workers)
    for path, error in done["errors"]:
        print(f"error: {path}: {error}", file=sys.stderr)
    print(f"{done['files']} files, {done['cached']} unchanged, {done['hashed']} hashed, {done['failed']} failed in {done['seconds']:.1f} s")
    return 0


def cmd_find(args, store) -> int:
    from twinlens.plans import jobs

    limits = {k: getattr(args, f"threshold_{k}") for k in ("phash", "dhash", "whash")}
    done = jobs.find(store, limits, args.min_score, not args.no_crops, args.find_crops, args.crop_min_ratio, args.crop_max_per_image, args.crop_min_inliers)
    if done is None:
        print("The store is empty: run scan first.", file=sys.stderr)
        return 1
    print(f"{done['candidates']} candidates, {done['scored']} scored, {done['failed']} failed, {done['duplicates']} at {args.min_score:g} or more in {done['seconds']:.1f} s")
    return 0


def cmd_report(args, store) -> int:
    from twinlens.plans import jobs

    lines = jobs.show(store, args.min_score, args.keep, args.json)
    if lines is None:
        print("No scored pairs: run find first.", file=sys.stderr)
        return 1
    for line in lines:
        print(line)
    return 0


def cmd_clean(args, store) -> int:
    from twinlens.plans import jobs
    from twinlens.plans.report import plain_bytes

    done = jobs.clean(store, args.min_score, args.keep)
    print(f"{done['files']} files, {plain_bytes(done['bytes'])}")
    if args.dry_run:
        for row in done["plan"].orderBy("path").toLocalIterator():
            print(f"would move {row.path} (keeps {row.canonical})")
        return 0
    if not done["files"] or input("Move them to the trash? [y/N] ").strip().lower() != "y":
        return 0
    done = jobs.clean(store, args.min_score, args.keep, jobs.move_to_trash)
    print(f"{done['removed']} moved, {done['failed']} failed")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if getattr(args, "force", False):
        args.dry_run = False
    from twinlens.plans import jobs

    store = jobs.open_store(_session(getattr(args, "workers", 4)), args.db)
    return {"scan": cmd_scan, "find": cmd_find, "report": cmd_report, "clean": cmd_clean}[args.job](args, store)


if __name__ == "__main__":
    sys.exit(main())
