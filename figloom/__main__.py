"""Commands: python -m figloom COMMAND ... (see --help)."""

from __future__ import annotations

import argparse
import os
import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from figloom import api, schemas
from figloom.functions import text as X
from figloom.operators import assets, release, sync
from figloom.sources import files, sinks
from figloom.workspace import ship


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="figloom")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("select", help="files of a release to fetch, from a listing with a name a line")
    c.add_argument("listing")
    c.add_argument("--subset", choices=["accept", "reject", "all"], default="accept")
    c.add_argument("--no-core", dest="core", action="store_false")
    c.add_argument("--metadata", action="store_true")
    c.add_argument("--metadata-only", action="store_true")
    c = commands.add_parser("tasks", help="downloads to do, as JSON lines: what failed before, or all papers")
    c.add_argument("papers"), c.add_argument("base"), c.add_argument("out")
    c.add_argument("--failed"), c.add_argument("--ignore-failed", action="store_true"), c.add_argument("--limit", type=int)
    c = commands.add_parser("sync", help="insert new papers and update decisions; publishes a new snapshot")
    c.add_argument("staging"), c.add_argument("root")
    c = commands.add_parser("moves", help="move folders of papers that have a decision now")
    c.add_argument("root"), c.add_argument("staging"), c.add_argument("--dry-run", action="store_true"), c.add_argument("--limit", type=int)
    c = commands.add_parser("stats", help="sizes of a tree of figures by venue, year and decision")
    c.add_argument("root")
    c = commands.add_parser("validate", help="rows, ids, vectors and files of a release")
    c.add_argument("release"), c.add_argument("--rows", type=int, required=True)
    c.add_argument("--index", action="append", default=[], metavar="NAME=PATH"), c.add_argument("--file", action="append", default=[], metavar="NAME=PATH")
    return top


def _move(source: str, target: str) -> None:
    os.makedirs(os.path.dirname(target), exist_ok=True)
    shutil.move(source, target)


def _staging(spark: SparkSession, path: str):
    rows = files.jsonl(spark, path, schemas.PAPERS).filter("platform_id IS NOT NULL")
    return sync.latest_rows(rows, ["platform_id"], [F.col("year")])


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Does what the arguments say; prints a report and returns 0, or 1 where a check failed."""
    ship(spark)
    if args.command == "select":
        names = spark.read.text(args.listing).select(F.trim("value").alias("name"), F.monotonically_increasing_id().alias("n")).filter("name <> ''")
        for r in files.select_files(names, "name", "n", args.subset, args.core, args.metadata, args.metadata_only).toLocalIterator():
            print(r["name"])
    elif args.command == "tasks":
        before = files.failed_tasks(spark, args.failed, args.ignore_failed) if args.failed else None
        papers = files.jsonl(spark, args.papers, schemas.PAPERS)
        tasks = api.download_tasks(papers, args.base, args.limit) if before is None else before
        tasks = tasks if args.limit is None else tasks.orderBy("id").limit(args.limit)
        sinks.to_jsonl(tasks, args.out)
    elif args.command == "sync":
        staging = _staging(spark, args.staging)
        if sinks.is_published(spark, args.root):
            target = sinks.published(spark, args.root)
            print("new:", sync.missing_rows(target, staging, ["platform_id"]).count())
            print("changed:", sync.changed_rows(target, staging, ["platform_id"], "decision", "pending/unknown").count())
            staging = sync.sync(target, staging, ["platform_id"], "decision", "pending/unknown")
        print("published:", sinks.publish(staging, args.root))
    elif args.command == "moves":
        pending = files.pending_assets(spark, args.root).withColumn("root", F.concat(F.lit(args.root.rstrip("/") + "/"), "kind"))
        folders = files.listing(spark, args.root).select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("path"))
        plan = assets.plan_moves(pending, _staging(spark, args.staging).select("platform_id", "decision"), folders)
        # Fixed before anything moves, as the plan reads the tree.
        plan = spark.createDataFrame(plan.collect(), plan.schema)
        for r in assets.move_counts(assets.apply_moves(plan, _move, os.path.exists, args.dry_run, args.limit)).orderBy("kind", "status").collect():
            print(r["kind"], r["status"], r["assets"])
    elif args.command == "stats":
        sizes = files.tree_sizes(spark, args.root)
        line = X.padded((F.col("conf"), 10), (F.col("year"), -6), (F.col("decision"), 40), (F.col("category"), 8), (X.human_bytes(F.col("size")), -12))
        for r in sizes.orderBy("conf", "year", "decision").select(line.alias("l")).collect():
            print(r["l"])
        for r in sizes.rollup("category").agg(F.sum("size").alias("size")).select(F.coalesce("category", F.lit("Total")).alias("c"), X.human_bytes(F.col("size")).alias("s")).orderBy("c").collect():
            print(r["c"], r["s"])
    else:
        named = lambda pairs: dict(p.split("=", 1) for p in pairs)
        data = files.jsonl(spark, args.release, schemas.RELEASE)
        report = release.check_release(data, args.rows, named(args.index), named(args.file)).collect()
        for r in report:
            print("ok  " if r["ok"] else "FAIL", r["check_"], f"expected {r['expected']:,}, found {r['actual']:,}")
        for column in ("venue", "cascade_path"):
            for r in data.groupBy(X.or_empty(F.col(column)).alias("v")).agg(F.count("*").alias("n")).orderBy("v").select("v", X.grouped(F.col("n")).alias("n")).collect():
                print(column, r["v"], r["n"])
        return 0 if all(r["ok"] for r in report) else 1
    return 0


def main() -> int:
    return run(SparkSession.builder.appName("figloom").getOrCreate(), parser().parse_args())


if __name__ == "__main__":
    sys.exit(main())
