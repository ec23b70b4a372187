"""Folders of papers and figures that follow the decision about their paper."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.functions.text import slug_or_pending

PENDING = "pending_unknown"


def plan_moves(pending: DataFrame, decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """(kind, platform_id, year, target, source_path, target_path, status) for each pending folder.

    ``pending``: kind, platform_id, year, root (what is above the year); ``decisions``: platform_id,
    decision, one row each; ``existing``: path of each folder there is. The year stays. status:
    "missing" without a decision row, "skipped" where the decision is still pending, "exists" where
    the target is already there, else "moved". Null platform_ids are missing.
    """
    wanted = decisions.select("platform_id", slug_or_pending(F.col("decision")).alias("target"))
    joined = pending.join(wanted, "platform_id", "left")
    at = lambda folder: F.concat_ws("/", "root", F.col("year").cast("string"), folder, "platform_id")
    joined = joined.withColumns({"source_path": at(F.lit(PENDING)), "target_path": F.when(F.col("target").isNotNull(), at(F.col("target")))})
    there = existing.select(F.col("path").alias("target_path")).distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("target").isNull(), "missing").when(F.col("target") == PENDING, "skipped").when(F.col("there"), "exists").otherwise("moved")
    return joined.join(there, "target_path", "left").select("kind", "platform_id", "year", "target", "source_path", "target_path", status.alias("status"))


def apply_moves(plan: DataFrame, move: Callable[[str, str], None], exists: Callable[[str], bool], dry_run: bool = False, limit: int | None = None) -> DataFrame:
    """The plan with the status that each move had: "moved", "failed", or as planned.

    With ``dry_run`` nothing is moved. ``limit`` takes the first moves by kind and platform_id.
    ``move`` and ``exists`` work on paths and are called in the workers. A move that a lost task
    has already made counts as moved: its source is gone and its target there.
    """
    if limit is not None:
        plan = plan.filter("status = 'moved'").orderBy("kind", "platform_id").limit(limit)
    if dry_run:
        return plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status = batch["status"].to_pylist()
            for i, (source, target) in enumerate(zip(batch["source_path"].to_pylist(), batch["target_path"].to_pylist())):
                if status[i] != "moved" or (not exists(source) and exists(target)):
                    continue
                try:
                    move(source, target)
                except Exception:
                    status[i] = "failed"
            yield batch.set_column(batch.schema.get_field_index("status"), "status", pa.array(status, pa.string()))

    return plan.mapInArrow(run, plan.schema)


def moved_figure_paths(done: DataFrame, files: DataFrame, base: str) -> DataFrame:
    """(platform_id, figure_number, figure_path): new paths, relative to ``base``, of the figures in
    folders that were moved, for sync.keyed_update. ``files``: path, after the moves."""
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]+$", 1), F.regexp_extract("path", r"/Figure([^/]*)\.png$", 1)
    found = files.filter(F.col("path").rlike(r"/Figure[^/]*\.png$")).select(folder.alias("target_path"), name.alias("figure_number"), "path")
    moved = done.filter("status = 'moved' AND kind = 'figures'").select("target_path", "platform_id").distinct()
    relative = F.when(F.col("path").startswith(base.rstrip("/") + "/"), F.expr(f"substring(path, {len(base.rstrip('/')) + 2})")).otherwise(F.col("path"))
    return found.join(moved, "target_path").select("platform_id", "figure_number", relative.alias("figure_path"))


def move_counts(done: DataFrame) -> DataFrame:
    """How many moves of each kind had which status; "eligible" are those with a decision."""
    kinds = done.groupBy("kind", "status").agg(F.count("*").alias("assets"))
    eligible = done.filter(~F.col("status").isin("missing", "skipped")).agg(F.countDistinct("platform_id").alias("assets"))
    return kinds.unionByName(eligible.select(F.lit("all").alias("kind"), F.lit("eligible").alias("status"), "assets"))


def figure_placement(extracted: DataFrame, root: Column) -> DataFrame:
    """(platform_id, figure_number, source_path, target_path): where the pictures of an extractor go."""
    target = F.concat_ws("/", root, "platform_id", F.concat(F.lit("Figure"), "name", F.lit(".png")))
    return extracted.select("platform_id", F.col("name").alias("figure_number"), F.col("render_url").alias("source_path"), target.alias("target_path"))
