"""A vector index that is built once, kept in a folder, and loaded to answer sets of queries.

Centres are fitted on a bounded sample; every row is filed under the nearest one. A query looks at
the cells whose centres are nearest; to be exact it then looks at all others that may hold a nearer
row, which the distance of a cell's centre and its radius tell. Cells of many rows are split, so
a group of copies, however large, is no single task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figloom.operators.search import _block_top, _first, _vectors

#: Rows on which centres are fitted, about; all rows are filed.
SAMPLE = 20_000
#: Centres at most; they are held by every worker.
MOST_CELLS = 4096
#: Rows of a part of a cell, and queries that look at it at once, about.
PART_ROWS, PART_QUERIES = 50_000, 10_000
ROUNDS = 12
#: Rows of the sample by which the number of cells to look at is chosen, and the recall wanted of them.
TRIED, RECALL = 256, 0.95


def fit_centres(sample: np.ndarray, cells: int, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a sample by k-means from a random start; equal rows make no two centres."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), min(cells, len(distinct)), replace=False)]
    for _ in range(rounds):
        at, _ = nearest_centres(sample, centres, 1)
        count = np.bincount(at[:, 0], minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at[:, 0], sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_centres(rows: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of the n nearest centres of each row, nearest first."""
    far = (rows**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * rows @ centres.T
    n = min(n, len(centres))
    some = np.argpartition(far, n - 1, axis=1)[:, :n]
    order = np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable")
    at = np.take_along_axis(some, order, 1)
    return at, np.maximum(np.take_along_axis(far, at, 1), 0)


def enough_probes(sample: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """How many cells it takes to find RECALL of the k nearest rows of the sample, for some of its
    rows. In all rows the nearest are nearer, so they take no more."""
    at = nearest_centres(sample, centres, 1)[0][:, 0]
    rank_of = np.empty(len(centres), dtype=np.int64)
    ranks = []
    for row in sample[:TRIED]:
        near = np.argsort(((sample - row) ** 2).sum(1), kind="stable")[: k + 1]
        rank_of[nearest_centres(row[None], centres, len(centres))[0][0]] = np.arange(len(centres))
        ranks.append(rank_of[at[near]])
    return int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1


@dataclass(frozen=True)
class Index:
    """rows: cell, part, key, vector. By cell: centres, radius, number of parts. probes: cells that
    it takes to find most of the nearest rows."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    probes: int


def build_index(df: DataFrame, key: str, vector: str, root: str, cells: int | None = None, seed: int = 42) -> None:
    """File every row with a key and a vector under ``root``.

    Vectors have one length. Without ``cells`` there are about as many as the root of the rows.
    Rows for the fit are chosen by a hash of their key and vector. The folder counts once its
    manifest is there; an index under the same folder is replaced. An empty table has no cells.
    """
    from figloom.sources.sinks import replace_file
    from figloom.workspace import materialize

    spark = df.sparkSession
    rows = _vectors(df, key, vector, "key")
    total = rows.count()
    share = int((1 << 30) * min(1.0, SAMPLE / max(1, total)))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "key", "vector"), F.lit(1 << 30)) < F.lit(max(1, share))).select("vector").limit(4 * SAMPLE)
    sample = np.array([r[0] for r in chosen.collect()], dtype=np.float64)
    if total and not len(sample):
        sample = np.array([rows.first()["vector"]], dtype=np.float64)
    wanted = min(MOST_CELLS, cells or max(1, int(total**0.5)))
    centres = fit_centres(sample, wanted, seed) if total else np.zeros((0, 0))
    probes = enough_probes(sample, centres) if total else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch["vector"].to_numpy(zero_copy_only=False))
                at, far = nearest_centres(v, centres, 1)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), batch["key"], batch["vector"], pa.array(np.sqrt(far[:, 0]))], ["cell", "key", "vector", "far"])

    filed = materialize(rows.mapInArrow(run, "cell int, key long, vector array<double>, far double"), "filed")
    # One row per cell.
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    parts = [max(1, -(-sizes.get(c, (0, 0.0))[0] // PART_ROWS)) for c in range(len(centres))]
    cell_table = [(c, parts[c], sizes.get(c, (0, 0.0))[0], float(sizes.get(c, (0, 0.0))[1]), centres[c].tolist()) for c in range(len(centres))]
    many = F.broadcast(spark.createDataFrame([(c, p) for c, p, *_ in cell_table], "cell int, parts int"))
    # Equal rows of a cell are dealt too: the part depends on the key.
    placed = filed.join(many, "cell").select("cell", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), "key", "vector")
    name = f"rows-{total}-{seed}-{len(centres)}"
    placed.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{root}/{name}")
    spark.createDataFrame(cell_table, "cell int, parts int, rows long, radius double, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/cells-{name}")
    replace_file(spark, json.dumps({"rows": name, "cells": f"cells-{name}", "total": total, "probes": probes}), f"{root}/_manifest")
    _loaded.pop((spark.sparkContext.applicationId, root), None)


_loaded: dict[tuple[str, str], Index] = {}


def load_index(spark: SparkSession, root: str) -> Index:
    """The index under ``root``; its cells are read once a session, its rows when searched."""
    from figloom.sources.sinks import read_file

    at = spark.sparkContext.applicationId, root
    if at not in _loaded:
        held = json.loads(read_file(spark, f"{root}/_manifest"))
        cells = spark.read.parquet(f"{root}/{held['cells']}").orderBy("cell").limit(MOST_CELLS).collect()
        centres = np.array([r["centre"] for r in cells], dtype=np.float64)
        _loaded[at] = Index(spark.read.parquet(f"{root}/{held['rows']}"), centres, np.array([r["radius"] for r in cells]), np.array([r["parts"] for r in cells]), held["probes"])
    return _loaded[at]


def _look(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query, key, distance): the k nearest rows of each cell that a query (query, vector, cell) asks."""
    spark = asked.sparkSession
    # One row per cell: how many parts its rows have, and how many lots those who ask it.
    lots = asked.groupBy("cell").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("lots"))
    parts = F.broadcast(spark.createDataFrame([(c, int(p)) for c, p in enumerate(index.parts)], "cell int, parts int"))
    lot = F.pmod(F.xxhash64("query"), "lots").cast("int").alias("lot")
    few = F.broadcast(lots)
    left = index.rows.join(few, "cell").select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "key", "vector")
    right = asked.join(few, "cell").join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), lot, "query", "vector")

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"query": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if not rows.num_rows or not queries.num_rows:
            return none
        order = np.argsort(queries["query"].to_numpy(), kind="stable")
        matrix = np.stack(queries["vector"].to_numpy(zero_copy_only=False))[order]
        found = _block_top(queries["query"].to_numpy()[order], matrix, k)(iter(rows.select(["vector", "key"]).combine_chunks().to_batches()))
        return pa.concat_tables([none, *(pa.Table.from_batches([b]) for b in found)])

    keys = ["cell", "part", "lot"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query long, key long, distance double")


def _ask(queries: DataFrame, pick) -> DataFrame:
    """(query, vector, cell): the cells that ``pick`` gives for the rows of a batch, as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = pick(np.stack(batch["vector"].to_numpy(zero_copy_only=False)), batch)
                row = np.repeat(np.arange(batch.num_rows), [len(c) for c in cells])
                flat = np.concatenate(cells).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(row)), batch["vector"].take(pa.array(row)), pa.array(flat)], ["query", "vector", "cell"])

    return queries.mapInArrow(run, "query long, vector array<double>, cell int")


def search_index(index: Index, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query, key, distance, place): the k nearest rows for each query row, ties by key.

    Looks at the ``probes`` nearest cells, by default as many as the index was found to need; with ``exact`` then at every other cell that may hold a
    row as near as the k-th found, so that nothing is missed. Query rows without key or vector are
    left out; keys of queries are unique.
    """
    from figloom.workspace import materialize

    asked = _vectors(queries, key, vector, "query")
    spark = asked.sparkSession
    if not len(index.centres):
        return spark.createDataFrame([], "query long, key long, distance double, place int")
    centres, radius, probes = index.centres, index.radius, min(probes or index.probes, len(index.centres))
    near = _look(index, _ask(asked, lambda v, _: list(nearest_centres(v, centres, probes)[0])), k)
    if not exact:
        return _first(near, "distance", k)
    first = materialize(_first(near, "distance", k), "index-first").drop("place")
    reach = first.groupBy("query").agg(F.when(F.count("*") == k, F.max("distance")).alias("reach"))

    def others(v: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
        at, far = nearest_centres(v, centres, len(centres))
        limit = np.sqrt(np.where(batch["reach"].is_null().to_numpy(zero_copy_only=False), np.inf, batch["reach"].fill_null(0.0).to_numpy()))
        far = np.sqrt(far)
        # A margin for rounding; the cells already seen are left out.
        may = far - radius[at] <= limit[:, None] + 1e-6 * (1 + far)
        may[:, :probes] = False
        return [a[m] for a, m in zip(at, may)]

    further = _look(index, _ask(asked.join(reach, "query", "left"), others), k)
    return _first(first.unionByName(further), "distance", k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(queries, recall): the share of true results (query, key) that were found."""
    hit = truth.join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
