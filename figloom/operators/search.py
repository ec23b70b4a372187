"""Exact vector search: single queries, filtered and in stages, and query sets in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of queries and of their k nearest that are sent to a worker and held there at once; a
#: larger query set takes several passes over the rows.
BLOCK_BYTES = 32 << 20
#: Queries of a block whose candidates are ranked at once, and exact distances computed at once.
GROUP, PAIRS = 128, 65_536


#: Ids of a stage that come to the driver at most.
MAX_STAGE = 100_000


def distances(vector: Column, parts: dict[str, tuple[int, list[float]]]) -> Column:
    """A struct with, for each name, the squared distance of a part of the vector, from a
    0-based start on, to a query of its length; null where the vector is null or too short."""
    wanted = {n: (start, np.array(q, dtype=np.float64)) for n, (start, q) in parts.items()}
    least = max(start + len(q) for start, q in wanted.values())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = batch.to_numpy(zero_copy_only=False)
            usable = np.array([v is not None and len(v) >= least for v in rows], dtype=bool)
            v = np.stack([r[:least] for r in rows[usable]]).astype(np.float64) if usable.any() else np.zeros((0, least))
            out = []
            for start, q in wanted.values():
                d = np.zeros(len(rows))
                d[usable] = ((v[:, start : start + len(q)] - q) ** 2).sum(1)
                out.append(pa.array(d, mask=~usable))
            yield pa.StructArray.from_arrays(out, list(wanted))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ", ".join(f"{n} double" for n in wanted))(vector)


def distance_to(vector: Column, query: list[float]) -> Column:
    return distances(vector, {"d": (0, query)}).getField("d")


def nearest(df: DataFrame, distance: str, key: str, k: int) -> DataFrame:
    """The k rows of least distance, ties by key; a top-k of each partition, never a full sort."""
    return df.orderBy(distance, key).limit(k)


def filtered_nearest(df: DataFrame, distance: str, key: str, allowed: DataFrame, fetch: int, k: int) -> DataFrame:
    """First the ``fetch`` nearest of all rows, then those allowed, then k: fewer may be left
    although more are allowed."""
    return nearest(nearest(df, distance, key, fetch).join(allowed.select(key).distinct(), key, "left_semi"), distance, key, k)


def hierarchical(df: DataFrame, key: str, distances: tuple[str, str, str], t1: int = 100, t2: int = 10, k: int = 3, fetch2: int = 100, fetch3: int = 1000) -> DataFrame:
    """Search in three views, each among the results of the one before.

    Stage two looks at the ``fetch2`` nearest for each id of stage one, stage three at the
    ``fetch3`` nearest for each id of stage two. An empty stage gives an empty result. The
    ids of the first two stages (at most t1 and t2) come to the driver, so each view is scanned once.
    """
    d1, d2, d3 = distances
    s1 = _ids(nearest(df, d1, key, t1), key)
    s2 = _ids(nearest(nearest(df, d2, key, fetch2 * len(s1)).filter(F.col(key).isin(s1)), d2, key, t2), key)
    return nearest(nearest(df, d3, key, fetch3 * len(s2)).filter(F.col(key).isin(s2)), d3, key, k)


def _ids(stage: DataFrame, key: str) -> list:
    """The ids of a stage: a result no larger than the t1 or t2 asked for."""
    ids = [r[0] for r in stage.select(key).limit(MAX_STAGE + 1).collect()]
    if len(ids) > MAX_STAGE:
        raise ValueError(f"a stage of more than {MAX_STAGE} ids")
    return ids


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, added up from the first value on as SQL does, so that
    equal vectors have equal distances wherever they are computed."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for j in range(a.shape[-1]):
        out += (a[..., j] - b[..., j]) ** 2
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, keys) of a few thousand rows at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            yield np.stack(batch["vector"].to_numpy(zero_copy_only=False)).astype(np.float64), batch["key"].to_numpy(zero_copy_only=False)


def _block_top(ids: np.ndarray, queries: np.ndarray, k: int, view: slice = slice(None), others: dict[str, slice] = {}):
    """The k nearest rows of a partition by a part of the vectors, with their distances by other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (queries[:, view] ** 2).sum(1)
        #: By first query of a group: (query, key, distances), up to k a query in order of (distance, key).
        best = {g: (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((1 + len(others), 0))) for g in range(0, len(ids), GROUP)}
        for whole, keys in _slices(batches):
            v = whole[:, view]
            lengths = (v**2).sum(1)
            for g, (at, key, dist) in best.items():
                q = queries[g : g + GROUP, view]
                both = norms[g : g + GROUP, None] + lengths
                fast = both - 2 * q @ v.T
                # Neither formula is off by more than half of this.
                margin = 4 * (q.shape[1] + 8) * np.finfo(np.float64).eps * both
                # All rows that may be among the k nearest, however many are equally far.
                limit = np.partition(fast + margin, k - 1, axis=1)[:, k - 1] if k <= len(v) else np.full(len(q), np.inf)
                full = np.flatnonzero(np.bincount(at, minlength=len(q)) == k)
                limit[full] = np.fmin(limit[full], dist[0, np.searchsorted(at, full, "right") - 1])
                asked, row = np.nonzero(~(fast - margin > limit[:, None]))
                exact = np.concatenate([_exact(q[asked[i : i + PAIRS]], v[row[i : i + PAIRS]]) for i in range(0, max(1, len(row)), PAIRS)])
                nearest = np.r_[dist[0], exact]
                order = np.lexsort((np.r_[key, keys[row]], nearest, np.r_[at, asked]))
                sorted_at = np.r_[at, asked][order]
                order = order[np.arange(len(order)) - np.searchsorted(sorted_at, sorted_at) < k]
                new = order[order >= len(at)] - len(at)
                more = np.zeros((len(others), len(nearest)))
                more[:, : len(at)] = dist[1:]
                for n, part in enumerate(others.values()):
                    more[n, len(at) + new] = _exact(queries[g + asked[new], part], whole[row[new], part])
                best[g] = np.r_[at, asked][order], np.r_[key, keys[row]][order], np.vstack([nearest, more])[:, order]
        for g, (at, key, dist) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids[g + at]), pa.array(key), *map(pa.array, dist)], ["query", "key", "distance", *others])

    return run


def _block_ranks(ids: np.ndarray, queries: np.ndarray, members: dict[int, list], views: dict[str, slice]):
    """For each query's members (key, distance in each view): the rows of a partition that come
    before them in each view, by (distance, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [i for i, q in enumerate(ids) if q in members]
        keys = {i: np.array([m[0] for m in members[ids[i]]], dtype=np.int64) for i in asked}
        dist = {i: np.array([m[1:] for m in members[ids[i]]], dtype=np.float64).reshape(len(keys[i]), len(views)) for i in asked}
        order = {i: [np.lexsort((keys[i], dist[i][:, n])) for n in range(len(views))] for i in asked}
        before = {i: np.zeros((len(keys[i]), len(views)), dtype=np.int64) for i in asked}
        for v, row_keys in _slices(batches):
            sorted_keys, place = np.unique(row_keys, return_inverse=True)
            row = np.empty(len(v), dtype=np.complex128)
            for i in asked:
                # A member lies between the keys of the rows, so none is equal to it.
                at = np.searchsorted(sorted_keys, keys[i]) - 0.5
                for n, part in enumerate(views.values()):
                    row.real, row.imag = _exact(queries[i, part][None], v[:, part]), place
                    member = np.empty(len(at), dtype=np.complex128)
                    member.real, member.imag = dist[i][:, n], at
                    o = order[i][n]
                    less = np.bincount(np.searchsorted(member[o], row), minlength=len(o) + 1)
                    before[i][o, n] += np.cumsum(less)[:-1]
        for i in asked:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i], len(keys[i]))), pa.array(keys[i]), *map(pa.array, before[i].T)], ["query", "key", *(f"before_{n}" for n in views)])

    return run


def _vectors(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Rows with a key and a vector, as long and doubles."""
    return df.select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("vector")).filter(F.col(name).isNotNull() & F.col("vector").isNotNull())


def _blocks(queries: DataFrame, key: str, vector: str, k: int, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of query rows, as many at a time as BLOCK_BYTES hold with their k nearest, and
    no more than ``most``."""
    from figloom.operators.sync import dense_ordinals

    asked = dense_ordinals(_vectors(queries, key, vector, "query"), [F.col("query")], "n")
    found = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    size = max(1, BLOCK_BYTES // (8 * ((found["width"] or 0) + 3 * k + 1)))
    size = size if most is None else max(1, min(size, most))
    for start in range(0, found["n"], size):
        block = asked.filter((F.col("n") >= start) & (F.col("n") < start + size)).collect()
        yield np.array([r["query"] for r in block]), np.array([r["vector"] for r in block])


def _union(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f)
    return found


def _first(df: DataFrame, distance: str, k: int, place: str = "place") -> DataFrame:
    """The k first rows of each query by (distance, key), numbered."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("query").orderBy(distance, "key"))
    return df.withColumn(place, n).filter(F.col(place) <= k)


def nearest_for_each(corpus: DataFrame, key: str, vector: str, queries: DataFrame, k: int, view: slice = slice(None)) -> DataFrame:
    """(query, key, distance, place): the k nearest rows of the corpus for every query row, by the
    whole vector or a part of it.

    Queries go to the workers in blocks; a partition keeps k rows a query by matrix
    products, so k rows a query and partition are shuffled. Rows without a vector are left out.
    """
    rows = _vectors(corpus, key, vector, "key")
    blocks = [rows.mapInArrow(_block_top(ids, matrix, k, view), "query long, key long, distance double") for ids, matrix in _blocks(queries, key, vector, k)]
    if not blocks:
        return corpus.sparkSession.createDataFrame([], "query long, key long, distance double, place int")
    return _first(_union(blocks), "distance", k)


def filtered_nearest_for_each(corpus: DataFrame, key: str, vector: str, queries: DataFrame, view: slice, allowed: DataFrame, fetch: int, k: int) -> DataFrame:
    """(query, key, distance, place): ``filtered_nearest`` for every query row."""
    found = nearest_for_each(corpus, key, vector, queries, fetch, view).drop("place")
    return _first(found.join(allowed.select(F.col(key).cast("long").alias("key")).distinct(), "key", "left_semi"), "distance", k).select("query", "key", "distance", "place")


def hierarchical_for_each(corpus: DataFrame, key: str, vector: str, queries: DataFrame, views: tuple[slice, slice, slice], t1: int = 100, t2: int = 10, k: int = 3, fetch2: int = 100, fetch3: int = 1000) -> DataFrame:
    """(query, key, distance, place): ``hierarchical`` for every query row; ``key`` is unique.

    The t1 of stage one are a written (query, key) table with their distances in the later views.
    Whether one is among the nearest fetched by a later view is whether fewer rows come before it
    there, so a second scan counts those instead of fetching that many: t1 rows a query and
    partition are shuffled in each scan. Queries go to the workers in blocks, of which the ids of
    stage one, at most MAX_STAGE, come to the driver (t1 of them if that is more).
    """
    from figloom.workspace import materialize

    rows, later, out = _vectors(corpus, key, vector, "key"), {"d2": views[1], "d3": views[2]}, []
    for ids, matrix in _blocks(queries, key, vector, t1, MAX_STAGE // max(1, t1)):
        top = rows.mapInArrow(_block_top(ids, matrix, t1, views[0], later), "query long, key long, distance double, d2 double, d3 double")
        s1 = materialize(_first(top, "distance", t1), "stage-one")
        members: dict[int, list] = {}
        for r in s1.select("query", "key", "d2", "d3").collect():
            members.setdefault(r["query"], []).append((r["key"], r["d2"], r["d3"]))
        ranks = rows.mapInArrow(_block_ranks(ids, matrix, members, later), "query long, key long, before_d2 long, before_d3 long")
        ranks = ranks.groupBy("query", "key").agg(F.sum("before_d2").alias("before_d2"), F.sum("before_d3").alias("before_d3"))
        s1 = s1.select("query", "key", "d2", "d3").join(ranks, ["query", "key"])
        s2 = _first(_within(s1, "before_d2", fetch2), "d2", t2)
        out.append(_first(_within(s2, "before_d3", fetch3), "d3", k).select("query", "key", F.col("d3").alias("distance"), "place"))
    if not out:
        return corpus.sparkSession.createDataFrame([], "query long, key long, distance double, place int")
    return _union(out)


def _within(stage: DataFrame, before: str, fetch: int) -> DataFrame:
    """The rows of a stage among the nearest fetched, ``fetch`` for each id of the query's stage."""
    from pyspark.sql.window import Window

    size = F.count("*").over(Window.partitionBy("query"))
    return stage.withColumn("size", size).filter(F.col(before) < fetch * F.col("size")).drop("size", "place")


#: Classes whose sums a task holds at once.
CLASSES_HELD = 4096


def prototypes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, prototype): the mean of the normalized vectors of each class, normalized.

    Every task adds up its vectors class by class; only these sums are shuffled. A null label is a
    class; null, empty and zero vectors are left out.
    """
    from figloom.functions.vectors import normalized

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for batch in batches:
            kind = batch["label"].type
            codes = batch["label"].dictionary_encode(null_encoding="encode")
            at, labels = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            vectors = batch["vector"].to_numpy(zero_copy_only=False)
            sizes = np.array([len(v) for v in vectors])
            for size in set(sizes.tolist()):
                mine = np.flatnonzero(sizes == size)
                v = np.stack(vectors[mine]).astype(np.float64)
                norm = np.sqrt((v**2).sum(1))
                mine, v = mine[norm > 0], v[norm > 0] / norm[norm > 0, None]
                for code in np.unique(at[mine]):
                    rows = v[at[mine] == code]
                    total, n = sums.get((labels[code], size), (0.0, 0))
                    sums[labels[code], size] = total + rows.sum(0), n + len(rows)
            if len(sums) > CLASSES_HELD:
                yield _summed(sums, kind)
                sums = {}
        if sums:
            yield _summed(sums, kind)

    rows = df.select(F.col(label).alias("label"), F.col(vector).alias("vector")).filter("size(vector) > 0")
    parts = rows.mapInArrow(run, f"label {df.schema[label].dataType.simpleString()}, n long, total array<double>")
    each = parts.select("label", "n", F.posexplode("total").alias("pos", "x")).groupBy("label", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    # As many values as the vectors have dimensions.
    listed = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return listed.select(F.col("label").alias(label), normalized(F.col("v.x")).alias("prototype"))


def _summed(sums: dict, kind: pa.DataType) -> pa.RecordBatch:
    keys = [k for k, _ in sums]
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([n for _, n in sums.values()], pa.int64()), pa.array([t.tolist() for t, _ in sums.values()], pa.list_(pa.float64()))], ["label", "n", "total"])


def classify(df: DataFrame, vector: str, classes: DataFrame, label: str, scale: float = 100.0, most: int = 1000) -> DataFrame:
    """``df`` plus class and confidence: the most likely class by scaled cosine similarity, of
    equal ones the least label; null for a null or zero vector. The classes are collected; more
    than ``most`` are refused."""
    known = classes.orderBy(label).limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} classes")
    unit = np.array([r["prototype"] for r in known], dtype=np.float64)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = batch.to_numpy(zero_copy_only=False)
            usable = np.array([v is not None and len(unit) > 0 and bool(np.dot(v, v) > 0) for v in rows], dtype=bool)
            at, sure = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows))
            if usable.any():
                v = np.stack(rows[usable]).astype(np.float64)
                s = scale * (v / np.sqrt((v**2).sum(1))[:, None]) @ unit.T
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                at[usable], sure[usable] = p.argmax(1), p.max(1)
            yield pa.StructArray.from_arrays([pa.array(at, mask=~usable), pa.array(sure, mask=~usable)], ["at", "sure"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = df.withColumn("_p", F.arrow_udf(run, "at int, sure double")(F.col(vector).cast("array<double>")))
    labels = F.array(*[F.lit(r[label]) for r in known]) if known else F.array().cast(f"array<{dict(classes.dtypes)[label]}>")
    return out.select(*df.columns, F.get(labels, F.col("_p.at")).alias("class"), F.col("_p.sure").alias("class_confidence"))
