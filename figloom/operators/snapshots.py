"""What changed between full snapshots of a keyed table.

Method: every key gets a persistent ordinal; a snapshot is then, per chunk of ordinals, one
compressed bitmap of the keys present and a vector of values aligned with the set bits.
AND-NOT of consecutive bitmaps gives additions and removals, AND gives the common keys whose
aligned values are compared.

Dictionary and containers are kept under a folder. A new snapshot is compared with the containers
of the one before, so no row of an older snapshot is read again. What a folder holds is said by its
manifest, which is renamed into place after the data is whole.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from figloom.functions.text import drop_blanks, strip_blanks
from figloom.workspace import materialize, scratch

#: Ordinals of one chunk share all but the low CHUNK_BITS bits.
CHUNK_BITS = 14
CHUNK = 1 << CHUNK_BITS
ARRAY_KIND, BITMAP_KIND, RUN_KIND = 0, 1, 2


def compress(low: np.ndarray) -> bytes:
    """Sorted distinct ordinals below CHUNK as the smallest of three containers:
    a list of 16-bit values, a plain bitmap, or runs of (start, length - 1)."""
    low = np.asarray(low, dtype=np.int64)
    if not len(low):
        return bytes([ARRAY_KIND])
    starts = np.flatnonzero(np.r_[True, np.diff(low) != 1])
    if min(4 * len(starts), 2 * len(low)) > CHUNK // 8:
        bits = np.zeros(CHUNK, dtype=np.uint8)
        bits[low] = 1
        return bytes([BITMAP_KIND]) + np.packbits(bits).tobytes()
    if 4 * len(starts) < 2 * len(low):
        lengths = np.diff(np.r_[starts, len(low)]) - 1
        return bytes([RUN_KIND]) + np.column_stack([low[starts], lengths]).astype("<u2").tobytes()
    return bytes([ARRAY_KIND]) + low.astype("<u2").tobytes()


def members(container: bytes | None) -> np.ndarray:
    """The ordinals of a container, rising; None is the empty one."""
    if not container:
        return np.zeros(0, dtype=np.int64)
    kind, body = container[0], np.frombuffer(container, dtype=np.uint8, offset=1)
    if kind == BITMAP_KIND:
        return np.flatnonzero(np.unpackbits(body))
    values = body.view("<u2").astype(np.int64)
    if kind == ARRAY_KIND:
        return values
    start, more = values.reshape(-1, 2).T
    ends = np.cumsum(more + 1)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - more - 1), more + 1)


def contains(container: bytes | None, values: np.ndarray) -> np.ndarray:
    """Which of some ordinals are in a container."""
    if not container or len(container) == 1:
        return np.zeros(len(values), dtype=bool)
    kind, body = container[0], np.frombuffer(container, dtype=np.uint8, offset=1)
    if kind == BITMAP_KIND:
        return (body[values >> 3] >> (7 - (values & 7)) & 1).astype(bool)
    known = body.view("<u2").astype(np.int64)
    if kind == ARRAY_KIND:
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return known[at] == values
    start, more = known.reshape(-1, 2).T
    at = np.searchsorted(start, values, side="right") - 1
    return (at >= 0) & (values <= (start + more)[np.maximum(at, 0)])


def and_not(a: bytes | None, b: bytes | None) -> np.ndarray:
    """The ordinals in ``a`` and not in ``b``."""
    if a and b and a[0] == b[0] == BITMAP_KIND:
        one, other = (np.frombuffer(x, dtype=np.uint8, offset=1) for x in (a, b))
        return np.flatnonzero(np.unpackbits(one & ~other))
    mine = members(a)
    return mine[~contains(b, mine)]


def latest_per_snapshot(df: DataFrame, key: Column, snapshot: Column, value: Column, loaded_at: Column) -> DataFrame:
    """(key, snapshot_no, value): the valid row of every key in every snapshot.

    The row with the latest load counts, a row without load time before all others; among
    equal load times the largest value (null smallest), so ties have one result. A maximum over
    a struct is combined before the shuffle, so a key with a third of all rows is no hot task.
    """
    rows = df.select(key.alias("key"), snapshot.alias("snapshot_no"), F.struct(loaded_at.alias("at"), value.alias("value")).alias("row"))
    valid = rows.filter("key IS NOT NULL AND key <> '' AND snapshot_no IS NOT NULL").groupBy("key", "snapshot_no").agg(F.max("row").alias("row"))
    return valid.select("key", "snapshot_no", F.col("row.value").alias("value"))


def short_value(c: Column) -> Column:
    """Values of 64 letters or more as their digest, which is as long, so that a chunk of them is
    bounded; equal if and only if the values are."""
    return F.when(F.length(c) < 64, c).otherwise(F.sha2(c, 256))


def assign_ordinals(keys: DataFrame, dictionary: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """Give every row of ``keys`` (column key, distinct) a dense ordinal; known keys keep theirs.

    ``dictionary`` (key, ordinal) comes from an earlier run. New keys are numbered after its
    ``largest`` ordinal (looked up if not given): each partition of a written table numbers its own rows and starts where the
    partitions before it end, so no task sees more than its share. Returns keys plus ordinal.
    """
    if dictionary is not None:
        known = materialize(keys.join(dictionary.select("key", "ordinal"), "key", "left"), "known-keys")
        old = known.filter("ordinal IS NOT NULL")
        fresh = known.filter("ordinal IS NULL").drop("ordinal")
        if largest is None:
            largest = dictionary.agg(F.coalesce(F.max("ordinal"), F.lit(-1))).first()[0]
        base = largest + 1
    else:
        old, fresh, base = None, keys, 0
    numbered = materialize(fresh.withColumn("row_id", F.monotonically_increasing_id()), "ordinals")
    part, pos = F.shiftright("row_id", 33), F.col("row_id").bitwiseAND((1 << 33) - 1)
    # One row per task of the stage above: small whatever the number of keys.
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + F.lit(base)).alias("start"))
    fresh = numbered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("ordinal", F.col("start") + pos).drop("part", "start", "row_id")
    return fresh if old is None else old.unionByName(fresh.select(old.columns))


#: A row of the state: of a snapshot's chunk bits and values, or (without a number) the keys of
#: ordinals that were new, from ``first`` on.
_STATE = "chunk long, snapshot_no long, first int, bits binary, `values` array<string>, keys array<string>"
_STATE_ARROW = pa.schema([("chunk", pa.int64()), ("snapshot_no", pa.int64()), ("first", pa.int32()), ("bits", pa.binary()), ("values", pa.list_(pa.string())), ("keys", pa.list_(pa.string()))])
_CHANGES = "snapshot_no long, key string, change_kind string"
_NOTHING = {"snapshots": [], "parts": [], "keys": 0}


def _encode_chunk(chunk: pa.Table) -> pa.Table:
    """The state rows of a chunk's keys; at most CHUNK of them by construction of its number."""
    low = chunk["ordinal"].to_numpy() & (CHUNK - 1)
    order = np.argsort(low)
    chunk, low = chunk.take(pa.array(order)), low[order]
    no = chunk["chunk"][0].as_py()
    numbers, values = chunk["numbers"].combine_chunks(), chunk["values"].combine_chunks()
    owner, number, value = np.repeat(low, numbers.value_lengths().to_numpy()), numbers.flatten().to_numpy(), values.flatten()
    rows = []
    for n in np.unique(number):
        mine = np.flatnonzero(number == n)
        rows.append({"chunk": no, "snapshot_no": int(n), "first": None, "bits": compress(owner[mine]), "values": value.take(pa.array(mine)).to_pylist(), "keys": None})
    fresh = np.flatnonzero(chunk["fresh"].to_numpy(zero_copy_only=False))
    if len(fresh):
        rows.append({"chunk": no, "snapshot_no": None, "first": int(low[fresh[0]]), "bits": None, "values": None, "keys": chunk["key"].take(pa.array(fresh)).to_pylist()})
    return pa.Table.from_pylist(rows, _STATE_ARROW)


def _manifest(spark: SparkSession, root: str) -> dict:
    from figloom.sources import files, sinks

    path = f"{root}/_manifest"
    return json.loads(sinks.read_file(spark, path)) if files.exists(spark, path) else dict(_NOTHING)


def _state(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(_STATE).parquet(*paths) if paths else spark.createDataFrame([], _STATE)


def dictionary(spark: SparkSession, root: str) -> DataFrame:
    """(key, ordinal) of every key that any snapshot under ``root`` has had."""
    parts = _state(spark, _manifest(spark, root)["parts"]).filter("snapshot_no IS NULL")
    keys = parts.select("chunk", "first", F.posexplode("keys").alias("n", "key"))
    return keys.select("key", (F.shiftleft("chunk", CHUNK_BITS) + F.col("first") + F.col("n")).alias("ordinal"))


def add_snapshots(df: DataFrame, root: str, key: Column, snapshot: Column, value: Column, loaded_at: Column) -> list[int]:
    """Add the snapshots in ``df`` to the state under ``root``; returns their numbers, rising.

    Known keys keep their ordinals, new ones are numbered after them. Numbers must be larger than
    those of snapshots already there. An attempt that fails leaves the state as it was. One writer
    at a time. Nulls, ties and repeated rows: see snapshot_changes.
    """
    from figloom.sources import sinks

    spark = df.sparkSession
    numbers = sorted(r[0] for r in df.select(snapshot.cast("long").alias("n")).filter("n IS NOT NULL").distinct().collect())
    held = _manifest(spark, root)
    if not numbers:
        return []
    if held["snapshots"] and numbers[0] <= held["snapshots"][-1]:
        raise ValueError(f"snapshot {numbers[0]} is not later than {held['snapshots'][-1]}")
    valid = latest_per_snapshot(df, key, snapshot.cast("long"), short_value(value.cast("string")), loaded_at)
    # One row per key; its list is bounded by the number of snapshots.
    keyed = valid.groupBy("key").agg(F.collect_list(F.struct("snapshot_no", "value")).alias("s"))
    keyed = keyed.select("key", F.col("s.snapshot_no").alias("numbers"), F.col("s.value").alias("values"))
    ordered = assign_ordinals(keyed, dictionary(spark, root) if held["keys"] else None, held["keys"] - 1)
    chunked = ordered.withColumns({"chunk": F.shiftright("ordinal", CHUNK_BITS), "fresh": F.col("ordinal") >= held["keys"]})
    path = f"{root}/part-{uuid.uuid4().hex}"
    chunked.groupBy("chunk").applyInArrow(_encode_chunk, _STATE).write.parquet(path)
    fresh = _state(spark, [path]).filter("snapshot_no IS NULL").agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    sinks.replace_file(spark, json.dumps({"snapshots": held["snapshots"] + numbers, "parts": [*held["parts"], path], "keys": held["keys"] + fresh}), f"{root}/_manifest")
    return numbers


_DIFFERENCES = "snapshot_no long, chunk long, change_kind string, lows array<int>"


def _differences(group: pa.Table) -> pa.Table:
    """The ordinals that changed between two containers of a chunk: at most one row a side."""
    side = dict(zip(group["later"].to_pylist(), range(group.num_rows)))
    bits = {k: group["bits"][i].as_py() for k, i in side.items()}
    old, new = bits.get(False), bits.get(True)
    found = {"added": and_not(new, old), "removed": and_not(old, new)}
    both = members(old)[contains(new, members(old))]
    if len(both):
        # The vectors hold one value per set bit; the rank of a bit is its place in them.
        a, b = (group["values"][side[k]].values.take(pa.array(np.searchsorted(members(bits[k]), both))) for k in (False, True))
        codes = pa.concat_arrays([a, b]).dictionary_encode().indices.fill_null(-1).to_numpy()
        found["changed"] = both[codes[: len(both)] != codes[len(both) :]]
    at, chunk = group["snapshot_no"][0].as_py(), group["chunk"][0].as_py()
    rows = [{"snapshot_no": at, "chunk": chunk, "change_kind": k, "lows": lows.tolist()} for k, lows in found.items() if len(lows)]
    return pa.Table.from_pylist(rows, pa.schema([("snapshot_no", pa.int64()), ("chunk", pa.int64()), ("change_kind", pa.string()), ("lows", pa.list_(pa.int32()))]))


def changes_between(spark: SparkSession, root: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """(snapshot_no, key, change_kind) for each (before, after) of the snapshots under ``root``.

    Only containers of the snapshots named are read, and the keys of chunks in which something
    changed. snapshot_no is the later one.
    """
    if not pairs:
        return spark.createDataFrame([], _CHANGES)
    state = _state(spark, _manifest(spark, root)["parts"])
    wanted = spark.createDataFrame([(n, after, later) for before, after in pairs for n, later in ((before, False), (after, True))], "snapshot_no long, after long, later boolean")
    # Two short rows a pair of deliveries.
    sides = state.filter(F.col("snapshot_no").isin(sorted({n for pair in pairs for n in pair}))).join(F.broadcast(wanted), "snapshot_no")
    sides = sides.select(F.col("after").alias("snapshot_no"), "chunk", "later", "bits", "values")
    changed = sides.groupBy("snapshot_no", "chunk").applyInArrow(_differences, _DIFFERENCES)
    keys = state.filter("snapshot_no IS NULL").select("chunk", "first", "keys")
    named = changed.join(keys, "chunk").withColumn("lows", F.expr("filter(lows, x -> x >= first AND x < first + size(keys))"))
    return named.select("snapshot_no", "change_kind", F.explode(F.expr("transform(lows, x -> keys[x - first])")).alias("key")).select("snapshot_no", "key", "change_kind")


def advance(df: DataFrame, root: str, key: Column, snapshot: Column, value: Column, loaded_at: Column) -> DataFrame:
    """Add the snapshots in ``df``, the new ones only, and tell what they changed against the ones
    before, the last one already under ``root`` included."""
    spark = df.sparkSession
    before = _manifest(spark, root)["snapshots"][-1:]
    line = before + add_snapshots(df, root, key, snapshot, value, loaded_at)
    return changes_between(spark, root, list(zip(line, line[1:])))


def snapshot_changes(df: DataFrame, key: Column, snapshot: Column, value: Column, loaded_at: Column, root: str | None = None) -> DataFrame:
    """(snapshot_no, key, change_kind): one row per change against the snapshot before.

    The snapshot before is the one with the next smaller number that has any row, keyless rows
    included. key null or empty: no case. value null: equals null only. A snapshot without
    keys reports all keys of the one before as removed; an empty table or a single snapshot
    gives no rows. Repeated rows: see latest_per_snapshot. Other columns are not read.

    The state is kept under ``root``, to which later snapshots are added by ``advance``; without it
    under a folder of the session. The list of snapshot numbers is the only thing collected.
    """
    return advance(df, root or scratch(df.sparkSession, "snapshots"), key, snapshot, value, loaded_at)


def decision_value(c: Column) -> Column:
    """A decision without letter case and blanks of any kind; blank is null."""
    return F.nullif(F.lower(drop_blanks(c)), F.lit(""))


def paper_changes(staging: DataFrame) -> DataFrame:
    """Changes of platform_id and decision between the snapshots of papers_staging."""
    out = snapshot_changes(staging, strip_blanks(F.col("platform_id")), F.col("snapshot_no"), decision_value(F.col("decision")), F.col("loaded_at"))
    return out.select(F.col("snapshot_no").cast("int").alias("snapshot_no"), F.col("key").alias("platform_id"), "change_kind")
