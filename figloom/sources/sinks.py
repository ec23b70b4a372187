"""Where results go."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figloom.workspace import discard, materialize

#: Keys of a usage ledger at most.
MAX_KEYS = 10_000


def to_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object per line, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def to_json_map(df: DataFrame, key: Column, value: Column, path: str) -> None:
    """One JSON object {key: value}, an entry a line; of repeated keys the greatest value.

    Entries are sorted by key in ranges and written by many tasks; the parts of the folder, in the
    order of their names, are one object.
    """
    spark = df.sparkSession
    one = df.groupBy(key.cast("string").alias("k")).agg(F.max(value).alias("v")).filter("k IS NOT NULL")
    entry = F.to_json(F.create_map("k", "v"), {"ignoreNullFields": "false"})
    # An entry without its braces; all but the least key begin with a comma.
    least = one.agg(F.min("k")).first()[0]
    lines = one.select("k", F.concat(F.when(F.col("k") == F.lit(least), "").otherwise(","), F.substring(entry, 2, 1 << 30)).alias("value"))
    lines = lines.select("k", F.expr("substring(value, 1, length(value) - 1)").alias("value")).orderBy("k").select("value")
    lines.write.mode("overwrite").text(path)
    replace_file(spark, "{\n", f"{path}/part-.begin")
    replace_file(spark, "}\n", f"{path}/part-~end")


def create_if_missing(df: DataFrame, name: str) -> None:
    df.write.mode("ignore").format("parquet").saveAsTable(name)


def create_or_replace(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def append(df: DataFrame, name: str) -> None:
    df.write.mode("append").format("parquet").saveAsTable(name)


def create_empty(spark: SparkSession, name: str, ddl: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def replace_file(spark: SparkSession, text: str, path: str) -> None:
    """Write a small file; readers see the old or the new one, also if the writer dies half-way:
    it is written beside and renamed over the old one in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, target = _fs(spark, path)
    fresh = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    renaming = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(renaming, 1)
    how[0] = renaming.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(target), how)


def read_file(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(df: DataFrame, root: str) -> str:
    """Write a new snapshot below ``root`` and point to it; readers see the old or the new one.

    The pointer is renamed over the old one after the data is whole, so a write that fails or dies
    at any step changes nothing: a commit. Returns the snapshot's path. One writer at a time.
    """
    spark = df.sparkSession
    number = max([int(p) for p in _snapshots(spark, root)], default=0) + 1
    path = f"{root}/{number:08d}"
    df.write.parquet(path)
    replace_file(spark, f"{number:08d}", f"{root}/_current")
    return path


def _snapshots(spark: SparkSession, root: str) -> list[str]:
    """Numbered folders, whole or not."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().isdigit()]


def is_published(spark: SparkSession, root: str) -> bool:
    fs, pointer = _fs(spark, f"{root}/_current")
    return fs.exists(pointer)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that the pointer names. Without a pointer nothing is published, whatever
    folders there are; a snapshot that is not whole is refused."""
    if not is_published(spark, root):
        raise FileNotFoundError(f"nothing is published under {root}")
    path = f"{root}/{read_file(spark, f'{root}/_current').strip()}"
    fs, mark = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(mark):
        raise FileNotFoundError(f"the snapshot {path} is not whole")
    return spark.read.parquet(path)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the ``keep`` newest snapshots and the one published; returns what is deleted.
    Folders newer than the published one are left to their writer."""
    current = read_file(spark, f"{root}/_current").strip()
    old = sorted(n for n in _snapshots(spark, root) if int(n) < int(current))
    gone = old[: max(0, len(old) - max(0, keep - 1))]
    for name in gone:
        fs, path = _fs(spark, f"{root}/{name}")
        fs.delete(path, True)
    return gone


def save_failures(df: DataFrame, path: str) -> None:
    """The ledger of failed tasks as JSON lines, for files.failed_tasks; removed when nothing failed.
    Folders of output are no part of it. ``df`` may come from the ledger under the same path, so what
    failed is written elsewhere first."""
    spark = df.sparkSession
    failed = materialize(df.filter("status = 'failed'").drop("status", "output_dir"), "failures")
    if failed.isEmpty():
        fs, where = _fs(spark, path)
        fs.delete(where, True)
    else:
        failed.write.mode("overwrite").json(path)
    discard(failed)


def save_usage(usage: DataFrame, path: str) -> None:
    """A ledger (key, amount) as one JSON object; what an earlier one holds is added key by key.

    One row per key of a price list: small by nature, and refused beyond MAX_KEYS.
    """
    spark = usage.sparkSession
    rows = usage.groupBy("key").agg(F.sum("amount").alias("amount")).limit(MAX_KEYS + 1).collect()
    if len(rows) > MAX_KEYS:
        raise ValueError(f"a usage ledger of more than {MAX_KEYS} keys")
    total = read_usage(spark, path)
    for r in rows:
        total[r["key"]] = total.get(r["key"], 0) + r["amount"]
    replace_file(spark, json.dumps(total, sort_keys=True), path)


def read_usage(spark: SparkSession, path: str) -> dict:
    """The ledger under ``path``, empty if there is none."""
    fs, where = _fs(spark, path)
    return json.loads(read_file(spark, path)) if fs.exists(where) else {}


def save_prompts(prompts: DataFrame, key: str, parts: str, path: str) -> None:
    """The log of prompts: (key, text), parts one below the other; a picture is named, not printed.

    ``parts``: array of struct(kind, text).
    """
    shown = lambda p: F.when(p["kind"] == "text", p["text"]).otherwise(F.concat(F.lit("[IMAGE: "), F.length(p["text"]), F.lit(" characters]")))
    prompts.select(F.col(key).cast("string").alias("key"), F.array_join(F.transform(parts, shown), "\n").alias("prompt")).write.mode("overwrite").json(path)


def save_vectors(df: DataFrame, key: str, texts: dict[str, str], embed, root: str) -> None:
    """One vector index for each text column: (key, vector) as parquet, by an injected embedder
    of a batch of texts."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([list(map(float, v)) for v in embed([t or "" for t in batch.to_pylist()])], pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    vector = F.arrow_udf(run, "array<float>")
    for name, column in texts.items():
        df.select(key, vector(F.col(column)).alias("vector")).write.mode("overwrite").parquet(f"{root}/{name}")
