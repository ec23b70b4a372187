"""Deliveries as a stream: each arriving batch is synchronized into a published snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figloom.operators.sync import sync, upsert
from figloom.sources.sinks import expire, is_published, publish, published


def deliveries(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _run(stream: DataFrame, root: str, checkpoint: str, combine) -> None:
    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        target = published(spark, root) if is_published(spark, root) else spark.createDataFrame([], batch.schema)
        publish(combine(target, batch), root)
        expire(spark, root)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: list[Column]) -> None:
    """Everything that has arrived replaces older rows of the same key, batch by batch. A batch
    that is run again after a failure gives the same rows."""
    _run(stream, root, checkpoint, lambda target, batch: upsert(target, batch, keys, order))


def sync_stream(stream: DataFrame, root: str, checkpoint: str, keys: list[str], column: str, pending: str, order: list[Column]) -> None:
    """New keys are inserted and changed values updated, batch by batch."""
    from figloom.operators.sync import latest_rows

    _run(stream, root, checkpoint, lambda target, batch: sync(target, latest_rows(batch, keys, order), keys, column, pending))


def windowed_counts(stream: DataFrame, at: str, group: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Rows of each group in each window of time; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), group).agg(F.count("*").alias("rows_")).select(F.col("w.start").alias("start"), group, "rows_")
