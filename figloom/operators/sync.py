"""Keeping a long-lived table in step with deliveries; every step gives a new snapshot.

Plain parquet has no MERGE, so a table is read, rewritten as a DataFrame and published under a
new path (sources.sinks.publish). All steps are joins and aggregates on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order``, ties by all other columns. Null keys are a key.

    A maximum over a struct, combined before the shuffle: a hot key is reduced where it lies.
    """
    return _picked(df, keys, order, F.max)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, ties by all other columns."""
    return _picked(df, keys, order, F.min)


def _picked(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)])
    one = df.groupBy(*keys).agg(pick(ranked).alias("_r"))
    return one.select(*keys, *[F.col(f"_r._c{i}").alias(c) for i, c in enumerate(rest)]).select(*df.columns)


def missing_rows(target: DataFrame, staging: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of staging whose key the target lacks; a null key matches nothing."""
    return staging.join(target.select(*keys), keys, "left_anti").select(*staging.columns)


def insert_missing(target: DataFrame, staging: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(missing_rows(target, staging, keys), allowMissingColumns=True)


def differs(old: Column, new: Column, pending: str) -> Column:
    """Whether a value is to be replaced: different but for case, never by pending, never from
    or to null."""
    return (F.lower(old) != F.lower(new)) & (F.lower(new) != F.lit(pending))


def changed_rows(target: DataFrame, staging: DataFrame, keys: list[str], column: str, pending: str) -> DataFrame:
    """(keys, old, new) of the rows whose column the staging changes; staging keys are unique."""
    new = staging.select(*keys, F.col(column).alias("new"))
    return target.select(*keys, F.col(column).alias("old")).join(new, keys).filter(differs(F.col("old"), F.col("new"), pending))


def update_changed(target: DataFrame, staging: DataFrame, keys: list[str], column: str, pending: str) -> DataFrame:
    """The target with changed values of one column; staging keys are unique."""
    new = staging.select(*keys, F.col(column).alias("_new"))
    joined = target.join(new, keys, "left")
    value = F.when(differs(F.col(column), F.col("_new"), pending), F.col("_new")).otherwise(F.col(column))
    return joined.withColumn(column, value).select(*target.columns)


def sync(target: DataFrame, staging: DataFrame, keys: list[str], column: str, pending: str) -> DataFrame:
    """Insert rows with new keys, then update the changed ones: update_changed after
    insert_missing, as one full outer join, so each side is shuffled once. Staging keys are unique;
    a null key matches nothing."""
    old = target.select(F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("_old"), *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
    here = [c for c in target.columns if c in staging.columns]
    new = staging.select(F.struct(*[F.col(f"`{c}`") for c in here]).alias("_new"), *[F.col(f"`{k}`").alias(f"_n{i}") for i, k in enumerate(keys)])
    on = [F.col(f"_k{i}") == F.col(f"_n{i}") for i in range(len(keys))]
    joined = old.join(new, on, "full")
    was, fresh = F.col("_old")[column], F.col("_new")[column]

    def value(c: str) -> Column:
        kept = F.col("_old")[c]
        if c == column:
            kept = F.when(differs(was, fresh, pending), fresh).otherwise(was)
        return F.when(F.col("_old").isNull(), F.col("_new")[c] if c in here else F.lit(None)).otherwise(kept).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of the batch replace those of the target with the same key; the last one counts."""
    old = target.withColumn("_batch", F.lit(0))
    new = batch.withColumn("_batch", F.lit(1))
    return latest_rows(old.unionByName(new, allowMissingColumns=True), keys, [F.col("_batch"), *order]).select(*target.columns)


def keyed_update(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of the target set where updates (unique keys) have a value; null changes nothing."""
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).select(*target.columns)


def reset_column(target: DataFrame, column: str) -> DataFrame:
    return target.withColumn(column, F.lit(None).cast(target.schema[column].dataType))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many: what a unique index would refuse."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def union_tables(*tables: DataFrame) -> DataFrame:
    """Tables of one kind, such as those of several venues, as one; columns that one lacks are null."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    return whole


def dense_ordinals(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """``df`` plus the place of each row, from 0, in a total order.

    Sorted by ranges and written once; a partition starts where those before it end, so no task
    sees more than its range. A column called ``name`` is replaced.
    """
    from pyspark.sql.window import Window

    from figloom.workspace import materialize

    ranged = df.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(ranged.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    # One row per partition.
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return numbered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + at).drop("_row", "_part", "_start", "_n")


def chunked_lists(df: DataFrame, keys: list[str], value: Column, size: int = 1000) -> DataFrame:
    """(keys, chunk, items): the values of each key in sorted lists of about ``size``.

    A key with very many rows gets as many chunks as it needs, so no list is unbounded.
    """
    counted = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("_chunks"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = df.withColumn("_v", value).alias("d").join(counted.alias("c"), same)
    chunk = F.pmod(F.xxhash64("d._v"), F.col("c._chunks")).cast("int").alias("chunk")
    return joined.select(*[F.col(f"d.{k}").alias(k) for k in keys], chunk, F.col("d._v").alias("_v")).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("_v")).alias("items"))
