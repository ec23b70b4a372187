"""Where intermediate tables are written.

Lineage is cut by writing a table into the shared folder that the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a local folder is made.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; sets a local one if the session names none.

    On a cluster a local folder would be another one on every machine, so there it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="figloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    The table outlives executors, so a lost one costs no recomputation, and everything
    read from it is fixed: row numbers derived from it stay the same in every re-run task.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._figloom_path = path
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path among the written tables, for what is not written by ``materialize``."""
    return f"{_tables(spark)}/{label}-{uuid.uuid4().hex}"


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/figloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        if path := getattr(t, "_figloom_path", None):
            _delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has materialized, once its results are written."""
    _delete(spark, _tables(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of the session, once, so that their Python finds it.

    Spark's file server copies the archive to every executor, late ones included.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    handle, archive = tempfile.mkstemp(prefix="figloom-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    # The file server reads it until the application ends.
    atexit.register(Path(archive).unlink, missing_ok=True)
    _shipped.add(app)
