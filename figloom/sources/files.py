"""Scans of files and folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figloom import schemas
from figloom.functions.text import is_accepted


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON object per line; blank lines are skipped, a malformed one fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON array, such as the ledger of failed downloads."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def failed_tasks(spark: SparkSession, path: str, ignore: bool = False, foreign: bool = False) -> DataFrame | None:
    """The ledger of an earlier run (sinks.save_failures), or None if there is none or it is to be
    ignored. A ``foreign`` ledger is one JSON array."""
    if ignore or not exists(spark, path):
        return None
    return (json_array if foreign else jsonl)(spark, path, schemas.DOWNLOAD_TASKS)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def extracted_figures(spark: SparkSession, pattern: str, kind: str = "Figure") -> DataFrame:
    """(platform_id, name, render_url, caption) from one JSON array per paper, named after it.

    Files that are no valid array give no rows; figures of another kind (tables) are dropped.
    """
    whole = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    items = whole.select(F.regexp_replace("file", r"\.json$", "").alias("platform_id"), F.explode(F.from_json("value", schemas.EXTRACTED_FIGURES)).alias("f"))
    return items.filter(F.col("f.figType") == kind).select("platform_id", F.col("f.name").alias("name"), F.col("f.renderURL").alias("render_url"), F.col("f.caption").alias("caption"))


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length) of every file below a folder that is not empty; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def pending_assets(spark: SparkSession, root: str) -> DataFrame:
    """(kind, platform_id, year, path): the first folder, by path, of each paper that is filed
    under <kind>/<year>/pending_unknown/<platform_id>."""
    at = lambda i: F.regexp_extract("path", r"/(papers|figures)/(\d+)/pending_unknown/([^/]+)", i)
    found = listing(spark, root).filter(at(1) != "").select(at(1).alias("kind"), at(2).cast("long").alias("year"), F.regexp_replace(at(3), r"\.pdf$", "").alias("platform_id"), "path")
    return found.groupBy("kind", "platform_id").agg(F.min(F.struct("path", "year")).alias("r")).select("kind", "platform_id", "r.year", "r.path")


def tree_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(conf, year, decision, size, category) of a tree <conf>/figures/<year>/<decision>/..."""
    pattern = r"/([^/]+)/figures/(\d+)/([^/]+)/"
    at = lambda i: F.regexp_extract("path", pattern, i)
    files = listing(spark, root).filter(F.col("path").rlike(pattern)).select(at(1).alias("conf"), at(2).cast("long").alias("year"), at(3).alias("decision"), "length")
    sums = files.groupBy("conf", "year", "decision").agg(F.sum("length").alias("size"))
    return sums.withColumn("category", F.when(is_accepted(F.col("decision")), "Accept").otherwise("Reject"))


def index_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, magic, dimension, vectors) from the first 16 bytes of vector index files: four
    letters, then a 32-bit and a 64-bit little-endian number. A shorter file fails the scan.

    Only these bytes are read, by the workers, so files of any size will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        from pyarrow import fs

        for batch in batches:
            rows = []
            for name in batch["path"].to_pylist():
                system, where = fs.FileSystem.from_uri(name)
                with system.open_input_file(where) as f:
                    head = f.read(16)
                if len(head) < 16:
                    raise ValueError(f"no index header in {name}")
                magic, dimension, vectors = struct.unpack("<4sIQ", head)
                rows.append({"path": name, "magic": magic.decode(errors="replace"), "dimension": dimension, "vectors": vectors})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("magic", pa.string()), ("dimension", pa.int64()), ("vectors", pa.int64())]))

    return listing(spark, path).select("path").mapInArrow(run, "path string, magic string, dimension long, vectors long")


def text_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def images(spark: SparkSession, path: str, decode: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(path, content) of image files. With ``decode``, an injected reader that gives a picture's
    points, content is what it gives, and files that it cannot read are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path).select("path", "content")
    if decode is None:
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                try:
                    rows.append({"path": name, "content": decode(content)})
                except Exception:
                    continue
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return found.mapInArrow(run, "path string, content binary")


def extracted(folders: DataFrame, column: str, extract: Callable[[str], None]) -> DataFrame:
    """``folders`` plus status: an injected runner of the figure extractor has worked on each folder
    ("extracted") or failed on it ("failed"); what it wrote is read by extracted_figures. One task
    per folder's row; a run that is repeated after a lost executor writes the same files again."""
    schema = T.StructType([*folders.schema.fields, T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status = []
            for folder in batch[column].to_pylist():
                try:
                    extract(folder)
                    status.append("extracted")
                except Exception:
                    status.append("failed")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.string())], [*batch.schema.names, "status"])

    return folders.mapInArrow(run, schema)


def extracted_text(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of papers by an injected reader of one file; failures give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content in batch["content"].to_pylist():
                try:
                    texts.append(extract(content))
                except Exception:
                    texts.append("")
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(texts, pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


#: Names of the release's files.
CORE_FILES, DATABASES = ("data.jsonl", "SHA256SUMS", "data/faiss_complete.tar.gz"), "_research_db.tar.gz"
METADATA_FOLDER, METADATA_ENDING = "reproduce/", "_metadata.tar.gz"
IMAGE_FOLDER, IMAGE_ENDING = "data/", ".tar.gz"


def file_part(name: Column) -> Column:
    """What a file of the release is: "core", "image", "metadata"; null for any other."""
    core = name.isin(*CORE_FILES) | name.endswith(DATABASES)
    image = name.startswith(IMAGE_FOLDER) & name.endswith(IMAGE_ENDING)
    return F.when(core, "core").when(image, "image").when(name.startswith(METADATA_FOLDER) & name.endswith(METADATA_ENDING), "metadata")


def select_files(files: DataFrame, name: str, order: str, subset: str = "accept", core: bool = True, metadata: bool = False, metadata_only: bool = False) -> DataFrame:
    """``files`` to fetch, in order: core files, images of the subset (all, accept, reject; any
    other name means none), metadata archives, each part in the order of the listing."""
    part, accepted = file_part(F.col(name)), is_accepted(F.col(name))
    chosen = {"all": F.lit(True), "accept": accepted, "reject": ~accepted}.get(subset, F.lit(False))
    wanted = part == "metadata"
    if not metadata_only:
        wanted = ((part == "core") & F.lit(core)) | ((part == "image") & chosen) | (wanted & F.lit(metadata))
    place = F.when(part == "core", 0).when(part == "image", 1).otherwise(2)
    return files.filter(wanted).orderBy(place, order)


def unpacked(spark: SparkSession, path: str, glob: str = "*.tar.gz") -> DataFrame:
    """(archive, member, content) of gzipped tar archives; one that cannot be read gives the
    members before the fault. Members are streamed one by one, folders and links are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tarfile

        from pyarrow import fs

        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for name in batch["path"].to_pylist():
                try:
                    system, where = fs.FileSystem.from_uri(name)
                    with system.open_input_stream(where, compression="gzip") as raw, tarfile.open(fileobj=raw, mode="r|") as archive:
                        for member in archive:
                            if member.isfile():
                                yield pa.RecordBatch.from_pylist([{"archive": name, "member": member.name, "content": archive.extractfile(member).read()}], schema)
                except (OSError, EOFError, tarfile.TarError):
                    continue

    return listing(spark, path, glob).select("path").mapInArrow(run, "archive string, member string, content binary")
