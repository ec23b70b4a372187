import json
import struct

import pytest
from pyspark.sql import functions as F

from figloom import schemas
from figloom.sources import files, sinks
from figloom.streaming import incremental


def test_jsonl_round_trip_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None, [1, 2]), ("b", "x", [])], "platform_id string, bibtex string, scores array<long>")
    sinks.to_jsonl(df, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert {"platform_id": "a", "bibtex": None, "scores": [1, 2]} in lines
    back = files.jsonl(spark, str(tmp_path / "out"), schemas.PAPERS)
    assert {r.platform_id: r.scores for r in back.collect()} == {"a": [1, 2], "b": []}
    (tmp_path / "bad.jsonl").write_text('{"platform_id": "a"}\n\n{oops\n')
    with pytest.raises(Exception):
        files.jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.PAPERS).collect()


TASKS = "id string, year long, decision string, url string, status string, output_dir string"


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "failed")
    assert files.failed_tasks(spark, path) is None
    tasks = spark.createDataFrame([(f"p{i}", 2024, "reject", None if i == 3 else "u", "failed" if i % 5 else "downloaded", "/x") for i in range(500)], TASKS)
    sinks.save_failures(tasks.repartition(7), path)
    assert len(list((tmp_path / "failed").glob("part-*"))) > 1
    back = files.failed_tasks(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tasks.filter("status = 'failed'").drop("status", "output_dir").collect()))
    assert back.count() == 400 and back.schema == schemas.DOWNLOAD_TASKS
    assert files.failed_tasks(spark, path, ignore=True) is None
    # The next run tries what failed before, and writes what fails again.
    sinks.save_failures(back.withColumn("status", F.when(F.col("id") < "p3", "failed").otherwise("skipped")), path)
    assert {r.id for r in files.failed_tasks(spark, path).collect()} == {f"p{i}" for i in range(500) if i % 5 and f"p{i}" < "p3"}
    sinks.save_failures(tasks.filter("status <> 'failed'"), path)
    assert files.failed_tasks(spark, path) is None
    (tmp_path / "foreign.json").write_text(json.dumps([{"id": "a", "year": 2026, "decision": "d", "url": "u"}, {"id": "b", "year": None, "decision": None, "url": "u"}], indent=2))
    assert {r.id for r in files.failed_tasks(spark, str(tmp_path / "foreign.json"), foreign=True).collect()} == {"a", "b"}


def test_extracted_figures_skip_broken_files(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps([{"figType": "Figure", "name": "1", "renderURL": "r", "caption": "c"}, {"figType": "Table", "name": "2", "renderURL": "r", "caption": "c"}]))
    (tmp_path / "p2.json").write_text("{broken")
    rows = files.extracted_figures(spark, str(tmp_path / "*.json")).collect()
    assert [(r.platform_id, r.name) for r in rows] == [("p1", "1")]


def test_listings(spark, tmp_path):
    for path, size in (("V/figures/2020/accept_oral/p/Figure1.png", 10), ("V/figures/2020/accept_oral/q/Figure1.png", 5), ("V/figures/2021/reject/r/Figure1.png", 1), ("papers/2020/pending_unknown/x.pdf", 3), ("figures/2020/pending_unknown/y/Figure2.png", 3)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"z" * size)
    sizes = {(r.conf, r.year, r.decision): (r.size, r.category) for r in files.tree_sizes(spark, str(tmp_path)).collect()}
    assert sizes[("V", 2020, "accept_oral")] == (15, "Accept") and sizes[("V", 2021, "reject")] == (1, "Reject")
    assert {(r.kind, r.platform_id, r.year) for r in files.pending_assets(spark, str(tmp_path)).collect()} == {("papers", "x", 2020), ("figures", "y", 2020)}
    assert files.images(spark, str(tmp_path)).count() == 4
    texts = files.extracted_text(spark, str(tmp_path / "papers/*/*/*.pdf"), lambda b: b.decode() * 2)
    assert [r.text for r in texts.collect()] == ["zzzzzz"]
    assert [r.text for r in files.extracted_text(spark, str(tmp_path / "papers/*/*/*.pdf"), lambda b: 1 / 0).collect()] == [""]


def test_index_headers(spark, tmp_path):
    (tmp_path / "a.index").write_bytes(b"IxF2" + struct.pack("<IQ", 3072, 57100) + b"rest")
    r = files.index_headers(spark, str(tmp_path / "a.index")).first()
    assert (r.magic, r.dimension, r.vectors) == ("IxF2", 3072, 57100)
    (tmp_path / "b.index").write_bytes(b"short")
    with pytest.raises(Exception, match="no index header"):
        files.index_headers(spark, str(tmp_path / "b.index")).collect()


def test_json_map_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("b", "u3"), (None, "x")], "id string, url string")
    sinks.to_json_map(df, F.col("id"), F.col("url"), str(tmp_path / "map"))
    whole = lambda p: json.loads("".join(f.read_text() for f in sorted((tmp_path / p).glob("part-*"))))
    assert whole("map") == {"a": "u1", "b": "u3"}
    many = spark.createDataFrame([(f"k{i}", [i, None]) for i in range(300)], "id string, v array<int>").repartition(5)
    sinks.to_json_map(many, F.col("id"), F.col("v"), str(tmp_path / "many"))
    assert whole("many") == {f"k{i}": [i, None] for i in range(300)}
    sinks.to_json_map(many.limit(0), F.col("id"), F.col("v"), str(tmp_path / "none"))
    assert whole("none") == {}
    for name in ("t_one", "t_two"):
        sinks.drop(spark, name)
    sinks.create_if_missing(df, "t_one")
    sinks.create_if_missing(df.limit(0), "t_one")
    sinks.append(df, "t_one")
    assert spark.table("t_one").count() == 8
    sinks.create_or_replace(df.limit(1), "t_one")
    sinks.create_empty(spark, "t_two", "a string")
    assert spark.table("t_one").count() == 1 and {"t_one", "t_two"} <= set(sinks.tables(spark))
    for name in ("t_one", "t_two"):
        sinks.drop(spark, name)


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "snap")
    sinks.publish(spark.range(3).toDF("id"), root)
    sinks.publish(sinks.published(spark, root).unionByName(spark.range(3, 5).toDF("id")), root)
    assert sinks.published(spark, root).count() == 5
    with pytest.raises(Exception):
        sinks.publish(sinks.published(spark, root).select(F.raise_error(F.lit("stop")).alias("id")), root)
    assert sinks.published(spark, root).count() == 5


def test_a_writer_that_dies_between_steps_publishes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "snap")
    dies = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt)
    # The very first snapshot is whole but not yet pointed to.
    with monkeypatch.context() as m:
        m.setattr(sinks, "replace_file", dies)
        with pytest.raises(KeyboardInterrupt):
            sinks.publish(spark.range(10).toDF("id"), root)
    assert not sinks.is_published(spark, root)
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, root)
    sinks.publish(spark.range(5).toDF("id"), root)
    # Half a snapshot with a higher number, and a pointer that was being written.
    half = tmp_path / "snap" / "00000009"
    spark.range(4).toDF("id").write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    (tmp_path / "snap" / "_current.abc").write_text("00000009")
    assert sinks.published(spark, root).count() == 5
    assert sinks.publish(spark.range(6).toDF("id"), root).endswith("00000010")
    assert sinks.published(spark, root).count() == 6
    # A pointer to what is not whole is refused.
    sinks.replace_file(spark, "00000009", root + "/_current")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, root)
    sinks.replace_file(spark, "00000010", root + "/_current")
    assert sinks.expire(spark, root, keep=1) and sinks.published(spark, root).count() == 6
    assert [p.name for p in (tmp_path / "snap").iterdir() if p.name.isdigit()] == ["00000010"]


def test_usage_and_prompts(spark, tmp_path):
    path = str(tmp_path / "usage.json")
    assert sinks.read_usage(spark, path) == {}
    sinks.save_usage(spark.createDataFrame([("cost", 0.5), ("tokens", 3.0), ("cost", 0.25)], "key string, amount double"), path)
    sinks.save_usage(spark.createDataFrame([("cost", 1.0), ("calls", 1.0)], "key string, amount double"), path)
    assert sinks.read_usage(spark, path) == {"cost": 1.75, "tokens": 3.0, "calls": 1.0}
    prompts = spark.createDataFrame([(1, [("text", "a"), ("image", "data:x")])], "id int, parts array<struct<kind: string, text: string>>")
    sinks.save_prompts(prompts, "id", "parts", str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().prompt == "a\n[IMAGE: 6 characters]"


def test_release_files_in_order(spark):
    names = ["reproduce/a_metadata.tar.gz", "data/x_accept.tar.gz", "data.jsonl", "data/temporal.tar.gz", "data/reject.tar.gz", "c_research_db.tar.gz", "data/faiss_complete.tar.gz", "README.md", "SHA256SUMS"]
    df = spark.createDataFrame([(f, n, "x") for n, f in enumerate(names)], "f string, n int, name string")
    pick = lambda *a, **k: [r.f for r in files.select_files(df, "f", "n", *a, **k).collect()]
    core = ["data.jsonl", "c_research_db.tar.gz", "data/faiss_complete.tar.gz", "SHA256SUMS"]
    assert pick() == [*core, "data/x_accept.tar.gz", "data/temporal.tar.gz"]
    assert pick("reject", core=False) == ["data/reject.tar.gz"]
    assert pick("all", metadata=True) == [*core, "data/x_accept.tar.gz", "data/temporal.tar.gz", "data/reject.tar.gz", "reproduce/a_metadata.tar.gz"]
    assert pick("none") == core and pick("all", metadata_only=True) == ["reproduce/a_metadata.tar.gz"]


def test_archives_and_pictures(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, data in (("x/Figure1.png", b"one"), ("x/Figure2.png", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "b.tar.gz").write_bytes(b"no archive")
    got = {r.member: bytes(r.content) for r in files.unpacked(spark, str(tmp_path)).collect()}
    assert got == {"x/Figure1.png": b"one", "x/Figure2.png": b""}
    for n in (1, 2):
        (tmp_path / f"{n}.png").write_bytes(b"p" * n)
    decode = lambda b: b * 2 if len(b) > 1 else 1 / 0
    assert [bytes(r.content) for r in files.images(spark, str(tmp_path), decode).collect()] == [b"pppp"]
    folders = spark.createDataFrame([("good",), ("bad",)], "folder string")
    extract = lambda f: None if f == "good" else 1 / 0
    assert {r.folder: r.status for r in files.extracted(folders, "folder", extract).collect()} == {"good": "extracted", "bad": "failed"}


def test_vector_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab", None), (2, "abc", "x")], "id long, title string, abstract string")
    sinks.save_vectors(df, "id", {"title": "title", "abstract": "abstract"}, lambda texts: [[len(t), 1.0] for t in texts], str(tmp_path))
    assert {r.id: r.vector[0] for r in spark.read.parquet(str(tmp_path / "title")).collect()} == {1: 2.0, 2: 3.0}


def test_streams(spark, tmp_path):
    schema = "k string, v string, at int"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: incremental.deliveries(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    up = lambda: incremental.upsert_stream(read(), str(tmp_path / "up"), str(tmp_path / "c1"), ["k"], [F.col("at")])
    sy = lambda: incremental.sync_stream(read(), str(tmp_path / "sy"), str(tmp_path / "c2"), ["k"], "v", "pending", [F.col("at")])
    write([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)])
    up(), sy()
    write([("b", "pending", 3), ("c", "w", 1), ("a", "Y", 4)])
    up(), sy()
    rows = lambda p: {r.k: r.v for r in sinks.published(spark, str(tmp_path / p)).collect()}
    assert rows("up") == {"a": "Y", "b": "pending", "c": "w"}
    assert rows("sy") == {"a": "y", "b": "z", "c": "w"}


def test_windowed_counts(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01 10:10:00' as ts, 'a' as g union all select timestamp'2026-01-01 10:50:00', 'a' union all select timestamp'2026-01-01 13:00:00', 'b'").write.parquet(str(tmp_path / "e"))
    stream = incremental.deliveries(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
    q = incremental.windowed_counts(stream, "ts", "g").writeStream.format("memory").queryName("w_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.g, r.rows_) for r in spark.table("w_counts").collect()) == [("a", 2), ("b", 1)]
