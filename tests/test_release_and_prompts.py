"""Releases, moves of assets, prompts, costs: small tables with known results."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from figloom import schemas
from figloom.functions import text as X
from figloom.operators import assets, external, prompting, release, sync
from figloom.sources import files, notes


def frame(spark, schema, rows, **extra):
    """Rows given by some columns only; the others are null."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_release(spark):
    at = lambda schema: schema.__class__(schema.fields + [schemas.T.StructField("loaded_at", schemas.L)])
    papers = frame(spark, at(schemas.PAPERS), [{"platform_id": "a", "title": "old", "loaded_at": 1}, {"platform_id": "a", "title": "new", "loaded_at": 2}, {"platform_id": "b"}, {"platform_id": None, "title": "x"}])
    figures = frame(spark, at(schemas.FIGURES), [{"platform_id": "a", "figure_number": n, "figure_caption": f"c{n}", "loaded_at": 1} for n in ("2", "1", "10")] + [{"platform_id": "zz", "figure_number": "1"}, {"platform_id": None, "figure_number": "1"}])
    labels = spark.createDataFrame([("a", "1", "diagram", "keep", 5), ("a", "1", "diagram", "drop", 5)], "platform_id string, figure_number string, clip_type string, final_decision string, id int")
    for c in release._LABELS:
        if c not in labels.columns:
            labels = labels.withColumn(c, F.lit(None).cast(schemas.RELEASE[c].dataType))
    got = release.build_release(papers, figures, labels)
    assert [f.name for f in got.schema] == schemas.RELEASE.fieldNames()
    rows = got.orderBy("id").collect()
    assert [(r.id, r.platform_id, r.figure_number, r.title, r.figure_caption, r.clip_type) for r in rows] == [(0, "a", "1", "new", "c1", "diagram"), (1, "a", "10", "new", "c10", None), (2, "a", "2", "new", "c2", None)]
    kept = release.build_release(papers, figures, labels, keep=F.col("final_decision") == "keep").collect()
    assert [(r.id, r.figure_number) for r in kept] == [(0, "1")]
    assert release.build_release(papers.limit(0), figures, labels).count() == 0


def test_release_checks(spark, tmp_path):
    import struct

    (tmp_path / "a.index").write_bytes(b"IxF2" + struct.pack("<IQ", 8, 3) + b"rest")
    df = spark.createDataFrame([(i,) for i in (0, 1, 1)], "id int")
    got = {r.check_: (r.expected, r.actual, r.ok) for r in release.check_release(df, 3, {"title": str(tmp_path / "a.index"), "abstract": str(tmp_path / "no")}, {"index": str(tmp_path / "a.index"), "db": str(tmp_path / "none")}).collect()}
    assert got == {"rows": (3, 3, True), "ids": (3, 2, False), "vectors of title": (3, 3, True), "vectors of abstract": (3, -1, False), "file index": (1, 1, True), "file db": (1, 0, False)}


def test_asset_moves(spark, tmp_path):
    base = tmp_path / "V"
    for path in ("papers/2024/pending_unknown/a/main.pdf", "figures/2024/pending_unknown/a/Figure1.png", "figures/2024/pending_unknown/a/Figure2b.png", "papers/2024/pending_unknown/b/main.pdf", "papers/2024/reject/b/main.pdf", "papers/2025/pending_unknown/c/main.pdf", "papers/2025/pending_unknown/d/main.pdf"):
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(b"z")
    found = files.pending_assets(spark, str(base)).withColumn("root", F.concat(F.lit(f"{base}/"), "kind"))
    decisions = spark.createDataFrame([("a", "Accept (Oral)"), ("b", "Reject"), ("c", "pending/unknown")], "platform_id string, decision string")
    folders = files.listing(spark, str(base)).select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("path"))
    plan = assets.plan_moves(found, decisions, folders)
    assert {(r.kind, r.platform_id): r.status for r in plan.collect()} == {("papers", "a"): "moved", ("figures", "a"): "moved", ("papers", "b"): "exists", ("papers", "c"): "skipped", ("papers", "d"): "missing"}

    def move(source, target):
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        shutil.move(source, target)

    exists = lambda p: Path(p).exists()
    assert assets.apply_moves(plan, move, exists, dry_run=True).filter("status = 'moved'").count() == 2 and (base / "papers/2024/pending_unknown/a").exists()
    assert [r.kind for r in assets.apply_moves(plan, move, exists, dry_run=True, limit=1).collect()] == ["figures"]
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    done = assets.apply_moves(plan, move, exists).collect()
    again = assets.apply_moves(plan, move, exists)  # as a task that is run again
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, done), key=str)
    assert (base / "papers/2024/accept_oral/a/main.pdf").exists() and not (base / "papers/2024/pending_unknown/a").exists()
    updates = assets.moved_figure_paths(again, files.listing(spark, str(base)), str(tmp_path))
    figures = spark.createDataFrame([("a", "1", "old"), ("a", "2b", "old"), ("b", "1", "old")], "platform_id string, figure_number string, figure_path string")
    new = {(r.platform_id, r.figure_number): r.figure_path for r in sync.keyed_update(figures, updates, ["platform_id", "figure_number"], ["figure_path"]).collect()}
    assert new == {("a", "1"): "V/figures/2024/accept_oral/a/Figure1.png", ("a", "2b"): "V/figures/2024/accept_oral/a/Figure2b.png", ("b", "1"): "old"}
    assert {(r.kind, r.status): r.assets for r in assets.move_counts(again).collect()}[("all", "eligible")] == 2
    extracted = spark.createDataFrame([("p", "1", "/tmp/x.png")], "platform_id string, name string, render_url string")
    assert assets.figure_placement(extracted, F.lit("/r")).first().target_path == "/r/p/Figure1.png"


def test_prompts_and_run(spark):
    corpus = spark.createDataFrame([(i, [float(i), float(i), float(i)]) for i in range(20)], "id long, v array<float>")
    pictures = spark.createDataFrame([(i, None if i == 5 else bytes([i]), f"c{i}") for i in range(20)], "id long, picture binary, caption string")
    queries = spark.createDataFrame([(100, "T", None, "C", [5.2, 5.2, 5.2]), (101, "bad", "A", "C", [9.0, 9.0, 9.0])], "query long, title string, abstract string, caption string, v array<float>")

    def writer():
        def write(parts):
            if "<title>bad</title>" in parts[-1]["text"]:
                raise OSError("no")
            return " ".join(p["text"] if p["kind"] == "text" else "(picture)" for p in parts), 7, 3

        return write

    views = (slice(0, 1), slice(1, 2), slice(2, 3))
    import functools

    quick = functools.partial(external.generate, tries=1)
    original, external.generate = external.generate, quick
    try:
        rows = {r.query: r for r in prompting.run(queries, corpus, "id", "v", views, pictures, writer, "Look:", "Begin.", k=2, t1=6, t2=4).collect()}
    finally:
        external.generate = original
    said = rows[100].description
    # The nearest one has no picture: the other keeps its number.
    assert "--- Reference 1 ---" not in said and "--- Reference 2 ---" in said and "<reference_caption>c6</reference_caption>" in said
    assert said.startswith("Look:") and said.endswith("<title>T</title>\n<abstract></abstract>\n<caption>C</caption>\nBegin.")
    assert [p.kind for p in rows[100].parts] == ["text", "text", "text", "image"] and rows[100].parts[0].text == said
    assert rows[101].error == "OSError: no" and rows[101].parts is None


def test_answers_drawings_and_costs(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "slow"), (3, "no"), (4, None), (5, "wrong")], "id int, p string")

    def make():
        seen = []

        def ask(p):
            seen.append(p)
            if p == "wrong":
                raise ValueError("bad prompt")
            if p == "no" or (p == "slow" and seen.count(p) < 3):
                raise OSError("busy")
            return 'Here: {"label": "' + p + '", "n": 2} .', 10, 4

        return ask

    said = df.select("id", external.generate(F.col("p"), make, 4, wait=lambda s: None, throttled=lambda e: isinstance(e, OSError)).alias("a"))
    said = spark.createDataFrame(said.collect(), said.schema)
    tries = {r.id: r.a and r.a.tries for r in said.collect()}
    assert tries == {1: 1, 2: 3, 3: 4, 4: None, 5: 1}
    counts = external.call_counts(said, "a").first()
    assert (counts.calls, counts.failed, counts.retries, counts.input_tokens, counts.output_tokens) == (4, 2, 5, 20, 8)
    parsed = {r.id: r.s for r in said.select("id", external.structured(F.col("a.answer"), "label string, n int").alias("s")).collect()}
    assert (parsed[2].label, parsed[2].n) == ("slow", 2) and parsed[3] is None

    def painter():
        return lambda p: (p.encode(), 1000, 1 << 20) if p != "no" else 1 / 0

    drawn = {r.id: r.d for r in df.select("id", external.draw(F.col("p"), painter).alias("d")).collect()}
    assert bytes(drawn[1].image) == b"ok" and drawn[3].image is None and "ZeroDivisionError" in drawn[3].error and drawn[4] is None
    cost = df.select(external.drawing_cost(F.lit(1000), F.lit(1 << 20), 0.3, 0.04).alias("c")).first().c
    assert cost == pytest.approx(0.0403)
    prices = spark.createDataFrame([("m", 0.003, 0.015)], "model string, input double, output double")
    use = spark.createDataFrame([("m", 1000, 2000), ("m", None, 1000)], "model string, input_tokens long, output_tokens long")
    assert sorted(r.cost for r in external.usage_costs(use, prices).collect()) == pytest.approx([0.015, 0.033])
    with pytest.raises(Exception, match="no price for the model x"):
        external.usage_costs(use.withColumn("model", F.lit("x")), prices).collect()


def test_source_maps(spark):
    iclr = [tuple(r) for r in notes.source_map(spark, "ICLR").orderBy("source_order").collect()]
    assert iclr[0] == (2017, 0, "ICLR.cc/2017/conference/-/submission", None) and len(iclr) == 28
    assert (2020, 9, "ICLR.cc/2020/Conference/-/Blind_Submission", None) in iclr and iclr[-3][2:] == ("ICLR.cc/2026/Conference/-/Withdrawn_Submission", "withdrawn")
    assert [tuple(r) for r in notes.source_map(spark, "TMLR").collect()] == [(None, 0, "TMLR/-/Submission", None)]
    raw = spark.createDataFrame([("ICML.cc/2025/Conference/-/Desk_Rejected_Submission", 3, '{"id": "n1"}'), ("ICML.cc/2025/Conference/-/Submission", 0, '{"id": "n2"}'), ("other", 0, "{}")], "invitation string, pos int, note string")
    joined = notes.with_sources(raw, notes.source_map(spark, "ICML"))
    assert {(r.year, r.default_decision) for r in joined.collect()} == {(2025, "desk reject"), (2025, None)}
    assert notes.note_by_id(joined, "n2").first().pos == 0


def test_formats_and_union(spark):
    r = spark.range(1).select(X.grouped(F.lit(57100)).alias("n"), X.padded((F.lit("ab"), 4), (F.lit(7), -3), (F.lit("toolong"), 3)).alias("p"), X.pdf_url(F.lit("x"), "https://h").alias("u")).first()
    assert (r.n, r.p, r.u) == ("57,100", "ab     7 toolong", "https://h/pdf?id=x")
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(2, 5)], "id int, w int")
    assert sorted(tuple(r) for r in sync.union_tables(a, b, a).collect()) == sorted([(1, "x", None), (2, None, 5), (1, "x", None)])
    blocks = spark.createDataFrame([(1, [(0, "An exam-\nple  text"), (1, "picture"), (0, " \n"), (0, "next"), (0, None)]), (2, None)], "id int, b array<struct<kind: int, text: string>>")
    assert {r.id: r.t for r in blocks.select("id", X.block_text(F.col("b")).alias("t")).collect()} == {1: "An example text\n\nnext", 2: ""}
