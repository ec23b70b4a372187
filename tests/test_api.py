import json

from pyspark.sql import functions as F

from figloom import api


def test_ingest_reads_both_forms(spark):
    flat = json.dumps({"id": "a", "content": {"title": "old"}})
    wrapped = json.dumps({"id": "a", "content": {"title": {"value": "new"}}})
    other = json.dumps({"id": "b", "content": {"title": {"value": "b"}}})
    raw = spark.createDataFrame([(flat, 2020, None, 0, 0), (wrapped, 2024, None, 1, 0), (other, 2025, None, 2, 0)], "note string, year long, default_decision string, source_order int, pos int")
    got = {r.platform_id: (r.title, r.year) for r in api.ingest(raw, api.VENUES["ICLR"]).collect()}
    assert got == {"a": ("old", 2020), "b": ("b", 2025)}
    assert api.ingest(raw, api.VENUES["TMLR"]).count() == 0


def test_contexts(spark):
    text = "Figure 2: a caption of it\n\nAs Fig. 2 and 3 show, all is well.\n\nshort\n\nSee Figure 5b for some more detail."
    docs = spark.createDataFrame([("p", text), ("q", None)], "pid string, text string")
    figures = spark.createDataFrame([("p", "2"), ("p", "3"), ("p", "5b"), ("p", "2"), ("q", "1")], "pid string, figure_number string")
    got = {r.figure_number: r.context for r in api.contexts(docs, figures, "pid", F.col("text")).collect()}
    assert got == {n: "<paragraph_1>As Fig. 2 and 3 show, all is well.</paragraph_1>" for n in "23"}
    assert set(r.figure_number for r in api.contexts(docs, figures, "pid", F.col("text"), strict=False).collect()) == {"2", "3", "5b"}


def test_retrieve_and_validate(spark):
    corpus = spark.createDataFrame([(i, [float(i)], [float(i)], [float(-i)]) for i in range(30)], "id long, t array<float>, a array<float>, c array<float>")
    got = api.retrieve(corpus, "id", {"title": "t", "abstract": "a", "caption": "c"}, {"title": [0.0], "abstract": [9.0], "caption": [-5.0]}, 8, 4, 2)
    assert [(r.id, r.distance) for r in got.orderBy("distance").collect()] == [(5, 0.0), (4, 1.0)]
    report = {r.check_: r.ok for r in api.validate(corpus, 30, {"title": 30, "caption": 29}).collect()}
    assert report == {"rows": True, "ids": True, "vectors of title": True, "vectors of caption": False}


def test_contexts_of_several_documents(spark):
    text = "As Fig. 1 shows, all is well."
    docs = spark.createDataFrame([("p", i, f"{text} {i}") for i in range(3)], "pid string, doc long, text string")
    figures = spark.createDataFrame([("p", "1"), (None, "1")], "pid string, figure_number string")
    got = {(r.doc, r.context) for r in api.contexts(docs, figures, "pid", F.col("text"), document="doc").collect()}
    assert got == {(i, f"<paragraph_1>{text} {i}</paragraph_1>") for i in range(3)}
