import json

from pyspark.sql import functions as F

from figloom.schemas import PAPERS
from figloom.sources import notes as N


def flat(i, replies=(), **content):
    return json.dumps({"id": i, "tcdate": 1583020800000, "content": {"title": "T", "authors": ["A B", "C"], "keywords": [], **content}, "details": {"directReplies": list(replies)}})


def wrapped(i, replies=(), **content):
    base = {"title": "T", "authors": ["A B"], **content}
    return json.dumps({"id": i, "tcdate": 1583020800000, "content": {k: {"value": v} for k, v in base.items()}, "details": {"directReplies": list(replies)}})


def rows(spark, notes, version, **kw):
    df = spark.createDataFrame([(n, 2020, d, s, p) for n, d, s, p in notes], "note string, year long, default_decision string, source_order int, pos int")
    out = N.normalized(df, version, "ICLR", **kw)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in PAPERS]
    return {r.platform_id: r for r in out.collect()}


def test_flat_notes(spark):
    said = {"invitation": "X/Paper1/Official_Review", "content": {"rating": "8: Top 50%"}}
    meta = {"invitation": "X/Paper1/Meta_Review", "content": {"recommendation": "Accept"}}
    later = {"invitation": "X/Paper1/Decision", "content": {"decision": "Reject"}}
    odd = [{"invitation": "r", "content": {"rating": x}} for x in (7, "n/a", 0, None, " 5 : ok", "")]
    got = rows(
        spark,
        [
            (flat("a", [said, meta, later], **{"TL;DR": None, "TLDR": "second"}), None, 0, 0),
            (flat("b", odd, TLDR="second", withdrawal="Confirmed"), None, 0, 1),
            (flat("c", [{"invitation": "r", "content": {"recommendation": "3: weak"}}], keywords=["x", "y"]), "Desk Reject", 0, 2),
            (flat("a", title="later"), None, 1, 0),
            (json.dumps({"content": {"title": "no id"}}), None, 0, 3),
            ("not json", None, 0, 4),
        ],
        1,
    )
    assert set(got) == {"a", "b", "c"}
    assert got["a"].decision == "Accept" and got["a"].scores == [8] and got["a"].title == "T"
    assert got["a"].tldr == ""  # a key that is there but null hides the next one
    assert got["a"].cdate == "20200301" and got["a"].authors == "A B, C" and got["a"].keywords == "" and got["a"].bibtex is None
    assert got["b"].decision == "withdrawn" and got["b"].scores == [7, 5] and got["b"].tldr == "second"
    assert got["c"].decision == "Desk Reject" and got["c"].scores == [3] and got["c"].keywords == "x, y"
    assert got["c"].url.endswith("id=c")


def test_wrapped_notes(spark):
    v = lambda **k: {"content": {n: {"value": x} for n, x in k.items()}}
    got = rows(
        spark,
        [
            (wrapped("a", [v(title="Review", rating="6: ok"), v(title="Paper Decision"), v(title="Paper Decision", recommendation="Accept (Oral)")], TLDR="second", **{"TL;DR": ""}), None, 0, 0),
            (wrapped("b", [v(rating=8)]), None, 0, 1),
        ],
        2,
    )
    assert got["a"].decision == "Accept (Oral)" and got["a"].scores == [6] and got["a"].tldr == "second"
    assert got["b"].decision == N.PENDING and got["b"].scores == [8]


def test_venue_strings_and_bibtex_years(spark):
    bib = "@article{x,\nyear={2023}\n}"
    notes = [(wrapped("a", venue="ICML 2023 Poster", _bibtex=bib), None, 0, 0), (wrapped("b", _bibtex=bib), None, 0, 1), (wrapped("c", venue="V"), None, 0, 2)]
    got = rows(spark, notes, 2, decision="venue", with_scores=False, year_from_bibtex=True)
    assert set(got) == {"a"} and got["a"].year == 2023 and got["a"].scores == [] and got["a"].decision == "ICML 2023 Poster"


def fetch(invitation, limit):
    return [flat(f"{invitation}-{i}") for i in range(5)]


def test_note_source_and_discovery(spark, tmp_path, monkeypatch):
    (tmp_path / "figloom_fetch_fixture.py").write_text("import json\ndef fetch(i, limit):\n    return [json.dumps({'id': f'{i}-{k}'}) for k in range(5)]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "figloom_fetch_fixture.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.dataSource.register(N.NoteSource)
    df = spark.read.format("notes").option("invitations", "X/1, X/2").option("limit", 3).option("fetch", "figloom_fetch_fixture:fetch").load()
    assert df.count() == 6 and df.select(F.get_json_object("note", "$.id")).distinct().count() == 6

    def probe(name):
        if "bad" in name:
            raise OSError("404")
        return name.endswith("2024/Submission")

    found = N.invitations(spark, [2023, 2024], ["Submission", "bad"], "C/{year}/{suffix}", probe)
    assert [tuple(r) for r in found.collect()] == [(2024, "C/2024/Submission")]
