import pytest

from figloom.operators import packed_values
from figloom.operators.packed_values import paper_keywords, parse, parses, split_packed, unwrap
from pyspark.sql import functions as F

CASES = [
    ("alpha beta, gamma", ["alpha beta", "gamma"]),
    ("alpha ,beta / gamma;delta", ["alpha", "beta", "gamma", "delta"]),
    ("zero/one losses; l1/l2 penalties", ["zero/one losses", "l1/l2 penalties"]),
    ("['one two', \"Don't-care States\"]", ["one two", "Don't-care States"]),
    ("Key words - Bayes' rule, layout recovery", ["Bayes' rule", "layout recovery"]),
    ('a, "so-called ""soft"" masks", b', ["a", 'so-called "soft" masks', "b"]),
    ("KEYWORDS:graph\\, set and tree encoders, (max, plus) algebra", ["graph, set and tree encoders", "(max, plus) algebra"]),
    ("few-shot: 1\\, 5 and 10; “yes | no questions”", ["few-shot: 1, 5 and 10", "yes | no questions"]),
    ("{trees (rooted; ordered), Tree}", ["trees (rooted; ordered)", "Tree"]),
    ("one、two、two", ["one", "two", "two"]),
    ("one\r\ntwo\n\nthree\n", ["one", "two", "three"]),
    (", one, , two", ["one", "two"]),
    ("'a, b', (open, c", ["a, b", "(open", "c"]),
    ("one || two || A\\|B three", ["one", "two", "A|B three"]),
    (",;,", []),
]


def test_cheapest_parse(spark):
    df = spark.createDataFrame([(str(i), f) for i, (f, _) in enumerate(CASES)], "id string, field string")
    got = {}
    for r in split_packed(df, F.col("id"), F.col("field")).orderBy("id", "pos").collect():
        got.setdefault(int(r.id), []).append((r.pos, r.value))
    for i, (field, values) in enumerate(CASES):
        assert got.get(i, []) == list(enumerate(values, 1)), field


def test_round_trip_of_quoted_values():
    values = ["a, b", 'say "x"', "c; d | e", "plain"]
    packed = ", ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert any(v == values for _, v in parses(packed))


@pytest.mark.parametrize("field,values", [("a, b; c • d / e, f", ["a", "b; c • d", "e", "f"]), ("a, b; c • d / e、f", ["a", "b", "c", "d / e、f"])])
def test_every_set_of_separators_is_tried(field, values):
    """Two of four kinds of marks separate, three of five."""
    assert any(v == values for _, v in parses(field))


@pytest.mark.parametrize("hot", [1000, 0])
def test_corpus_decides_an_ambiguous_field(spark, monkeypatch, hot):
    monkeypatch.setattr(packed_values, "HOT_VALUES", hot)
    # Alone, the comma would split the field; the corpus knows the whole value well.
    field = "big, wide; trees"
    alone = spark.createDataFrame([("a", field)], "id string, field string")
    assert len(split_packed(alone, F.col("id"), F.col("field")).collect()) == 3
    rows = [("a", field)] + [(f"o{i}", "'big, wide'; trees") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, field string")
    out = split_packed(df, F.col("id"), F.col("field")).filter("id = 'a'").orderBy("pos").collect()
    assert [r.value for r in out] == ["big, wide", "trees"]


def test_edges(spark):
    schema = "platform_id string, keywords string, loaded_at timestamp_ntz, id string, pos int, value string"
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    assert paper_keywords(spark.createDataFrame([], schema)).count() == 0
    long = ", ".join(f"w{i}" for i in range(20_000))
    rows = [("a", None, t, "x", 1, "y"), ("b", "  ", t, "x", 1, "y"), (None, "q, r", t, "x", 1, "y"), ("c", "old", t, None, None, None), ("c", "new, new", t + dt.timedelta(1), None, None, None), ("d", long, None, None, None, None)]
    out = paper_keywords(spark.createDataFrame(rows, schema)).collect()
    assert [(r.pos, r.keyword) for r in sorted(out, key=lambda r: r.pos) if r.platform_id == "c"] == [(1, "new"), (2, "new")]
    assert sum(r.platform_id == "d" for r in out) == 20_000
    assert {r.platform_id for r in out} == {"c", "d"}


def test_hostile_fields_stay_linear():
    for field in (',"a' * 20_000, "(" * 20_000 + ")" * 20_000, "[" * 20_000 + "]" * 20_000, "\\" * 20_000):
        parse(unwrap(field), (frozenset([","]), True))
