import random
from collections import defaultdict

from pyspark.sql import functions as F

from figloom.llm import mixing as M
from figloom.llm.tokens import count_tokens

DOCS = "doc_id long, text string, source string, tokens int, pattern string, uses int"
TARGET = "source string, target_share double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, (t, s) in enumerate(rows)], DOCS)


def corpus(rng, n=900):
    rows = []
    for i in range(n):
        source = "big" if i % 3 else rng.choice(["Mid size", "mid-size", "MID_SIZE ", "small"])
        rows.append((f"text {i} " + "word " * rng.randrange(1, 60), source))
    return rows


def test_shares_and_repeats(spark):
    rows = corpus(random.Random(1))
    target = spark.createDataFrame([("big", 0.5, 1), ("mid_size", 0.4, 3), ("small", 0.05, 2), ("none at all", 0.05, 4)], TARGET)
    mixed = M.document_mix(docs(spark, rows), target)
    out = mixed.collect()
    assert len({r.doc_id for r in out}) == len(out)
    total = sum(r.uses * r.tokens for r in out)
    distinct = sum(count_tokens(t) for t, _ in rows)
    got = defaultdict(int)
    for r in out:
        assert r.tokens == count_tokens(rows[r.doc_id][0])
        assert r.uses <= {"big": 1, "mid_size": 3, "small": 2}[r.source]
        got[r.source] += r.uses * r.tokens
    for s, share in (("big", 0.5), ("mid_size", 0.4), ("small", 0.05)):
        assert abs(got[s] - share * distinct) < 150
    report = {r.source: r for r in M.mix_report(mixed, target).collect()}
    assert report["none_at_all"].mixed_tokens == 0 and report["none_at_all"].actual_share == 0
    assert abs(report["big"].actual_share - got["big"] / total) < 1e-5


def test_a_scarce_source_gives_all_it_has(spark):
    rows = [("filler number %d and more of it" % i, "big") for i in range(300)] + [("rare one", "rare"), ("rare two", "rare")]
    out = M.document_mix(docs(spark, rows), spark.createDataFrame([("big", 0.5, 1), ("rare", 0.5, 4)], TARGET)).collect()
    assert {r.doc_id: r.uses for r in out if r.source == "rare"} == {300: 4, 301: 4}


def test_overlapping_sources_share_their_texts(spark):
    """Texts filed under both sources serve both, and no text is used more than allowed."""
    rows = [("only a %d" % i, "a") for i in range(100)] + [("both %d and a few more" % i, s) for i in range(100) for s in "ab"]
    out = M.document_mix(docs(spark, rows), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGET)).collect()
    by = {s: sum(r.uses * r.tokens for r in out if r.source == s) for s in "ab"}
    assert abs(by["a"] - by["b"]) < 12
    used = defaultdict(int)
    for r in out:
        used[rows[r.doc_id][0]] += r.uses
    assert max(used.values()) == 1


def test_flow_against_brute_force():
    """Small cases over all integer routings: everything is met that can be, at least cost."""
    import itertools

    rng = random.Random(3)
    for _ in range(60):
        patterns = {("a",): rng.randrange(1, 4), ("a", "b"): rng.randrange(1, 4), ("b",): rng.randrange(1, 3)}
        repeats, quotas = {"a": rng.randrange(1, 3), "b": rng.randrange(1, 3)}, {"a": rng.randrange(0, 7), "b": rng.randrange(0, 7)}
        edges = [(p, s) for p in patterns for s in p]
        best = None
        for flow in itertools.product(*(range(patterns[p] * repeats[s] + 1) for p, s in edges)):
            f = dict(zip(edges, flow))
            if any(sum(f[e] for e in edges if e[1] == s) > quotas[s] for s in "ab"):
                continue
            used = {p: sum(f[p, s] for s in p) for p in patterns}
            if any(used[p] > patterns[p] * max(repeats[s] for s in p) for p in patterns):
                continue
            cost = sum(max(0, used[p] - k * patterns[p]) for p in patterns for k in range(1, 3))
            best = max(best or (-1, 0), (sum(flow), -cost))
        got = M.route(patterns, repeats, quotas)
        used = {p: sum(got.get((p, s), 0) for s in p) for p in patterns}
        assert (sum(got.values()), -sum(max(0, used[p] - k * patterns[p]) for p in patterns for k in range(1, 3))) == best


def test_edges(spark):
    target = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("b", None, None)], TARGET)
    assert M.document_mix(docs(spark, []), target).count() == 0
    assert M.document_mix(docs(spark, [("x", "a")]), target.limit(0)).count() == 0
    rows = [(None, "a"), ("", "a"), (" ", "a"), ("same", "a"), ("same", "A "), ("x", None), ("y", "zzz"), ("long " * 50_000, "a")]
    out = M.document_mix(docs(spark, rows), target).collect()
    assert {(r.doc_id, r.uses) for r in out} == {(3, 1), (7, 1)}
    empty = M.mix_report(M.document_mix(docs(spark, []), target), target).filter(F.col("source") == "a").first()
    assert (empty.actual_share, empty.texts) == (0, 0)


def test_the_mix_does_not_depend_on_the_layout_or_the_join(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, t, s, 1, "x", 2) for i, (t, s) in enumerate(corpus(rng))]
    target = spark.createDataFrame([("big", 0.3, 1), ("mid_size", 0.5, 3), ("small", 0.2, 2)], TARGET)
    found = []
    for parts in (1, 6):
        rng.shuffle(rows)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(sorted(map(str, M.document_mix(spark.createDataFrame(rows, DOCS).repartition(parts), target).collect())))
        monkeypatch.setattr(M, "MAX_SENT", 0)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]
    assert all(r.kept and not r.twice for r in M.repeats_kept(spark.createDataFrame(rows, DOCS), target).collect())
