import datetime as dt
import random
from collections import Counter

import numpy as np

from figloom.llm import near_duplicates as N

SCHEMA = "platform_id string, title string, abstract string, loaded_at timestamp_ntz, a string, b string, bag_id int, id int"
T0 = dt.datetime(2026, 1, 1)


def papers(spark, rows):
    return spark.createDataFrame([(i, t, a, T0, "x", "y", 1, 2) for i, t, a in rows], SCHEMA)


def bag(text):
    return Counter(N.WORD.findall(text.lower()))


def brute(rows):
    bags = {i: bag(f"{t or ''} {a}") for i, t, a in rows if i and a and a.strip()}
    ids = sorted(bags)
    return {(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if bags[x] and 5 * (bags[x] & bags[y]).total() >= 4 * max(bags[x].total(), bags[y].total())}


def corpus(rng, vocabulary=3000):
    words = [f"w{i}" for i in range(vocabulary)] + ["the", "of", "a"] * 200
    rows = []
    for k in range(40):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        for copy in range(rng.choice([1, 1, 2, 3, 12])):
            edited = list(text)
            for _ in range(rng.randrange(0, len(text) // 14)):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([[], [rng.choice(words)], [edited[at], rng.choice(words)]])
            if copy % 3 == 2:
                rng.shuffle(edited)
            rows.append((f"p{k}-{copy}", " ".join(edited[:8]).title(), " ".join(edited[8:]) + "."))
    return rows


def test_pairs_against_brute_force(spark):
    rows = corpus(random.Random(5))
    got = [(r.platform_id_a, r.platform_id_b) for r in N.similar_papers(papers(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert len(got) > 100


def test_small_buckets_are_joined_like_hot_ones(spark, monkeypatch):
    rows = corpus(random.Random(8))
    monkeypatch.setattr(N, "HOT_BUCKETS", 0)
    assert {tuple(r) for r in N.similar_papers(papers(spark, rows)).collect()} == brute(rows)


def test_classes_are_the_components_of_the_pairs(spark):
    rows = corpus(random.Random(6))
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in sorted(brute(rows)):
        a, b = sorted((find(x), find(y)))
        root[b] = a
    got = {r.platform_id: r.class_id for r in N.paper_classes(papers(spark, rows)).collect()}
    assert got == {i: find(i) for i in root}


def test_edges_and_hot_copies(spark):
    assert N.similar_papers(papers(spark, [])).count() == 0
    assert N.paper_classes(papers(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [("a", None, "one two three"), ("b", "three", "two ONE"), ("c", "t", None), ("d", "t", " "), ("e", "t", ""), (None, "t", "one two three"), ("f", "", "?!"), ("l1", "x", long), ("l2", "x", long + " y")]
    rows += [(f"h{i:03d}", "hot copy", "of the same text here") for i in range(60)]
    assert {tuple(r) for r in N.similar_papers(papers(spark, rows)).collect()} == brute(rows)
    classes = {r.platform_id: (r.class_id, r.n_links) for r in N.paper_classes(papers(spark, rows)).collect()}
    assert classes["b"] == ("a", 0) and classes["l2"] == ("l1", 1) and classes["h059"] == ("h000", 0)
    assert not {"c", "d", "e", "f", None} & classes.keys()


def test_a_later_delivery_counts(spark):
    rows = [("a", "x", "old words only here", T0), ("a", "x", "new words and more", T0 + dt.timedelta(1)), ("b", "x", "new words and more", T0)]
    df = spark.createDataFrame(rows, "platform_id string, title string, abstract string, loaded_at timestamp_ntz")
    assert [tuple(r) for r in N.similar_papers(df).collect()] == [("a", "b")]


def test_densified_sketch_estimates_jaccard():
    rng, words = random.Random(1), N._Words()
    for share in (0.5, 0.75, 0.9):
        base = [f"t{i}" for i in range(150)]
        cut = round(150 * 2 * share / (1 + share))
        other = base[:cut] + [f"u{i}" for i in range(150 - cut)]
        rng.shuffle(other)
        sketch = N.one_permutation(*N.bags_of([" ".join(base), " ".join(other)], words), 512)
        assert not (sketch == N._EMPTY).any()
        assert abs((sketch[0] == sketch[1]).mean() - share) < 0.12
    assert (N.one_permutation(*N.bags_of(["", "x"], words), 64)[0] == N._EMPTY).all()
    assert np.unique(N.one_permutation(*N.bags_of(["x"], words), 64)).size == 1


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)], "a long, b long")
    got = {r.node: r.root for r in N.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_pairs_at_the_limit_share_a_bucket():
    """80 of 100 words in common: no pair of the rule is less similar."""
    rng, texts = np.random.default_rng(11), []
    for _ in range(1500):
        w = [f"w{i}" for i in rng.choice(10**6, 120, replace=False)]
        texts += [" ".join(w[:100]), " ".join(w[20:])]
    bands = N.bands_of(N.one_permutation(*N.bags_of(texts, N._Words()), N.ROWS * N.BANDS))
    assert (bands[::2] == bands[1::2]).any(axis=1).mean() >= 0.99
