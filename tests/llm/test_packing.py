import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from figloom.llm import packing as P
from figloom.llm.tokens import count_tokens

DOCS = "doc_id long, text string, tokens int, row int, key string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "k") for i, t in enumerate(texts)], DOCS)


def requests(spark, *capacities):
    return spark.createDataFrame(list(enumerate(capacities, 1)), "request_id int, capacity_tokens int")


def test_two_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 12))]
        gap, beyond = rng.randrange(1, 45), rng.randrange(0, 20)
        sums = [a + b for i, a in enumerate(sizes) for b in sizes[i + 1 :] if beyond < a + b <= gap]
        found = P.best_two(P._Pool(np.array(sizes, dtype=int)), gap, beyond)
        assert (sum(found) if found else None) == max(sums, default=None)


def test_two_fit_is_found_below_many_sizes_without_a_partner():
    sizes = np.array([*range(2493, 3192), 1500, 700])
    assert P.best_two(P._Pool(sizes), 3192, 0) == (1500, 700)


def test_packing_is_whole_and_tight():
    rng = random.Random(2)
    sizes = np.array([min(500, int(rng.lognormvariate(4, 1)) + 1) for _ in range(5000)])
    boxes = P.pack_sizes(sizes, 512)
    assert Counter(s for b in boxes for s in b) == Counter(sizes.tolist())
    assert all(sum(b) <= 512 for b in boxes)
    assert sizes.sum() / (512 * len(boxes)) > 0.995


def test_every_text_lies_once_in_each_request(spark):
    rng = random.Random(3)
    texts = [" ".join(["word"] * rng.randrange(0, 60)) for _ in range(300)] + ["long text " * 2000, None, "", " ", "twice", "twice"]
    df, caps = docs(spark, texts), {1: 64, 2: 257}
    rows = P.document_containers(df, requests(spark, *caps.values())).collect()
    for request, most in caps.items():
        mine, boxes = defaultdict(list), defaultdict(int)
        for r in rows:
            if r.request_id == request:
                mine[r.doc_id].append(r)
                boxes[r.container_id] += r.tokens
        assert set(mine) == set(range(len(texts)))
        assert max(boxes.values()) <= most
        for i, text in enumerate(texts):
            parts = sorted(mine[i], key=lambda r: r.piece)
            n = count_tokens(text or "")
            assert len(parts) == max(1, -(-n // most))
            assert [r.first_token for r in parts] == [k * most for k in range(len(parts))]
            assert sum(r.tokens for r in parts) == n
    fill = {r.request_id: r for r in P.container_fill(df, requests(spark, *caps.values())).collect()}
    assert fill[1].used_share > 0.97 and fill[1].fullest <= 64


def test_edges(spark):
    assert P.document_containers(docs(spark, []), requests(spark, 8)).count() == 0
    assert P.document_containers(docs(spark, ["a"]), requests(spark, 0)).count() == 0
    empty = P.document_containers(docs(spark, [None, ""]), requests(spark, 8)).collect()
    assert [(r.tokens, r.piece) for r in empty] == [(0, 0)] * 2
    exact = P.document_containers(docs(spark, ["one two three four"]), requests(spark, 4)).collect()
    assert len(exact) == 1
    special = P.document_containers(docs(spark, ["<|endoftext|>"]), requests(spark, 100)).collect()
    assert special[0].tokens > 1


def test_shards_together_hold_everything(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 50)
    rows = P.document_containers(docs(spark, ["a b c"] * 400), requests(spark, 10)).collect()
    assert len(rows) == 400 and max(Counter(r.container_id for r in rows).values()) <= 3


def test_containers_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 80)
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.randrange(0, 40)), 1, 2, "k") for i in range(300)] + [(None, "same text here", 1, 2, "k")] * 150
    found = []
    for parts in (1, 5):
        rng.shuffle(rows)
        spark.conf.set("spark.sql.shuffle.partitions", parts + 1)
        placed = P.document_containers(spark.createDataFrame(rows, DOCS).repartition(parts), requests(spark, 64, 200))
        found.append(sorted(map(str, placed.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] and len(found[0]) >= 900
    kept = P.containers_kept(spark.createDataFrame([r for r in rows if r[0] is not None], DOCS), requests(spark, 64, 200)).collect()
    assert [(r.documents, r.overfull, r.misplaced) for r in kept] == [(300, 0, 0)] * 2


def test_very_many_equal_rows_are_dealt_in_lots(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 50)
    monkeypatch.setattr(P, "LOT", 2)
    monkeypatch.setattr(P, "LOTS", 3)
    rows = P.document_containers(docs(spark, []).unionByName(spark.createDataFrame([(7, "a b c", 1, 2, "k")] * 101, DOCS)), requests(spark, 10)).collect()
    assert len(rows) == 101 and {r.doc_id for r in rows} == {7}


def test_too_many_requests_are_refused_and_a_caller_can_raise_the_number(spark):
    from pyspark.sql import functions as F

    args = docs(spark, ["a"]), F.col("doc_id"), F.col("text"), requests(spark, 5, 6), "request_id", "capacity_tokens"
    with pytest.raises(ValueError):
        P.pack_documents(*args, most_requests=1)
    assert P.pack_documents(*args, most_requests=2).count() == 2
