import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from figloom.operators import snapshots as S
from figloom.operators.snapshots import CHUNK, assign_ordinals, compress, paper_changes

SCHEMA = "platform_id string, decision string, snapshot_no int, loaded_at timestamp_ntz, key string, ordinal int"


def brute(rows):
    valid = {}
    for pid, dec, no, at, *_ in rows:
        pid = (pid or "").strip()
        v = "".join((dec or "").split()).lower() or None
        if pid:
            rank = (at is not None, at or dt.datetime.min, v is not None, v or "")
            if (no, pid) not in valid or rank > valid[no, pid][0]:
                valid[no, pid] = rank, v
    numbers = sorted({r[2] for r in rows})
    out = set()
    for a, b in zip(numbers, numbers[1:]):
        old, new = ({p: v for (n, p), (_, v) in valid.items() if n == x} for x in (a, b))
        out |= {(b, p, "added") for p in new.keys() - old.keys()} | {(b, p, "removed") for p in old.keys() - new.keys()}
        out |= {(b, p, "changed") for p in new.keys() & old.keys() if new[p] != old[p]}
    return out


def got(spark, rows):
    df = paper_changes(spark.createDataFrame(rows, SCHEMA))
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_containers_and_their_differences():
    rng = np.random.default_rng(1)
    runs = [x for k in range(0, 9000, 30) for x in range(k, k + 20)]
    sets = [[], [0], [CHUNK - 1], range(CHUNK), range(100, 9000), runs, sorted(rng.choice(CHUNK, 700, False)), sorted(rng.choice(CHUNK, 9000, False)), sorted(rng.choice(CHUNK, 8000, False))]
    made = [(np.array(list(x), dtype=np.int64), compress(np.array(list(x), dtype=np.int64))) for x in sets]
    assert {c[0] for _, c in made} == {S.ARRAY_KIND, S.BITMAP_KIND, S.RUN_KIND}
    for low, c in made:
        assert (S.members(c) == low).all() and len(c) <= 1 + CHUNK // 8
        for other, d in made:
            assert (S.and_not(c, d) == np.setdiff1d(low, other)).all()
            assert (S.contains(d, low) == np.isin(low, other)).all()
        assert (S.and_not(c, None) == low).all() and not len(S.and_not(None, c))


def test_a_later_snapshot_is_compared_with_the_stored_one(spark, tmp_path):
    rng = random.Random(9)
    t0 = dt.datetime(2026, 1, 1)
    rows = {no: [(f"k{rng.randrange(400)}", rng.choice(["a", "b", None, "c" * 100, "c" * 101]), no, t0 + dt.timedelta(seconds=i), "x", 1) for i in range(500)] for no in (1, 4, 6, 9)}
    rows[9] += [(f"new{i}", "x", 9, t0, "x", 1) for i in range(50)]
    want = brute([r for no in rows for r in rows[no]])
    args = F.col("platform_id"), F.col("snapshot_no"), S.decision_value(F.col("decision")), F.col("loaded_at")
    root, found, ordinals = str(tmp_path / "state"), set(), {}
    for numbers in ((1, 4), (6,), (9,)):  # each delivery is all that is read of the rows
        df = spark.createDataFrame([r for no in numbers for r in rows[no]], SCHEMA)
        found |= {tuple(r) for r in S.advance(df, root, *args).collect()}
        now = {r.key: r.ordinal for r in S.dictionary(spark, root).collect()}
        assert sorted(now.values()) == list(range(len(now))) and ordinals.items() <= now.items()
        ordinals = now
    assert found == want
    assert {tuple(r) for r in S.changes_between(spark, root, [(4, 6)]).collect()} == {c for c in want if c[0] == 6}
    with pytest.raises(ValueError):
        S.add_snapshots(spark.createDataFrame(rows[6], SCHEMA), root, *args)
    # An attempt that fails leaves the state as it was, and its parts behind do no harm.
    bad = spark.createDataFrame(rows[9], SCHEMA).withColumn("snapshot_no", F.lit(12)).withColumn("platform_id", F.when(F.col("platform_id") == "new3", F.raise_error(F.lit("stop"))).otherwise(F.col("platform_id")))
    with pytest.raises(Exception, match="stop"):
        S.add_snapshots(bad, root, *args)
    empty = spark.createDataFrame([(None, "x", 12, t0, "x", 1)], SCHEMA)
    assert {tuple(r) for r in S.advance(empty, root, *args).collect()} == {(12, k, "removed") for k in {r[0] for r in rows[9]}}
    assert S.add_snapshots(spark.createDataFrame([], SCHEMA), root, *args) == []


def test_keys_of_several_chunks(spark, tmp_path, monkeypatch):
    t0 = dt.datetime(2026, 1, 1)
    first = [(f"k{i}", "a", 1, t0, "x", 1) for i in range(20_000)]
    second = [(f"k{i}", "b" if i % 5000 == 0 else "a", 2, t0, "x", 1) for i in range(3, 40_000)]
    args = F.col("platform_id"), F.col("snapshot_no"), F.col("decision"), F.col("loaded_at")
    S.add_snapshots(spark.createDataFrame(first, SCHEMA), str(tmp_path / "s"), *args)
    got_ = S.advance(spark.createDataFrame(second, SCHEMA), str(tmp_path / "s"), *args)
    counts = {r.change_kind: r["count"] for r in got_.groupBy("change_kind").count().collect()}
    assert counts == {"added": 20_000, "removed": 3, "changed": 3}
    assert {r.key for r in got_.filter("change_kind <> 'added'").collect()} == {"k0", "k1", "k2", "k5000", "k10000", "k15000"}


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2026, 1, 1)
    keys = [f"k{i}" for i in range(60)] + ["HOT"] * 40 + [" k1 ", "K1", None, " "]
    decisions = ["Reject", "reject ", "RE JECT", "Accept (Oral)", "accept(oral)", None, "", "\t"]
    rows = []
    for no in (1, 2, 5):
        for _ in range(250):
            at = None if rng.random() < 0.05 else t0 + dt.timedelta(seconds=rng.randrange(10**6))
            rows.append((rng.choice(keys), rng.choice(decisions), no, at, "x", 1))
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    t = dt.datetime(2026, 1, 1)
    assert got(spark, []) == set()
    assert got(spark, [("a", "x", 1, t, None, None)]) == set()
    # a snapshot of keyless rows only is present: everything drops out
    assert got(spark, [("a", "x", 1, t, None, None), (None, "x", 2, t, None, None), ("a", "x", 3, t, None, None)]) == {(2, "a", "removed"), (3, "a", "added")}
    # ties of load time and missing load times
    assert got(spark, [("a", None, 1, t, None, None), ("a", "x", 1, t, None, None), ("a", "y", 2, None, None, None), ("a", "x", 2, t, None, None)]) == set()
    long = "v" * 200_000
    assert got(spark, [("a", long, 1, t, None, None), ("a", long + "w", 2, t, None, None)]) == {(2, "a", "changed")}


def test_ordinals_persist(spark):
    first = assign_ordinals(spark.range(1000).select(F.col("id").cast("string").alias("key")))
    a = {r.key: r.ordinal for r in first.collect()}
    assert sorted(a.values()) == list(range(1000))
    second = assign_ordinals(spark.range(500, 1500).select(F.col("id").cast("string").alias("key")), first)
    b = {r.key: r.ordinal for r in second.collect()}
    assert all(b[k] == a[k] for k in a.keys() & b.keys())
    assert sorted(v for k, v in b.items() if k not in a) == list(range(1000, 1500))


def test_tables_are_deleted_when_asked(spark):
    from figloom import workspace

    kept, gone = (workspace.materialize(spark.range(3), n) for n in ("kept", "gone"))
    workspace.discard(gone, spark.range(1))
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone._figloom_path).count()
    workspace.ship(spark)
    workspace.ship(spark)
