import datetime as dt
import random
from collections import Counter

import pytest

from figloom.llm import subset as S

T0 = dt.datetime(2026, 1, 1)
DATA = "id long, platform_id string, figure_number string, figure_caption string, clip_type string, cascade_path string, venue string, rank string, request_id string"
PAPERS = "platform_id string, venue string, year long, loaded_at timestamp_ntz, id long"


def requests(spark, *sizes):
    return spark.createDataFrame(list(enumerate(sizes, 1)), "request_id int, subset_size int")


def chosen(spark, rows, papers, *sizes):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DATA)
    out = S.figure_subset(df, spark.createDataFrame([(*p, T0, 1) for p in papers], PAPERS), requests(spark, *sizes)).collect()
    by = {k + 1: [r for r in out if r.request_id == k + 1] for k in range(len(sizes))}
    return by


def skewed(rng, n=900):
    papers = [(f"p{k}", rng.choice(["ICLR"] * 8 + ["icml", "ICML ", "TMLR"]), rng.choice([2020] * 5 + [2021, 2022])) for k in range(120)]
    rows = []
    for i in range(n):
        if i % 3 == 0:  # a third of all rows: one figure exported again and again
            rows.append((i, "p0", "1", rng.choice(["Figure 1: same", "figure 1: SAME.", "Figure 1: same (continued)"]), "diagram", "t1"))
        else:
            rows.append((i, rng.choice(papers)[0], str(i), f"c{i}", rng.choice(["diagram"] * 20 + ["Plot", " plot", "photo", None, ""]), rng.choice(["t1"] * 9 + ["T2", "t3"])))
    return rows, papers


def test_sizes_balance_and_copies(spark):
    rows, papers = skewed(random.Random(1))
    by = chosen(spark, rows, papers, 12, 100, 5000, 0)
    assert [len(by[k]) for k in (1, 2, 3, 4)] == [12, 100, 900, 0]
    for k in (1, 2, 3):
        assert len({r.id for r in by[k]}) == len(by[k])
    assert set(Counter(r.clip_type for r in by[1])) == {"diagram", "plot", "photo", "(none)"}
    venues = Counter(r.venue for r in by[2])
    assert max(venues.values()) <= 2 * min(venues.values())
    for k in (1, 2):  # the copied figure is there once per combination at most
        assert max(Counter((r.clip_type, r.cascade_path) for r in by[k] if r.id % 3 == 0).values(), default=0) <= 1


def test_the_choice_does_not_depend_on_the_layout(spark):
    rng = random.Random(6)
    rows, papers = skewed(rng)
    rows += [(5000, "p1", "9", "same", "photo", "t3")] * 40  # equal rows
    found = []
    for parts in (1, 7):
        rng.shuffle(rows)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1 if parts > 1 else 10_000_000)
        by = chosen(spark, rows, papers, 12, 150, 930)
        found.append(sorted(map(str, (r for k in by for r in by[k]))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] and len(found[0]) == 12 + 150 + 930


def test_limits_are_parameters(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, str(i % 3)) for i in range(9)], "id long, kind string")
    args = df, F.col("id"), dict.fromkeys(S.KEYS, F.col("kind")), F.xxhash64("id"), F.col("kind"), requests(spark, 4), "request_id", "subset_size"
    for limit in ({"most_combinations": 2}, {"most_requests": 0}):
        with pytest.raises(ValueError):
            S.varied_subset(*args, **limit)
    assert S.varied_subset(*args, most_combinations=3, most_requests=1).count() == 4


def test_quotas_against_brute_force():
    """Every pair of alternative choices: no swap of one record between combinations costs less."""
    rng = random.Random(4)
    counts = [((f"g{i % 2}", f"l{i % 4}", f"v{j % 2}", f"y{j}"), rng.randrange(1, 30), 40) for i in range(4) for j in range(3)]
    for size in (5, 20, 60):
        quota = S.solve_quotas(counts, size)
        assert sum(quota.values()) == size and all(q <= 40 for q in quota.values())
        left = Counter()
        for c, q in quota.items():
            left[c[0]] += q
        assert abs(left["g0"] - left["g1"]) <= size // 2


def test_edges(spark):
    assert chosen(spark, [], [], 5)[1] == []
    same = [(1, "p", None, None, None, None)] * 4 + [(None, None, None, None, "", " ")]
    by = chosen(spark, same, [("p", None, None)], 3, 9)
    assert len(by[1]) == 3 and len(by[2]) == 5
    assert {r.year for r in by[2]} == {"(none)"}
    long = [(1, "p", "1", "x" * 300_000, "a", "b"), (2, "q", "1", "", "a", "b")]
    assert len(chosen(spark, long, [], 1)[1]) == 1
