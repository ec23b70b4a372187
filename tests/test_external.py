import pytest
from pyspark.sql import functions as F

from figloom.operators import external as E


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert E.retried(flaky, 5, lambda n: n, waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(ZeroDivisionError):
        E.retried(lambda: 1 / 0, 2, lambda n: 0, waits.append)


def test_encoder_and_generator(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(40)], "id int, t string")

    def make():
        def encoder(texts):
            if any(len(t) == 7 for t in texts):
                raise ValueError
            assert len(texts) <= 16
            return [[len(t), 1] for t in texts]

        return encoder

    got = {r.id: r.v for r in df.select("id", E.encode(F.col("t"), make).alias("v")).collect()}
    assert got[3] is None and got[7] is None and got[8] == [8.0, 1.0] and len(got) == 40

    def maker():
        def ask(p):
            if p == "":
                raise OSError("no")
            return p.upper()

        return ask

    said = {r.id: r.a for r in df.select("id", E.generate(F.col("t"), maker, 2, wait=lambda s: None).alias("a")).collect()}
    assert said[0].error == "OSError: no" and said[3] is None and said[2].answer == "XX"


def test_fetch(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "b").write_bytes(b"old")
    tasks = spark.createDataFrame([("a", "u/a"), ("b", "u/b"), ("c", "bad")], "id string, url string")

    def get(url):
        if url == "bad":
            raise OSError
        return url.encode()

    def exists(k, folder=folder):
        import os

        return os.path.exists(f"{folder}/{k}")

    def save(k, data, folder=folder):
        with open(f"{folder}/{k}", "wb") as f:
            f.write(data)

    done = E.fetch(tasks, "id", "url", get, exists, save, wait=lambda s: None)
    assert {r.id: r.status for r in done.collect()} == {"a": "downloaded", "b": "skipped", "c": "failed"}
    assert (tmp_path / "a").read_bytes() == b"u/a"
    assert E.merge_usage(spark.createDataFrame([("a", 1), ("b", 2)], "key string, amount long"), spark.createDataFrame([("b", 3)], "key string, amount long")).filter("key = 'b'").first().amount == 5
