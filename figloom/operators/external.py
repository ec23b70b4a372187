"""Outside services and models as injected functions: encoders, generators, fetchers.

Each runs in the workers on Arrow batches; nothing of it is needed to plan a query.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pause(n: int) -> float:
    """Seconds to wait after the n-th failure: twice as many each time up to a minute, and a little more."""
    most = min(60.0, 2.0 ** (n - 1))
    return most + random.uniform(0, most / 10)


def retried(call: Callable, tries: int, delay: Callable[[int], float] = pause, wait: Callable[[float], None] = time.sleep):
    """``call()`` until it raises nothing, at most ``tries`` times; then the last error."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if n == tries:
                raise
            wait(delay(n))


def encode(content: Column, make: Callable[[], Callable[[list], Sequence]], batch: int = 16) -> Column:
    """A vector per value by an encoder made once per worker; null for null values and for
    batches in which even single values fail."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make()
        for column in batches:
            values, out = column.to_pylist(), [None] * len(column)
            there = [i for i, v in enumerate(values) if v is not None]
            for start in range(0, len(there), batch):
                part = there[start : start + batch]
                try:
                    vectors = encoder([values[i] for i in part])
                except Exception:
                    vectors = []
                    for i in part:
                        try:
                            vectors.append(encoder([values[i]])[0])
                        except Exception:
                            vectors.append(None)
                for i, v in zip(part, vectors):
                    out[i] = None if v is None else [float(x) for x in v]
            yield pa.array(out, pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<float>")(content)


_SAID = "answer string, error string, tries int, input_tokens long, output_tokens long"
_SAID_ARROW = pa.struct([("answer", pa.string()), ("error", pa.string()), ("tries", pa.int32()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64())])


def generate(prompt: Column, make: Callable[[], Callable], tries: int = 10, wait: Callable[[float], None] = time.sleep, throttled: Callable[[Exception], bool] = lambda e: True) -> Column:
    """struct(answer, error, tries, input_tokens, output_tokens): what a generator says to each
    prompt, a text or a list of parts. Null prompts are not asked.

    The generator gives a text, or a text with the tokens that went in and out. An error that is
    ``throttled`` is tried again, ``tries`` times at most; a prompt that fails for good has the last
    error and no answer.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = make()
        for column in batches:
            out = []
            for p in column.to_pylist():
                if p is None:
                    out.append(None)
                    continue
                for n in range(1, tries + 1):
                    try:
                        said = ask(p)
                        text, into, out_of = said if isinstance(said, tuple) else (said, None, None)
                        out.append({"answer": text, "error": None, "tries": n, "input_tokens": into, "output_tokens": out_of})
                        break
                    except Exception as e:
                        if n == tries or not throttled(e):
                            out.append({"answer": None, "error": f"{type(e).__name__}: {e}", "tries": n})
                            break
                        wait(pause(n))
            yield pa.array(out, _SAID_ARROW)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _SAID)(prompt)


def structured(answer: Column, ddl: str) -> Column:
    """A JSON answer as a struct of the given fields; null where it is none. Text around the
    outermost braces, as generators add it, is ignored."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), ddl, {"mode": "PERMISSIVE"})


def call_counts(said: DataFrame, column: str) -> DataFrame:
    """Calls, failed ones, further tries and tokens of a column made by ``generate``."""
    a = F.col(column)
    return said.filter(a.isNotNull()).agg(
        F.count("*").alias("calls"), F.count_if(a["error"].isNotNull()).alias("failed"), F.coalesce(F.sum(a["tries"] - 1), F.lit(0)).alias("retries"),
        F.coalesce(F.sum(a["input_tokens"]), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(a["output_tokens"]), F.lit(0)).alias("output_tokens"),
    )


_DRAWN = pa.struct([("image", pa.binary()), ("tokens", pa.int64()), ("pixels", pa.int64()), ("error", pa.string())])


def draw(prompt: Column, make: Callable[[], Callable]) -> Column:
    """struct(image, tokens, pixels, error): what a painter, made once per worker, makes of each
    prompt. One that fails has no image and counts no tokens; null prompts are not asked."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        paint = make()
        for column in batches:
            out = []
            for p in column.to_pylist():
                try:
                    out.append(None if p is None else dict(zip(("image", "tokens", "pixels"), paint(p))))
                except Exception as e:
                    out.append({"image": None, "tokens": 0, "pixels": 0, "error": f"{type(e).__name__}: {e}"})
            yield pa.array(out, _DRAWN)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "image binary, tokens long, pixels long, error string")(prompt)


def drawing_cost(tokens: Column, pixels: Column, per_million_tokens: float, per_image: float, image_pixels: int = 1 << 20) -> Column:
    """What a drawing costs: its tokens by the million and its pixels by the standard image."""
    return tokens / F.lit(1e6) * F.lit(per_million_tokens) + pixels / F.lit(float(image_pixels)) * F.lit(per_image)


def usage_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model, input_tokens, output_tokens) plus cost by ``prices`` (model, input, output
    for a thousand tokens each). A model without a price fails the plan, as its cost is unknown."""
    known = prices.select("model", F.col("input").alias("_in"), F.col("output").alias("_out"))
    joined = usage.join(known, "model", "left")
    tokens = lambda c: F.coalesce(c, F.lit(0))
    cost = (tokens(F.col("input_tokens")) * F.col("_in") + tokens(F.col("output_tokens")) * F.col("_out")) / 1000
    priced = F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("no price for the model "), F.coalesce("model", F.lit("null"))))).otherwise(cost)
    return joined.withColumn("cost", priced.cast("double")).drop("_in", "_out")


def fetch(tasks: DataFrame, key: str, url: str, get: Callable[[str], bytes], exists: Callable[[str], bool], save: Callable[[str, bytes], None], workers: int = 4, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``tasks`` plus status: skipped where the target exists, downloaded, or failed.

    ``workers`` tasks fetch at a time. A pause grows by three seconds a try. A task that is run
    again after an executor was lost skips what it has already saved.
    """
    columns = tasks.columns
    schema = T.StructType([*tasks.schema.fields, T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status = []
            for k, u in zip(batch[key].to_pylist(), batch[url].to_pylist()):
                try:
                    if exists(k):
                        status.append("skipped")
                        continue
                    save(k, retried(lambda u=u: get(u), tries, lambda n: 3.0 * n, wait))
                    status.append("downloaded")
                except Exception:
                    status.append("failed")
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(status, pa.string())], [*columns, "status"])

    return tasks.repartition(workers).mapInArrow(run, schema)


def fetch_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("status").agg(F.count("*").alias("tasks"))


def merge_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two ledgers (key, amount) added up key by key."""
    return old.unionByName(new).groupBy("key").agg(F.sum("amount").alias("amount"))
