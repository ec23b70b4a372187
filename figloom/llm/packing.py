"""Filling containers of fixed capacity with documents.

Method: best-two-fit. A container is filled greedily, the largest fitting document first; then
its smallest document is replaced by two unpacked ones that fill the gap so widened more tightly.
Documents are dealt by a seeded hash to shards of bounded size and each shard is packed on its
own, so the work is linear in the documents; what sharding costs is at most the last, partly
filled container of each shard, one in several thousand.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.llm.tokens import TOKENIZER, token_count
from figloom.workspace import materialize

#: Documents of a shard on average.
SHARD_ROWS = 20_000
#: Capacities packed for at once by default; each costs one more packing of all sizes.
MAX_REQUESTS = 1000
#: Equal rows are dealt to shards in lots of so many; lots of lots bound the lists made of them.
LOT, LOTS = 64, 100_000


class _Pool:
    """Unpacked items by size; finds the largest size up to a bound in a few machine words."""

    def __init__(self, sizes: np.ndarray):
        self.count = Counter(int(s) for s in sizes)
        self.mask = 0
        for s in self.count:
            self.mask |= 1 << s

    def largest(self, bound: int) -> int:
        """The largest unpacked size up to ``bound``, or 0."""
        return (self.mask & ((2 << bound) - 1)).bit_length() - 1 if bound > 0 and self.mask & ((2 << bound) - 1) else 0

    def least(self) -> int:
        """The smallest unpacked size, or 0."""
        return (self.mask & -self.mask).bit_length() - 1 if self.mask else 0

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.mask ^= 1 << size

    def give(self, size: int) -> None:
        if not self.count[size]:
            self.mask |= 1 << size
        self.count[size] += 1


def best_two(pool: _Pool, gap: int, beyond: int) -> tuple[int, int] | None:
    """Two unpacked sizes whose sum is the largest up to ``gap`` and more than ``beyond``."""
    best, found = beyond, None
    # Larger ones leave no room for a second.
    a = pool.largest(gap - pool.least())
    while 2 * a > best and a > 0:  # the second is no larger than the first
        b = pool.largest(min(a, gap - a))
        if b == a and pool.count[a] < 2:
            b = pool.largest(min(a - 1, gap - a))
        if b and a + b > best:
            best, found = a + b, (a, b)
            if best == gap:
                break
        a = pool.largest(a - 1)
    return found


def pack_sizes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of sizes; every size from 1 to ``capacity`` is in exactly one."""
    pool, out = _Pool(sizes), []
    while pool.mask:
        box, gap = [], capacity
        while size := pool.largest(gap):
            pool.take(size)
            box.append(size)
            gap -= size
        if gap and pool.mask:
            least = box[-1]  # greedy takes sizes in falling order
            if pair := best_two(pool, gap + least, least):
                box.pop()
                for size in pair:
                    pool.take(size)
                    box.append(size)
                pool.give(least)
        out.append(box)
    return out


def _pack_shard(capacities: list[int]):
    """Packs the rows of one shard for one request; equal rows are one with a number of copies."""

    def run(shard: pa.Table) -> pa.Table:
        # The order of the rows, and with it the containers, depends on keys and sizes only.
        order = np.lexsort((shard["lot"].to_numpy(), shard["mark"].to_numpy()))
        copies = shard["copies"].to_numpy()[order]
        item = np.repeat(order, copies)
        tokens = shard["tokens"].to_numpy()[item]
        request, no = shard["request"][0].as_py(), shard["shard"][0].as_py()
        capacity = capacities[request]
        # Full pieces need no packing; only rests do.
        full = np.maximum(tokens - 1, 0) // capacity
        rest = tokens - full * capacity
        by_size: dict[int, list[int]] = {}
        for i in range(len(rest) - 1, -1, -1):
            by_size.setdefault(int(rest[i]), []).append(i)
        boxes = [[by_size[s].pop() for s in box] for box in pack_sizes(rest[rest > 0], capacity)]
        if empty := by_size.get(0):  # texts without tokens fit anywhere
            boxes = boxes or [[]]
            boxes[0] += empty
        at = np.array([i for b in boxes for i in b], dtype=np.int64)
        box = np.repeat(np.arange(len(boxes)), [len(b) for b in boxes])
        whole = np.repeat(np.arange(len(full)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        where = np.r_[at, whole]
        pieces = np.r_[full[at], piece]
        first = pieces * capacity
        name = pa.array([f"s{no}-{b}" for b in box] + [f"f{no}-{i}" for i in range(len(whole))], pa.string())
        keys = shard["key"].take(pa.array(item[where]))
        return pa.table(
            [
                pa.array(np.full(len(where), request), pa.int32()), name, keys, pa.array(pieces, pa.int32()), pa.array(first, pa.int64()),
                pa.array(np.minimum(tokens[where] - first, capacity), pa.int64()),
            ],
            ["request", "container_id", "key", "piece", "first_token", "tokens"],
        )

    return run


def pack_documents(documents: DataFrame, key: Column, text: Column, requests: DataFrame, request_id: str, capacity: str, tokenizer: str = TOKENIZER, seed: int = 42, most_requests: int = MAX_REQUESTS) -> DataFrame:
    """(request_id, container_id, key, piece, first_token, tokens): what lies in which container.

    Every row of ``documents`` is placed once for each request; a text longer than the capacity is
    cut into pieces numbered from 0 that fill containers of their own and a rest that is packed
    with the others. Null, empty and tokenless texts have 0 tokens and lie in some container.
    Equal rows are packed one by one; null keys too. Requests without a positive capacity give no
    rows. container_id is unique within a request. The result is the same however the rows lie:
    rows are dealt and ordered by a hash of the seed, their key and their tokens, and rows equal in
    these are interchangeable.

    Sizes are computed once and written; one grouping packs them for all requests. Requests are
    collected; more than ``most_requests`` are refused, so that a caller who has more raises it or
    packs them in several calls, whose results are independent.
    """
    spark = documents.sparkSession
    wanted = requests.select(request_id, F.col(capacity).cast("long").alias("c")).filter("c > 0").orderBy(request_id, "c").limit(most_requests + 1).collect()
    if len(wanted) > most_requests:
        raise ValueError(f"more than {most_requests} requests")
    sized = documents.select(key.alias("key"), token_count(text, tokenizer).alias("tokens")).groupBy("key", "tokens").agg(F.count("*").alias("n"))
    sized = materialize(sized, "text-sizes")
    shards = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // SHARD_ROWS))
    request_type, key_type = requests.schema[request_id].dataType, sized.schema["key"].dataType
    schema = f"request int, container_id string, key {key_type.simpleString()}, piece int, first_token long, tokens long"
    if not wanted:
        none = spark.createDataFrame([], schema).drop("request")
        return none.select(F.lit(None).cast(request_type).alias(request_id), "*")
    # Lots of equal rows, in two steps so that no list of lots is long.
    many = LOT * LOTS
    heaps = sized.withColumn("heap", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / many))))
    heaps = heaps.withColumn("n", F.least(F.lit(many).cast("long"), F.col("n") - F.col("heap") * many))
    lots = heaps.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    lots = lots.select("key", "tokens", (F.col("heap") * LOTS + F.col("part")).alias("lot"), F.least(F.lit(LOT).cast("long"), F.col("n") - F.col("part") * LOT).alias("copies"))
    lots = lots.withColumn("mark", F.xxhash64(F.lit(seed), F.col("key").cast("string"), "tokens"))
    lots = lots.withColumn("shard", F.pmod(F.xxhash64("mark", "lot"), F.lit(shards)))
    asked = lots.withColumn("request", F.explode(F.array(*map(F.lit, range(len(wanted))))))
    packed = asked.groupBy("request", "shard").applyInArrow(_pack_shard([r["c"] for r in wanted]), schema)
    ids = F.array(*[F.lit(r[0]).cast(request_type) for r in wanted])
    return packed.select(F.get(ids, F.col("request")).alias(request_id), *packed.columns[1:])


def document_containers(documents: DataFrame, requests: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    out = pack_documents(documents, F.col("doc_id"), F.col("text"), requests, "request_id", "capacity_tokens", tokenizer)
    return out.withColumnRenamed("key", "doc_id")


def container_fill(documents: DataFrame, requests: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers, tokens and the share of capacity used, for each request."""
    placed = document_containers(documents, requests, tokenizer)
    boxes = placed.groupBy("request_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    total = boxes.groupBy("request_id").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    used = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used_share")
    return total.join(F.broadcast(requests.select("request_id", "capacity_tokens")), "request_id").select("request_id", "capacity_tokens", "containers", "pieces", "tokens", "fullest", used)


def containers_kept(documents: DataFrame, requests: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """What must hold for each request: documents placed, containers above capacity, and documents
    that are missing, twice there or cut where they need not be."""
    # Written, as it is grouped in two ways.
    placed = materialize(document_containers(documents, requests, tokenizer), "placed")
    placed = placed.join(requests.withColumnRenamed("request_id", "_request"), F.col("request_id").eqNullSafe(F.col("_request")))
    room = F.col("capacity_tokens")
    boxes = placed.groupBy("request_id", "container_id", room).agg(F.sum("tokens").alias("t")).groupBy("request_id").agg(F.count_if(F.col("t") > room).alias("overfull"))
    # The pieces of a document follow one another, all but the last full.
    pieces = placed.groupBy("request_id", "doc_id", room).agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.sum("tokens").alias("t"), F.max("first_token").alias("first"))
    right = (F.col("n") == F.col("last") + 1) & (F.col("first") == F.col("last") * room) & (F.col("t") - F.col("first") <= room) & ((F.col("t") > F.col("first")) | (F.col("n") == 1))
    documents_ = pieces.groupBy("request_id").agg(F.count("*").alias("documents"), F.count_if(~right).alias("misplaced"))
    return documents_.join(boxes, "request_id").select("request_id", "documents", "overfull", "misplaced")
