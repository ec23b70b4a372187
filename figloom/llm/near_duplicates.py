"""Near-duplicate records with small edits.

Two records match if their bags of words have at least four fifths of the longer one in common.
Method: a bag is hashed once into K bins (one-permutation hashing); empty bins borrow from
others by optimal densification; R bins make a band, equal bands a bucket. In a bucket only its
least and its greatest member are linked with the others (stars), so candidates grow with the
rows and not with the pairs. Candidates are checked exactly on whole bags.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.workspace import discard, materialize

#: A bucket is hot if it holds more than one in so many bags.
HOT_BUCKETS = 1000
#: Four fifths, as integers so that the comparison is exact.
SHARE = (4, 5)
#: Bins of a band, and the probability that a pair with just SHARE in common is in one bucket.
ROWS, RECALL = 6, 0.999
#: Bags with SHARE in common have a Jaccard similarity of 4 / (2 * 5 - 4) at least, two thirds; so many
#: bands it takes. Two unrelated abstracts (about 0.1) meet in a band once in a million.
BANDS = math.ceil(math.log(1 - RECALL) / math.log(1 - (SHARE[0] / (2 * SHARE[1] - SHARE[0])) ** ROWS))
WORD = re.compile(r"[^\W_]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words; forgets all when it grows beyond a million."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def bags_of(texts: list[str], words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, ends): for each text the sorted hashes of (word, how often it came before)."""
    found = [WORD.findall(t.lower()) for t in texts]
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = np.fromiter((words[w] for ws in found for w in ws), dtype=np.uint64, count=int(lengths.sum()))
    doc = np.repeat(np.arange(len(texts)), lengths)
    flat = flat[np.lexsort((flat, doc))]
    at = np.arange(len(flat))
    starts = np.ones(len(flat), dtype=bool)
    starts[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    before = at - np.maximum.accumulate(np.where(starts, at, 0))
    tokens = _mix(flat + before.astype(np.uint64) * _GOLD)
    return tokens[np.lexsort((tokens, doc))], np.cumsum(lengths)


def one_permutation(tokens: np.ndarray, ends: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` values per bag; all _EMPTY for an empty bag."""
    lengths = np.diff(np.r_[0, ends])
    doc = np.repeat(np.arange(len(ends)), lengths)
    mixed = _mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    cell = doc * bins + ((mixed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    value = mixed & np.uint64(0xFFFFFFFF)
    order = np.lexsort((value, cell))
    cells, first = np.unique(cell[order], return_index=True)
    sketch = np.full(len(ends) * bins, _EMPTY)
    sketch[cells] = value[order][first]
    sketch = sketch.reshape(len(ends), bins)
    # Optimal densification: an empty bin asks other bins, chosen by hashing (bin, attempt),
    # until one holds a value of its own.
    own = sketch != _EMPTY
    rows, cols = np.nonzero(~own & own.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        asked = (_mix(cols.astype(np.uint64) * _GOLD + np.uint64(attempt)) >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
        asked = asked.astype(np.int64)
        hit = own[rows, asked]
        sketch[rows[hit], cols[hit]] = sketch[rows[hit], asked[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return sketch


def bands_of(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The bucket numbers of each row, one per band, as signed 64-bit."""
    groups = sketch.reshape(len(sketch), -1, rows)
    out = np.broadcast_to(_mix(np.arange(groups.shape[1], dtype=np.uint64) + np.uint64(1)), groups.shape[:2]).copy()
    for j in range(rows):
        out = _mix(out ^ (groups[:, :, j] + _GOLD))
    return out.view(np.int64)


_SKETCHED = "id string, bag_id binary, n int, bag array<long>, bands array<long>"
_SKETCHED_ARROW = pa.schema([("id", pa.string()), ("bag_id", pa.binary()), ("n", pa.int32()), ("bag", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            texts = batch["text"].to_pylist()
            tokens, ends = bags_of(texts, words)
            bands = bands_of(one_permutation(tokens, ends, ROWS * BANDS))
            tokens = tokens.view(np.int64)
            bags = np.split(tokens, ends[:-1])
            keys = [hashlib.blake2b(b.tobytes(), digest_size=16).digest() for b in bags]
            offsets = pa.array(np.r_[0, ends], pa.int32())
            bag_column = pa.ListArray.from_arrays(offsets, pa.array(tokens))
            band_column = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            n = np.diff(np.r_[0, ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(keys, pa.binary()), pa.array(n), bag_column, band_column], schema=_SKETCHED_ARROW)


def sketch_records(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(id, bag_id, n, bag, bands) of every row with a key and a word; equal bags share bag_id."""
    rows = df.select(key.cast("string").alias("id"), text.alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_sketch, _SKETCHED).filter("n > 0")


def distinct_bags(sketched: DataFrame) -> DataFrame:
    """One row per different bag, numbered and written; copies, however many, meet only here,
    before the shuffle. The numbers hold as long as the table does."""
    bags = sketched.groupBy("bag_id").agg(F.first("n").alias("n"), F.first("bag").alias("bag"), F.first("bands").alias("bands"))
    return materialize(bags.withColumn("bag_no", F.monotonically_increasing_id()), "bags")


def star_candidates(bags: DataFrame) -> DataFrame:
    """(a, b) with a < b: in each bucket of two or more, its least and greatest member with all."""
    placed = bags.select("bag_no", F.explode("bands").alias("band"))
    buckets = placed.groupBy("band").agg(F.min("bag_no").alias("lo"), F.max("bag_no").alias("hi"), F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(buckets, "buckets")
    # A bucket with more than a thousandth of all bags is hot; each band has fewer than a thousand.
    many = bags.count()
    hot = F.broadcast(buckets.filter(F.col("size") * HOT_BUCKETS > many).filter("size > 2"))
    rest = buckets.filter((F.col("size") * HOT_BUCKETS <= many) & (F.col("size") > 2))
    members = placed.join(hot, "band").unionByName(placed.join(rest, "band"))
    large = members.select("bag_no", F.explode(F.array("lo", "hi")).alias("centre")).filter("bag_no <> centre")
    stars = large.select(F.least("bag_no", "centre").alias("a"), F.greatest("bag_no", "centre").alias("b"))
    pairs = buckets.filter("size = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(stars).distinct()
    candidates = materialize(pairs, "star-candidates")
    discard(buckets)
    return candidates


def confirm(candidates: DataFrame, bags: DataFrame) -> DataFrame:
    """The candidates (a, b) whose bags share enough: exact, on whole bags."""
    num, den = SHARE
    a = bags.select(F.col("bag_no").alias("a"), F.col("n").alias("n_a"), F.col("bag").alias("bag_a"))
    b = bags.select(F.col("bag_no").alias("b"), F.col("n").alias("n_b"), F.col("bag").alias("bag_b"))
    near = candidates.join(a, "a").join(b, "b").filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    return near.filter(F.size(F.array_intersect("bag_a", "bag_b")) * den >= F.greatest("n_a", "n_b") * num).select("a", "b")


def linked_bags(bags: DataFrame) -> DataFrame:
    """Confirmed star links between the numbers of different bags, written to the shared folder."""
    candidates = star_candidates(bags)
    links = materialize(confirm(candidates, bags), "links")
    discard(candidates)
    return links


def all_links(links: DataFrame, bags: DataFrame) -> DataFrame:
    """All pairs that links imply: two bags with a common neighbour are checked, newly confirmed
    pairs lead to further ones, until none is added. Work follows the size of this result."""
    known, fresh = links, links
    while True:
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        new = fresh.unionByName(fresh.select(F.col("b").alias("a"), F.col("a").alias("b")))
        via = new.select(F.col("a").alias("c"), F.col("b").alias("x")).join(both.select(F.col("a").alias("c"), F.col("b").alias("y")), "c").filter("x <> y")
        pairs = via.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
        fresh = materialize(confirm(pairs, bags), "further-links")
        if fresh.isEmpty():
            return known
        before, known = known, materialize(known.unionByName(fresh), "links")
        discard(before)


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with the least node it is connected with.

    Alternating large and small stars on written tables: few rounds, no group in one task.
    """
    edges = materialize(links.filter("a <> b").select("a", "b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        large = materialize(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), "v", "u")
        small = small.select("a", F.col("v").alias("b")).unionByName(small.select("a", F.col("u").alias("b"))).filter("a <> b").distinct()
        small = materialize(small, "small-star")
        if small.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(small, ["a", "b"], "left_anti").isEmpty():
            nodes = small.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
        discard(edges, large)
        edges = small


def near_duplicate_classes(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(id, class_id, n_links): one row per record with words; class_id is the least id of its class.

    Copies (equal bags) are one class whatever their number; n_links counts the different bags
    found to be linked with this one by their stars. Null keys, null texts and texts without words give no row; equal keys
    should be resolved before. An empty table gives an empty result.
    """
    sketched = materialize(sketch_records(df, key, text), "sketches")
    bags = distinct_bags(sketched)
    links = linked_bags(bags)
    roots = components(links).withColumnRenamed("node", "bag_no")
    degree = links.select(F.explode(F.array("a", "b")).alias("bag_no")).groupBy("bag_no").agg(F.count("*").alias("n_links"))
    known = bags.select("bag_id", "bag_no").join(roots, "bag_no", "left").join(degree, "bag_no", "left")
    copies = sketched.groupBy("bag_id").agg(F.min("id").alias("least"))
    named = known.join(copies, "bag_id").withColumn("root", F.coalesce("root", "bag_no"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(classes, "root").select("bag_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return sketched.select("id", "bag_id").join(named, "bag_id").select("id", "class_id", "n_links")


def near_duplicate_pairs(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(a, b) with a < b: every pair of ids whose bags match, copies included.

    The number of rows is that of the matching pairs; see near_duplicate_classes for a result
    that grows with the rows only. Null keys, null texts and texts without words match nothing.
    """
    sketched = materialize(sketch_records(df, key, text), "sketches")
    bags = distinct_bags(sketched)
    links = all_links(linked_bags(bags), bags)
    # Only bags that are linked or filed several times have pairs.
    copied = sketched.groupBy("bag_id").agg(F.count("*").alias("copies")).filter("copies > 1")
    linked = links.select(F.explode(F.array("a", "b")).alias("bag_no")).distinct()
    numbers = bags.select("bag_id", "bag_no").join(linked.withColumn("linked", F.lit(True)), "bag_no", "left").join(copied, "bag_id", "left").filter("linked OR copies > 1")
    ids = materialize(sketched.select("id", "bag_id").join(numbers.select("bag_id", "bag_no"), "bag_id").select("id", F.col("bag_no").alias("bag")), "paired-ids")
    left, right = ids.select(F.col("id").alias("x"), F.col("bag").alias("a")), ids.select(F.col("id").alias("y"), F.col("bag").alias("b"))
    same = ids.groupBy("bag").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("bag").alias("a"), F.col("bag").alias("b"))
    pairs = links.unionByName(same).join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _valid_papers(papers: DataFrame) -> DataFrame:
    """One row per platform_id, the latest loaded, with title and abstract as one text; null
    where the abstract is null or blank."""
    row = papers.filter("platform_id IS NOT NULL").groupBy("platform_id").agg(F.max(F.struct("loaded_at", "title", "abstract")).alias("r"))
    text = F.when(F.col("r.abstract").rlike(r"\S"), F.concat_ws(" ", "r.title", "r.abstract"))
    return row.select("platform_id", text.alias("text"))


def similar_papers(papers: DataFrame) -> DataFrame:
    pairs = near_duplicate_pairs(_valid_papers(papers), F.col("platform_id"), F.col("text"))
    return pairs.select(F.col("a").alias("platform_id_a"), F.col("b").alias("platform_id_b"))


def paper_classes(papers: DataFrame) -> DataFrame:
    out = near_duplicate_classes(_valid_papers(papers), F.col("platform_id"), F.col("text"))
    return out.select(F.col("id").alias("platform_id"), "class_id", "n_links")
