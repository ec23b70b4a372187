"""Choosing a varied subset of given size.

Method: records are counted by category combination; a minimum-cost flow sends the wanted number
through the categories of the left side (figure type, then its path through the cascade) to the
combinations and on through those of the right side (venue and year, then venue). Every category
has a balanced target, and going beyond it costs more the further it goes, so large categories
do not crowd out small ones and small ones are not emptied without need. The quotas are then
filled by a deterministic rank that takes copies of a record only when nothing else is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from figloom.functions.text import squeeze_blanks
from figloom.llm.flow import FlowGraph
from figloom.workspace import materialize

#: Combinations and requests that the driver solves for by default; more are refused rather than
#: cut, and a caller with the memory for them raises the numbers.
MAX_COMBINATIONS, MAX_REQUESTS = 50_000, 1000
#: A copy of a record already counted costs more than any overuse of a category.
COPY_COST = 10_000
KEYS = ["left_group", "left", "right_group", "right"]


def category(c: Column) -> Column:
    """A category in one spelling; null and blank are one category of their own."""
    return F.coalesce(F.nullif(F.lower(squeeze_blanks(c.cast("string"))), F.lit("")), F.lit("(none)"))


def solve_quotas(counts: list[tuple[tuple, int, int]], size: int) -> dict[tuple, int]:
    """How many records to take of each combination (left_group, left, right_group, right).

    ``counts``: combination, its different records, all its records. The quotas add up to ``size``
    or to all records if there are fewer.
    """
    g = FlowGraph()
    total: dict[tuple, int] = {}
    for (lg, lf, rg, rt), _, n in counts:
        for node in (("lg", lg), ("l", lg, lf), ("r", rg, rt), ("rg", rg)):
            total[node] = total.get(node, 0) + n
    kinds = {k: sum(node[0] == k for node in total) for k in ("lg", "l", "r", "rg")}
    share = {k: size / max(1, n) for k, n in kinds.items()}
    for node, n in total.items():
        tail, head = {"lg": ("s", node), "l": (("lg", node[1]), node), "r": (node, ("rg", node[1])), "rg": (node, "t")}[node[0]]
        # Twice the weight for the coarse categories: they decide first.
        g.convex_arc(tail, head, n, share[node[0]], 2 if node[0] in ("lg", "rg") else 1)
    for combination, different, n in counts:
        lg, lf, rg, rt = combination
        g.convex_arc(("l", lg, lf), ("r", rg, rt), different, size / len(counts), 1, combination)
        g.arc(("l", lg, lf), ("r", rg, rt), n - different, COPY_COST, combination)
    g.run("s", "t", size)
    return g.flows()


def varied_subset(df: DataFrame, key: Column, categories: dict[str, Column], alike: Column, spread: Column, requests: DataFrame, request_id: str, size: str, seed: int = 42, most_combinations: int = MAX_COMBINATIONS, most_requests: int = MAX_REQUESTS) -> DataFrame:
    """(request_id, key, left_group, left, right_group, right): the records chosen for each request.

    ``categories`` names the four category columns of KEYS, ``alike`` the records that are copies
    of one another, ``spread`` what records of one combination should be spread over (a paper).
    Each request gets exactly its size, or all records if the table has fewer; sizes that are null
    or not positive get none. Null and repeated keys are ordinary rows. The two request columns
    are the only rows collected, beside one count per combination. Records are ranked by a hash of
    the seed and all their columns, so the choice does not depend on how the rows lie; only rows
    equal in all of these are told apart by their place, and they are interchangeable.

    Ranks are cut at the largest size before any shuffle, so a combination with a third of all
    rows sends on no more than that from each task.
    """
    spark = df.sparkSession
    wanted = [(r[0], r[1]) for r in requests.select(request_id, size).filter(F.col(size) > 0).limit(most_requests + 1).collect()]
    if len(wanted) > most_requests:
        raise ValueError(f"more than {most_requests} requests")
    rows = df.select(key.alias("key"), *[category(categories[k]).alias(k) for k in KEYS], alike.alias("alike"), F.coalesce(spread.cast("string"), F.lit("")).alias("spread"))
    # Equal rows stay different rows: the number of each one is fixed by writing the table.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "subset-rows")
    rows = rows.withColumn("rank", F.xxhash64(F.lit(seed), F.col("key").cast("string"), "alike", "spread", *KEYS))
    first = rows.groupBy(*KEYS, "alike").agg(F.min(F.struct("rank", "key", "row", "spread")).alias("f"), F.count("*").alias("n"))
    first = materialize(first.select(*KEYS, "f.*", "n"), "subset-different")
    counted = first.groupBy(*KEYS).agg(F.count("*").alias("different"), F.sum("n").alias("n")).limit(most_combinations + 1).collect()
    if len(counted) > most_combinations:
        raise ValueError(f"more than {most_combinations} category combinations")
    counts = sorted((tuple(r[k] for k in KEYS), r["different"], r["n"]) for r in counted)
    schema = ", ".join([f"request_id {dict(requests.dtypes)[request_id]}", *[f"{k} string" for k in KEYS], "quota long"])
    solved = {n: solve_quotas(counts, n) for n in {n for _, n in wanted}}
    quotas = [(i, *c, q) for i, n in wanted for c, q in solved[n].items()]
    most = max((n for _, n in wanted), default=0)
    quota_df = spark.createDataFrame(quotas, schema)
    needed = quota_df.groupBy(*KEYS).agg(F.max("quota").alias("most"))

    # Papers take turns: first one record of each, then a second one, and so on.
    turn = Window.partitionBy(*KEYS, "spread").orderBy("rank", "key", "row")
    place = Window.partitionBy(*KEYS).orderBy("copy", "turn", "rank", "key", "row")
    ranked = first.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= most).withColumn("copy", F.lit(0))
    ranked = ranked.select(*KEYS, "key", "row", "rank", "turn", "copy")
    different = {c: d for c, d, _ in counts}
    if any(q > different[tuple(c)] for _, *c, q in quotas):
        copies = rows.join(first.select("row"), "row", "left_anti").select(*KEYS, "key", "row", "rank", F.lit(1).alias("turn"), F.lit(1).alias("copy"))
        ranked = ranked.unionByName(copies)
    placed = ranked.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)
    # Quotas: one row per request and combination, sent to every worker only where they are few.
    small = F.broadcast if len(quotas) <= MAX_COMBINATIONS else lambda df: df
    chosen = placed.join(small(needed), KEYS).filter("place <= most").join(small(quota_df), KEYS).filter("place <= quota")
    return chosen.select("request_id", "key", *KEYS)


def figure_subset(data: DataFrame, papers: DataFrame, requests: DataFrame) -> DataFrame:
    """Records of diagram_data for each request, varied over clip_type, cascade_path, venue, year.

    Venue and year come from papers, the latest loaded row of each platform_id. Records of one
    figure whose captions differ only in case, blanks, marks or a "(continued)" are copies.
    """
    place = papers.filter("platform_id IS NOT NULL").groupBy("platform_id").agg(F.max(F.struct("loaded_at", "venue", "year")).alias("p")).select("platform_id", F.col("p.venue").alias("p_venue"), F.col("p.year").alias("p_year"))
    figures = data.select("id", "platform_id", "figure_number", "figure_caption", "clip_type", "cascade_path")
    joined = figures.join(place, "platform_id", "left")
    caption = F.regexp_replace(F.lower(F.coalesce("figure_caption", F.lit(""))), r"\((?:continued|cont\.?)\)|\bpart \d+\b|[^\p{L}\p{N}]", "")
    figure = F.when(F.coalesce("figure_number", F.lit("")) != "", F.lower("figure_number"))
    alike = F.xxhash64("platform_id", F.coalesce(figure, caption))
    year = F.concat_ws(" ", category(F.col("p_venue")), F.coalesce(F.col("p_year").cast("string"), F.lit("(none)")))
    categories = {"left_group": F.col("clip_type"), "left": F.col("cascade_path"), "right_group": F.col("p_venue"), "right": year}
    out = varied_subset(joined, F.col("id"), categories, alike, F.col("platform_id"), requests, "request_id", "subset_size")
    return out.select(
        "request_id", F.col("key").alias("id"), F.col("left_group").alias("clip_type"), F.col("left").alias("cascade_path"), F.col("right_group").alias("venue"),
        F.substring_index("right", " ", -1).alias("year"),
    )


def subset_coverage(data: DataFrame, papers: DataFrame, requests: DataFrame) -> DataFrame:
    """How often each category combination was chosen for each request."""
    return figure_subset(data, papers, requests).groupBy("request_id", "clip_type", "cascade_path", "venue", "year").agg(F.count("*").alias("chosen"))


def subset_sizes(data: DataFrame, papers: DataFrame, requests: DataFrame) -> DataFrame:
    """Records and different records chosen for each request."""
    return figure_subset(data, papers, requests).groupBy("request_id").agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"))
