"""Mixing sources to target weights.

Method: minimum-cost flow for overlapping sources. Texts are aggregated by membership pattern,
the set of wanted sources under which a text is filed. Token capacity flows from the patterns to
the quotas of the sources; using a pattern for the k-th time costs k - 1 a token, so repeats are
spread as thin as they can be. Texts are then chosen by a seeded hash until the routed tokens of
their pattern and source are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from figloom.functions.text import strip_blanks
from figloom.llm.flow import FlowGraph
from figloom.llm.tokens import TOKENIZER, token_count
from figloom.workspace import materialize

#: More sources than this are refused: the patterns of the flow are sets of them.
MAX_SOURCES = 256
MAX_PATTERNS = 5_000
#: Routed (pattern, source) pairs that are sent to every worker at most; more are joined by shuffle.
MAX_SENT = 50_000
#: Slices of the seeded order in which tokens are counted before single texts are looked at.
SLICES = 4096


def source_name(c: Column) -> Column:
    """A source in one spelling: lower case, blanks around it dropped, words joined by "_"."""
    return F.regexp_replace(F.lower(strip_blanks(c)), r"[\s\-_]+", "_")


def route(patterns: dict[tuple[str, ...], int], repeats: dict[str, int], quotas: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens of each (pattern, source): all quotas met as far as the patterns allow, with the
    least sum of repetition costs."""
    g = FlowGraph()
    for pattern, tokens in sorted(patterns.items()):
        for k in range(max(repeats[s] for s in pattern)):
            g.arc("s", ("p", pattern), tokens, k)
        for s in pattern:
            g.arc(("p", pattern), ("q", s), tokens * repeats[s], 0, (pattern, s))
    for s, quota in quotas.items():
        g.arc(("q", s), "t", quota)
    g.run("s", "t", sum(quotas.values()))
    return g.flows()


def mix_sources(documents: DataFrame, key: Column, text: Column, source: Column, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER, most_sources: int = MAX_SOURCES, most_patterns: int = MAX_PATTERNS) -> DataFrame:
    """(key, source, uses, tokens): the texts of the mix, for which source, and how often.

    ``targets``: source, target_share, max_repeats. The mix is meant to have ``total_tokens``; by
    default as many as all different texts of wanted sources together. A source whose texts cannot
    fill its part of that even at their most repeats gives all it has; the others keep their parts,
    and mix_report tells the shares that come of it.

    The same text filed several times is one text, taken under the smallest key; filed under
    several sources it may serve either, and all its uses together are no more than the most
    repeats among them. A quota is met from below up to the text on its border, which is taken if
    that is nearer. Null and blank texts and sources that are not named are not used. No targets,
    or an empty table, give no rows. Targets, one token count per pattern and the slices at the
    borders are all that is collected. More than ``most_sources`` or ``most_patterns`` are refused,
    not cut; a caller with the memory for a larger flow raises them.
    """
    spark = documents.sparkSession
    wanted = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy(source_name(F.col("source")).alias("source"))
    wanted = wanted.agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(most_sources + 1).collect()
    if len(wanted) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    shares, repeats = {r.source: r.share for r in wanted}, {r.source: int(r.repeats) for r in wanted}
    rows = documents.select(key.alias("key"), text.alias("text"), source_name(source).alias("source"))
    rows = rows.filter(F.col("source").isin(sorted(shares)) & F.col("text").rlike(r"\S"))
    rows = rows.select("key", "source", F.md5("text").alias("text_id"), token_count(F.col("text"), tokenizer).alias("tokens"))
    filed = rows.groupBy("text_id", "source").agg(F.min("key").alias("key"), F.max("tokens").alias("tokens"))
    texts = filed.groupBy("text_id").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.min("key").alias("key"), F.max("tokens").alias("tokens"))
    slice_ = F.pmod(F.xxhash64(F.lit(seed), "text_id"), F.lit(SLICES)).cast("int").alias("slice")
    texts = materialize(texts.filter("tokens > 0").select("text_id", F.concat_ws("\t", "pattern").alias("pattern"), "key", "tokens", slice_), "mix-texts")
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    patterns = {tuple(r.pattern.split("\t")): r.tokens for r in sums}
    total = sum(patterns.values()) if total_tokens is None else total_tokens
    quotas = {s: int(share * total) for s, share in shares.items()}
    flows = route(patterns, repeats, quotas)

    # A pattern's seeded order is walked once around and again: source after source takes the
    # stretch of the order that its tokens cover, whole rounds first.
    plans = []
    for pattern, tokens in sorted(patterns.items()):
        at = 0
        for s in pattern:
            if flow := flows.get((pattern, s), 0):
                plans.append(("\t".join(pattern), s, at, at + flow, tokens))
                at += flow
    plan = spark.createDataFrame(plans, "pattern string, source string, start long, stop long, round long")
    # Where each slice of the order begins: at most SLICES rows a pattern, summed before the shuffle,
    # and joined on the keys by which the texts lie for their sums within a slice.
    slices = texts.groupBy("pattern", "slice").agg(F.sum("tokens").alias("n"))
    begins = slices.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("slice")) - F.col("n")).select("pattern", "slice", "before")
    within = Window.partitionBy("pattern", "slice").orderBy("text_id")
    placed = texts.withColumn("inside", F.sum("tokens").over(within) - F.col("tokens")).join(begins.hint("merge"), ["pattern", "slice"])
    placed = placed.select("pattern", "key", "tokens", (F.col("before") + F.col("inside") + F.col("tokens") / 2).alias("middle"))
    # A text is used once for every round in which its middle lies in the stretch.
    passes = lambda x: F.ceil((F.col(x) - F.col("middle")) / F.col("round"))
    uses = (F.greatest(passes("stop"), F.lit(0)) - F.greatest(passes("start"), F.lit(0))).cast("int")
    sent = F.broadcast(plan) if len(plans) <= MAX_SENT else plan
    mixed = placed.join(sent, "pattern").withColumn("uses", uses).filter("uses > 0")
    return mixed.select("key", "source", "uses", "tokens")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each wanted source: target and actual share of the tokens, texts, uses, most repeats."""
    got = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("tokens")).alias("mixed_tokens"))
    named = targets.filter("source IS NOT NULL").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("texts", "uses", "most_uses", "mixed_tokens")]
    joined = named.join(got, "source", "left").select("source", "target_share", "max_repeats", *zero)
    # One row per source.
    total = F.sum("mixed_tokens").over(Window.partitionBy())
    return joined.withColumn("actual_share", F.round(F.coalesce(F.col("mixed_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)), 6))


def document_mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    mixed = mix_sources(documents, F.col("doc_id"), F.col("text"), F.col("source"), targets, tokenizer=tokenizer)
    return mixed.withColumnRenamed("key", "doc_id")


def document_mix_shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return mix_report(document_mix(documents, targets, tokenizer), targets)


def repeats_kept(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """For each wanted source whether no document is used too often, and documents that are in the
    mix more than once."""
    mixed = materialize(document_mix(documents, targets, tokenizer), "mixed")
    once = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"))
    twice = once.groupBy("source").agg(F.count_if(F.col("n") > 1).alias("twice"))
    report = mix_report(mixed, targets).join(twice, "source", "left")
    return report.select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("kept"), F.coalesce("twice", F.lit(0)).cast("long").alias("twice"))
