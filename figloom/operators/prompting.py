"""Prompts from retrieved figures: ordered parts of text and pictures, and the run from query to answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.functions.text import data_url, or_empty
from figloom.operators import external, search

#: A part: kind "text" or "image", and the text or the picture as a data URL.
PART = "struct<kind: string, text: string>"


def part(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def references(found: DataFrame) -> DataFrame:
    """(query, parts): the pictures of each query's results and their captions, in order of place.

    ``found``: query, place (from 1), picture (bytes; null where it cannot be read), caption. A
    reference without a picture is left out, the others keep their numbers. A query has as many
    results as were asked for.
    """
    one = F.array(
        part("text", F.concat(F.lit("\n--- Reference "), F.col("place").cast("string"), F.lit(" ---"))),
        part("image", data_url(F.col("picture"))),
        part("text", F.concat(F.lit("<reference_caption>"), or_empty(F.col("caption")), F.lit("</reference_caption>"))),
    )
    seen = found.filter("picture IS NOT NULL").select("query", F.struct(F.col("place").alias("place"), one.alias("parts")).alias("r"))
    return seen.groupBy("query").agg(F.array_sort(F.collect_list("r")).alias("rs")).select("query", F.flatten(F.transform("rs", lambda r: r["parts"])).alias("parts"))


def description_prompts(queries: DataFrame, found: DataFrame, opening: str, closing: str) -> DataFrame:
    """(query, parts): what a writer is asked about each query (query, title, abstract, caption): an
    opening, the references, then the query itself and a closing. Queries without results ask nothing."""
    asked = [F.concat(F.lit(f"<{c}>"), or_empty(F.col(c)), F.lit(f"</{c}>")) for c in ("title", "abstract", "caption")]
    last = F.concat_ws("\n", *asked, F.lit(closing))
    with_results = found.select("query").distinct()
    joined = queries.join(with_results, "query").join(references(found), "query", "left")
    shown = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    return joined.select("query", F.concat(F.array(part("text", F.lit(opening))), shown, F.array(part("text", last))).alias("parts"))


def drawing_prompts(described: DataFrame, found: DataFrame) -> DataFrame:
    """(query, parts): what a painter is asked: the description, then the pictures by number."""
    pictures = references(found).select("query", F.filter("parts", lambda p: ~p["text"].startswith("<reference_caption>")).alias("parts"))
    heading = F.array(part("text", F.lit("\n## Reference Diagrams\n")))
    joined = described.join(pictures, "query", "left")
    shown = F.when(F.col("parts").isNotNull(), F.concat(heading, "parts")).otherwise(F.array().cast(f"array<{PART}>"))
    return joined.select("query", F.concat(F.array(part("text", F.col("description"))), shown).alias("parts"))


def run(queries: DataFrame, corpus: DataFrame, key: str, vector: str, views: tuple[slice, slice, slice], pictures: DataFrame, make_writer: Callable, opening: str, closing: str, k: int = 3, **retrieval) -> DataFrame:
    """(query, description, error, parts): from queries to the prompts for a painter.

    ``queries``: query (the id of the query's row), title, abstract, caption and the ``vector``;
    ``corpus``: key and vector; ``pictures``: key, picture, caption. Searched in three stages;
    ``make_writer`` makes, once per worker, what answers a list of parts. Queries that find nothing
    give no row; one whose writer fails has the error and no parts.
    """
    asked = queries.select(F.col("query").alias(key), vector)
    near = search.hierarchical_for_each(corpus, key, vector, asked, views, k=k, **retrieval)
    found = near.select("query", "place", "key").join(pictures.withColumnRenamed(key, "key"), "key")
    prompts = description_prompts(queries.select("query", "title", "abstract", "caption"), found, opening, closing)
    answered = prompts.select("query", external.generate(F.col("parts"), make_writer).alias("a"))
    described = answered.select("query", F.col("a.answer").alias("description"), F.col("a.error").alias("error"))
    drawn = drawing_prompts(described.filter("description IS NOT NULL"), found)
    return described.join(drawn, "query", "left")
