"""The pipeline in one place: every step takes and gives DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.functions import text as X
from figloom.operators import search, sync
from figloom.operators.release import checks
from figloom.sources import notes


@dataclass(frozen=True)
class Venue:
    """How the notes of a venue are read."""

    name: str
    decision: str = "replies"
    with_scores: bool = True
    year_from_bibtex: bool = False
    wrapped_since: int = 0

    def version(self, year: int) -> int:
        return 2 if year >= self.wrapped_since else 1


VENUES = {
    "ICLR": Venue("ICLR", wrapped_since=2024),
    "ICML": Venue("ICML", decision="venue", with_scores=False),
    "NeurIPS": Venue("NeurIPS", wrapped_since=2024),
    "TMLR": Venue("TMLR", decision="venue", with_scores=False, year_from_bibtex=True),
}


def ingest(raw: DataFrame, venue: Venue) -> DataFrame:
    """Paper rows from raw notes (note, year, default_decision, source_order, pos) of all years;
    a paper that comes in several years counts where it came first."""
    old = raw.filter(F.col("year") < venue.wrapped_since)
    new = raw.filter(F.coalesce(F.col("year") >= venue.wrapped_since, F.lit(True)))
    read = lambda df, version: notes.normalized(df, version, venue.name, venue.decision, venue.with_scores, venue.year_from_bibtex)
    if not venue.wrapped_since:
        return read(new, 2)
    return sync.first_rows(read(old, 1).unionByName(read(new, 2)), ["platform_id"], [F.col("year")])


def contexts(documents: DataFrame, figures: DataFrame, key: str, text: Column, strict: bool = True, document: str | None = None) -> DataFrame:
    """(key, figure_number, context): the paragraphs of a paper's text that refer to each of its
    figures, tagged and in order. Figures whose number has more than digits find nothing; with
    ``strict`` off their digits count.

    A paper has one text; where several documents belong to one, ``document`` names their id, and
    the result has a row for each (key, document, figure_number). So no list is longer than a text.
    """
    place = [key] if document is None else [key, document]
    paras = documents.select(*place, F.posexplode(X.paragraphs(text)).alias("pos", "para")).filter(F.col("para").rlike("(?i)fig"))
    found = paras.filter(X.is_context(F.col("para"))).withColumn("number", F.explode(X.mentioned_figures(F.col("para"))))
    number = F.col("figure_number") if strict else X.figure_key(F.col("figure_number"))
    wanted = figures.select(key, "figure_number", number.alias("number")).distinct()
    lists = found.join(wanted, [key, "number"]).groupBy(*place, "figure_number").agg(F.array_sort(F.collect_set(F.struct("pos", "para"))).alias("v"))
    return lists.select(*place, "figure_number", X.tagged(F.col("v.para")).alias("context"))


def retrieve(corpus: DataFrame, key: str, views: dict[str, str], query: dict[str, list[float]], t1: int = 100, t2: int = 10, k: int = 3) -> DataFrame:
    """Ranked rows of the corpus: ``views`` and ``query`` name the vectors of title, abstract, caption."""
    distances = {n: search.distance_to(F.col(views[n]), query[n]).alias(f"_{n}") for n in ("title", "abstract", "caption")}
    near = search.hierarchical(corpus.select("*", *distances.values()), key, ("_title", "_abstract", "_caption"), t1, t2, k)
    return near.withColumnRenamed("_caption", "distance").drop("_title", "_abstract")


def validate(release: DataFrame, expected_rows: int, vectors: dict[str, int]) -> DataFrame:
    """(check_, expected, actual, ok): rows, unique ids and vectors per index of a release."""
    return checks(release, expected_rows, {n: (expected_rows, v) for n, v in vectors.items()}, {})


def download_tasks(papers: DataFrame, base: str, limit: int | None = None) -> DataFrame:
    """(id, year, decision, url) of the papers whose PDF is to be fetched, the first by id."""
    tasks = papers.filter("platform_id IS NOT NULL").select(F.col("platform_id").alias("id"), "year", X.slug_or_pending(F.col("decision")).alias("decision"), X.pdf_url(F.col("platform_id"), base).alias("url"))
    return tasks if limit is None else tasks.orderBy("id").limit(limit)
