"""Raw notes of a paper platform, in its flat (v1) and wrapped (v2) form, as paper rows.

A note is kept as text; every field is taken from it by path, so that an absent key can be told
from a null one, as the flat form needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from figloom.functions.text import join_list, or_empty

PENDING = "pending/unknown"
#: The content keys of a note, first the usual one.
KEYS = {"tldr": ("TL;DR", "TLDR", "one-sentence_summary"), "areas": ("primary_area", "Please_choose_the_closest_area_that_your_submission_falls_into")}


def _has(note: Column, path: list[str]) -> Column:
    keys = F.json_object_keys(note if len(path) == 1 else F.get_json_object(note, _path(path[:-1])))
    return F.coalesce(F.array_contains(keys, path[-1]), F.lit(False))


def _path(keys: list[str]) -> str:
    return "$" + "".join(f"['{k}']" for k in keys)


def content(note: Column, version: int, key: str) -> Column:
    return F.get_json_object(note, _path(["content", key] + (["value"] if version == 2 else [])))


def _first_of(note: Column, version: int, keys: tuple[str, ...]) -> Column:
    """The value of the first key present (v1), of the first key with a value (v2)."""
    if version == 2:
        return F.coalesce(*[F.nullif(content(note, 2, k), F.lit("")) for k in keys])
    out = content(note, 1, keys[-1])
    for k in reversed(keys[:-1]):
        out = F.when(_has(note, ["content", k]), content(note, 1, k)).otherwise(out)
    return out


def _replies(note: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(note, "$.details.directReplies"), "array<string>"), F.array().cast("array<string>"))


def reply_decision(note: Column, version: int, default: Column | None = None) -> Column:
    """The decision said in the replies to a note; pending where none says one."""
    first = lambda keep: F.get(F.filter(_replies(note), keep), F.lit(0))
    if version == 2:
        value = lambda r, k: F.get_json_object(r, f"$.content.{k}.value")
        said = lambda r, k: F.get_json_object(r, f"$.content.{k}")
        reply = first(lambda r: (value(r, "title") == "Paper Decision") & (said(r, "decision").isNotNull() | said(r, "recommendation").isNotNull()))
        return F.coalesce(value(reply, "decision"), value(reply, "recommendation"), F.lit(PENDING))
    reply = first(lambda r: F.lower(F.get_json_object(r, "$.invitation")).rlike("decision|meta_review|acceptance"))
    found = F.coalesce(F.get_json_object(reply, "$.content.decision"), F.get_json_object(reply, "$.content.recommendation"), F.lit(PENDING))
    found = F.when(_has(note, ["content", "withdrawal"]), "withdrawn").otherwise(found)
    return found if default is None else F.coalesce(default, found)


def reply_scores(note: Column, version: int) -> Column:
    """The whole numbers that ratings begin with, in the order of the replies; others are dropped."""
    tail = ".value" if version == 2 else ""
    rating = lambda r: F.coalesce(F.nullif(F.get_json_object(r, f"$.content.rating{tail}"), F.lit("")), F.get_json_object(r, f"$.content.recommendation{tail}"))
    number = lambda r: F.trim(F.get(F.split(rating(r), ":"), F.lit(0))).try_cast("long")
    given = F.filter(_replies(note), lambda r: F.nullif(F.nullif(rating(r), F.lit("")), F.lit("0")).isNotNull())
    return F.filter(F.transform(given, number), lambda x: x.isNotNull())


def normalized(notes: DataFrame, version: int, venue: str, decision: str = "replies", with_scores: bool = True, year_from_bibtex: bool = False) -> DataFrame:
    """Paper rows from (note, year, default_decision, source_order, pos).

    ``decision``: from "replies", or from the "venue" string of a note, which then must be there;
    with ``year_from_bibtex`` a note without a year in its bibtex is dropped as well. A note that
    comes several times counts once, where it came first by source and position.
    """
    n = F.col("note")
    listed = lambda k: join_list(F.from_json(content(n, version, k), "array<string>"))
    text = lambda k: or_empty(content(n, version, k))
    bibtex = content(n, version, "_bibtex")
    year = F.nullif(F.regexp_extract(bibtex, r"year=\{?(\d{4})\}?", 1), F.lit("")).try_cast("long") if year_from_bibtex else F.col("year").cast("long")
    said = content(n, version, "venue") if decision == "venue" else reply_decision(n, version, F.col("default_decision"))
    pid = F.get_json_object(n, "$.id")
    rows = notes.select(
        F.lit("OpenReview").alias("platform"), F.lit(venue).alias("venue"), year.alias("year"), text("title").alias("title"), text("abstract").alias("abstract"), listed("keywords").alias("keywords"),
        or_empty(_first_of(n, version, KEYS["areas"])).alias("areas"), or_empty(_first_of(n, version, KEYS["tldr"])).alias("tldr"),
        (reply_scores(n, version) if with_scores else F.array().cast("array<long>")).alias("scores"), said.alias("decision"),
        listed("authors").alias("authors"), listed("authorids").alias("author_ids"),
        F.date_format(F.timestamp_millis(F.get_json_object(n, "$.tcdate").try_cast("long")), "yyyyMMdd").alias("cdate"),
        F.concat(F.lit("https://openreview.net/forum?id="), pid).alias("url"), pid.alias("platform_id"), bibtex.alias("bibtex"),
        F.coalesce("source_order", F.lit(0)).alias("_source"), F.coalesce("pos", F.lit(0)).alias("_pos"),
    )
    from figloom.operators.sync import first_rows

    whole = rows.filter("platform_id IS NOT NULL AND year IS NOT NULL AND decision IS NOT NULL")
    return first_rows(whole, ["platform_id"], [F.col("_source"), F.col("_pos")]).drop("_source", "_pos")


def invitations(spark: SparkSession, years: list[int], suffixes: list[str], template: str, probe: Callable[[str], bool]) -> DataFrame:
    """(year, invitation): which of the possible invitations exist, by an injected probe.

    A few dozen names; a probe that fails counts as not found."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    if probe(r["invitation"]):
                        rows.append(r)
                except Exception:
                    continue
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    names = [(y, template.format(year=y, suffix=s)) for y in years for s in suffixes]
    return spark.createDataFrame(names, "year long, invitation string").repartition(8).mapInArrow(run, "year long, invitation string")


def note_by_id(notes: DataFrame, note_id: str) -> DataFrame:
    """The notes with an id."""
    return notes.filter(F.get_json_object("note", "$.id") == note_id)


#: What the kinds of invitations are called, and the decision that some imply.
_OPEN, _BLIND = ("Submission", None), ("Blind_Submission", None)
_WITHDRAWN, _DESK = ("Withdrawn_Submission", "withdrawn"), ("Desk_Rejected_Submission", "desk reject")
#: Which invitations a venue has in which years.
SOURCES = {
    "ICLR": {2017: [("submission", None)], **{y: [_WITHDRAWN, _DESK, _BLIND if y < 2024 else _OPEN] for y in range(2018, 2027)}},
    "ICML": {2023: [_OPEN], 2024: [_WITHDRAWN, _OPEN], 2025: [_DESK, _OPEN]},
    "NeurIPS": {2021: [_BLIND], 2022: [_BLIND], 2024: [_WITHDRAWN, _DESK, _OPEN], 2025: [_WITHDRAWN, _DESK, _OPEN]},
}


def source_map(spark: SparkSession, venue: str) -> DataFrame:
    """(year, source_order, invitation, default_decision) of a venue; year is null where notes of
    all years lie under one invitation."""
    if venue not in SOURCES:
        rows = [(None, 0, f"{venue}/-/Submission", None)]
    else:
        group = lambda year: "conference" if venue == "ICLR" and year == 2017 else "Conference"
        listed = [(year, f"{venue}.cc/{year}/{group(year)}/-/{kind}", said) for year, kinds in sorted(SOURCES[venue].items()) for kind, said in kinds]
        rows = [(year, n, invitation, said) for n, (year, invitation, said) in enumerate(listed)]
    return spark.createDataFrame(rows, "year long, source_order int, invitation string, default_decision string")


def with_sources(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """``notes`` (invitation, pos, note) with what ``normalized`` needs to know of their source."""
    return notes.join(F.broadcast(sources), "invitation").select("note", "year", "default_decision", "source_order", "pos")


class NoteSource(DataSource):
    """``spark.read.format("notes")``: notes of invitations, one partition each.

    Options: invitations (comma-separated), limit, and fetch, the "module:function" that gives
    the notes of (invitation, limit) as JSON texts. A failing fetch is called again up to tries
    (10) times, pause (60) seconds apart; then the scan fails.
    """

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "invitation string, pos long, note string"

    def reader(self, schema) -> DataSourceReader:
        return _NoteReader(self.options)


class _NoteReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(i.strip()) for i in self.options["invitations"].split(",") if i.strip()]

    def read(self, partition):
        import importlib

        module, function = self.options["fetch"].split(":")
        fetch = getattr(importlib.import_module(module), function)
        limit = int(self.options.get("limit", 0)) or None
        from figloom.operators.external import retried

        seconds = float(self.options.get("pause", 60))
        # Listed inside the try, as a fetch may fail half-way; the notes of an invitation fit a task.
        found = retried(lambda: list(fetch(partition.value, limit)), int(self.options.get("tries", 10)), lambda n: seconds)
        for pos, note in enumerate(found):
            if limit and pos >= limit:
                break
            yield partition.value, pos, note
