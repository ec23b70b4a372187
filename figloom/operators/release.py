"""Building and checking a release: papers joined with their figures and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom import schemas
from figloom.operators.sync import dense_ordinals, latest_rows

KEYS = ["platform_id", "figure_number"]
_PAPER = [f.name for f in schemas.PAPERS.fields]
_FIGURE = ["figure_path", "figure_number", "figure_caption", "figure_context", "figure_type", "confidence"]
_LABELS = [f.name for f in schemas.RELEASE.fields if f.name not in {"id", *_PAPER, *_FIGURE}]


def build_release(papers: DataFrame, figures: DataFrame, labels: DataFrame, order: str = "loaded_at", keep: Column | None = None) -> DataFrame:
    """Rows of schemas.RELEASE: every figure of a known paper with its labels, numbered from 0 in
    order of platform_id and figure_number.

    Of papers and figures delivered several times the last in ``order`` counts; of several rows of
    labels for one figure the greatest. Figures without labels have null labels; ``keep`` selects
    among the joined rows. Null keys match nothing. Papers without figures and figures of unknown
    papers give no row. A paper with very many figures is one row against many, which AQE splits.
    """
    known = latest_rows(papers.filter("platform_id IS NOT NULL").select(*_PAPER, order), ["platform_id"], [F.col(order)]).drop(order)
    drawn = latest_rows(figures.filter("platform_id IS NOT NULL AND figure_number IS NOT NULL").select("platform_id", *_FIGURE, order), KEYS, [F.col(order)]).drop(order)
    judged = labels.groupBy(*KEYS).agg(F.max(F.struct(*_LABELS)).alias("l")).select(*KEYS, "l.*")
    rows = known.join(drawn, "platform_id").join(judged, KEYS, "left")
    rows = rows if keep is None else rows.filter(keep)
    numbered = dense_ordinals(rows, [F.col(k) for k in KEYS])
    return numbered.select(*[F.col(f.name).cast(f.dataType) for f in schemas.RELEASE.fields])


def checks(release: DataFrame, expected_rows: int, vectors: dict[str, tuple[int, int]], files: dict[str, bool]) -> DataFrame:
    """(check_, expected, actual, ok): rows and different ids of a release, vectors counted in each
    index against those expected, and files that must be there."""
    counts = release.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids")).first()
    rows = [("rows", expected_rows, counts["rows"]), ("ids", expected_rows, counts["ids"])]
    rows += [(f"vectors of {n}", want, got) for n, (want, got) in vectors.items()] + [(f"file {n}", 1, int(there)) for n, there in files.items()]
    return release.sparkSession.createDataFrame([(n, e, a, e == a) for n, e, a in rows], "check_ string, expected long, actual long, ok boolean")


def check_release(release: DataFrame, expected_rows: int, indices: dict[str, str], files: dict[str, str]) -> DataFrame:
    """``checks`` with vectors counted from the headers of index files (name to path; a missing one
    has -1) and files looked up (name to path)."""
    from figloom.sources.files import exists, index_headers

    spark = release.sparkSession
    counted = {n: index_headers(spark, p).first()["vectors"] if exists(spark, p) else -1 for n, p in indices.items()}
    return checks(release, expected_rows, {n: (expected_rows, v) for n, v in counted.items()}, {n: exists(spark, p) for n, p in files.items()})
