"""Schemas of the tables; sources never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = ("abstract", "keywords", "areas", "tldr")


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, k) for n, k in kinds.items()]


S, L = T.StringType(), T.LongType()
PAPERS = T.StructType(
    _fields(platform=S, venue=S, year=L, title=S, **dict.fromkeys(_TEXT, S), scores=T.ArrayType(L), decision=S, authors=S, author_ids=S, cdate=S, url=S, platform_id=S, bibtex=S)
)
FIGURES = T.StructType(_fields(platform=S, platform_id=S, figure_number=S, figure_path=S, figure_caption=S, figure_context=S, figure_type=S, confidence=T.FloatType()))
#: Papers joined with their figures and the labels of the cascade.
RELEASE = T.StructType(
    _fields(id=L)
    + PAPERS.fields
    + _fields(
        figure_path=S, figure_number=S, figure_caption=S, figure_context=S, figure_type=S, confidence=T.FloatType(), clip_type=S, clip_confidence=T.FloatType(), label_cascade=S,
        cascade_verified=T.BooleanType(), cascade_tier=S, cascade_vote_category=S, cascade_path=S, cascade_diagram_votes=T.IntegerType(), cascade_judges_disagree=T.BooleanType(),
        label_haiku=S, label_gpt_mini=S, label_gpt_tiebreak=S, final_decision=S,
    )
)
DOWNLOAD_TASKS = T.StructType(_fields(id=S, year=L, decision=S, url=S))
EXTRACTED_FIGURES = T.ArrayType(T.StructType(_fields(figType=S, name=S, renderURL=S, caption=S)))
