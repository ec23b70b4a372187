"""Other ways of saying the decisions about papers: data for the queries, not part of the matcher.

The matcher takes aliases as a table; this one is listed and multiplied out by rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Ways of saying that a paper is accepted, and the forms in which it then appears.
ACCEPT_WORDS = ["accept", "accepted", "acceptance", "accepting", "acc", "accepte", "angenommen", "paper accepted", "yes accepted", "final accepted", "decided accept", "p accept"]
ACCEPT_LINKS = ["", "as", "as a", "as an", "for", "for a", "for an", "to", "to the", "in", "in the", "with", "w", "on", "after", "is", "mit", "subject to", "only"]
ACCEPTED_AS = {
    "Accept (Oral)": ["oral", "orals", "oral talk", "long talk", "long talk oral", "full talk", "oral presentation", "vortrag", "presentation orale"],
    "Accept (Poster)": ["poster", "posters", "poster only", "poster session", "poster board", "affiche"],
    "Accept (Spotlight)": ["spotlight", "spotlights", "spotl", "spotlight slot"],
    "Accept (Lightning Talk)": ["lightning", "lightning talk", "lightning round", "lightn talk", "lightning slot", "two minute talk"],
    "Accept with Minor Revision": ["minor", "minor revision", "minor revisions", "minor rev", "minor edits", "minor changes", "small changes", "small changes needed", "kleinen anderungen"],
    "Accept with Major Revision": ["major", "major revision", "major revisions", "major rev", "major edits", "major changes", "large changes", "large changes needed", "grossen anderungen"],
    "Conditional Accept": ["conditional", "conditionally", "cond", "condition", "conditions", "bedingt"],
    "Accept (Datasets Track)": ["datasets track", "dataset track", "datasets", "dataset", "data sets", "data sets track", "d track", "d track dataset"],
    "Accept (Findings Only)": ["findings", "findings only"],
}
#: Other ways of saying the entries.
ALIASES = {
    "Accept (Poster)": ["in as poster", "poster"],
    "Accept (Oral)": ["oral"],
    "Accept (Spotlight)": ["spotlight", "selected for spotlight"],
    "Accept (Lightning Talk)": ["blitzvortrag", "blitzvortrag angenommen", "lightning talk"],
    "Accept (Findings Only)": ["goes to findings", "goes to findings no presentation"],
    "Reject": ["rej", "rejected", "rejection", "not accepted", "not accept", "no reject", "declined", "decline", "turned down", "abgelehnt", "refuse"],
    "Reject, Resubmission Encouraged": [
        "reject resubmit", "reject and resubmit", "r r reject resubmit", "rejected but please submit again", "declined resubmission welcome", "rej resub encouraged",
        "rejected resubmission encouraged", "rejected please resubmit",
    ],
    "Desk Reject": [
        "desk rejected", "desk rejection", "desk rej", "desk", "dr desk", "dr", "rejected at desk", "rejected without review", "rejected at the desk", "ohne begutachtung abgelehnt",
        "reject without review",
    ],
    "Withdrawn": ["withdrawal", "withdrew", "withdraw", "w d", "authors withdrew", "pulled by authors", "pulled authors", "retire par les auteurs", "zuruckgezogen", "withdrawn by authors"],
    "Withdrawn after Decision": ["w d after decision", "withdrew after the decision", "authors withdrew after the decision", "post decision withdrawal", "late w d decision was out", "late w d", "withdrawal after decision"],
    "pending/unknown": ["pending", "unknown", "undecided", "not decided", "not decided yet", "awaiting decision", "decision pending", "noch offen"],
    "Invited to Workshop": ["workshop invitation", "workshop invite", "inv to wkshp", "moved to workshop", "moved to workshop invited", "einladung zum workshop", "workshop"],
    "Transferred to Journal": ["journal transfer", "transf to journal", "sent on to journal", "handed to the journal", "handed over to the journal", "transfer to journal", "to journal", "journal"],
    "Duplicate Submission": ["submitted twice", "double submission", "dup submission", "duplicate of another submission", "duplicate"],
    "Ethics Hold": ["held for ethics check", "on hold ethics", "halted by ethics board", "hold ethics", "ethics check", "ethics"],
    "Retracted": ["retraction", "retracted by venue", "venue has retracted it", "removed after publication"],
    "Under Appeal": ["appealed", "appeal running", "authors appealed", "appeal"],
    "Incomplete Submission": ["submission incomplete", "files missing", "files missing incomplete", "incompl subm", "not complete submission", "incomplete", "not complete"],
}


def accept_aliases() -> Iterator[tuple[str, str]]:
    """Every way of saying "accepted" with every form, in both orders."""
    for name, forms in ACCEPTED_AS.items():
        for form in forms:
            for word in ACCEPT_WORDS:
                for link in ACCEPT_LINKS:
                    yield f"{word} {link} {form}".replace("  ", " "), name
                    yield f"{form} {word} {link}".strip(), name


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, ref_name) of all of them."""
    rows = sorted({(a, n) for n, forms in ALIASES.items() for a in forms} | set(accept_aliases()))
    return spark.createDataFrame(pa.table({"alias": [a for a, _ in rows], "ref_name": [n for _, n in rows]}))
