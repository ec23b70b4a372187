import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from figloom.llm import canonical as C
from figloom.llm import decision_aliases as A

NAMES = [
    "Accept (Oral)", "Accept (Poster)", "Accept (Spotlight)", "Accept (Lightning Talk)", "Accept with Minor Revision", "Accept with Major Revision", "Conditional Accept",
    "Accept (Datasets Track)", "Accept (Findings Only)", "Reject", "Reject, Resubmission Encouraged", "Desk Reject", "Withdrawn", "Withdrawn after Decision", "pending/unknown",
    "Invited to Workshop", "Transferred to Journal", "Duplicate Submission", "Ethics Hold", "Retracted", "Under Appeal", "Incomplete Submission",
]
IDS = {n: i for i, n in enumerate(NAMES, 1)}
TYPED = {
    "accept_poster": 2, "Ａｃｃｅｐｔ （Ｐｏｓｔｅｒ）": 2, "Accept &#40;Oral&#41;": 1, "<b>Reject</b>": 10, "Rеjесt": 10, "AcceptWithMinorRevision": 5, "poster only (final: accepted)": 2,
    "Accept (Posetr)": 2, "Acpet (Spotlight)": 3, "not accepted, by all reviewers": 10, "rejected but please submit again": 11, "status = DR (desk), over length": 12,
    "ohne Begutachtung abgelehnt": 12, "zurückgezogen, on request": 13, "late w/d, decision was out": 14, "noch offen": 15, "inv. to wkshp": 16, "transf. to journal": 17,
    "submitted twice": 18, "halted by ethics board": 19, "removed after publication": 20, "appealed": 21, "files missing, incomplete": 22, "acceptance is conditional": 7,
    "Blitzvortrag, angenommen": 4, "angenommen mit großen Änderungen": 6, "accepted to the data sets track": 8, "goes to findings, no presentation": 9, "Withdrawn after Deciison": 14,
    "Visa letter": -1, "Board 18": -1, "Thanks!": -1, "Ask Kalvasken": -1, "See mail of 3 June": -1, "?!": -1,
}


def matcher():
    aliases = [(a, n) for n, forms in A.ALIASES.items() for a in forms] + list(A.accept_aliases())
    return C.Matcher(IDS, aliases)


def reference(spark):
    return spark.createDataFrame([(i, n, "note") for n, i in IDS.items()], "ref_id int, ref_name string, ref_note string")


def test_typed_values():
    m = matcher()
    assert {v: m.match(v) for v in TYPED} == TYPED


@pytest.mark.parametrize("name", NAMES)
def test_one_slip_anywhere_is_mended(name):
    """Brute force over slips: swapping neighbours or doubling a letter of a canonical name."""
    m, wrong = matcher(), []
    for i in range(len(name) - 1):
        if name[i].isalpha() and name[i + 1].isalpha():
            for typed in (name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[: i + 1] + name[i] + name[i + 1 :]):
                if m.match(typed) != IDS[name]:
                    wrong.append(typed)
    assert not wrong


def test_long_values_are_read_whole():
    m = matcher()
    filler = "as was said in room seven before lunch "
    for k in (0, 1, 2, 3, 500):
        for typed, right in (("rejected but please submit agian", 11), ("post-decision withdrawal", 14)):
            assert m.match(filler * k + typed + " " + filler * k) == right
    assert m.match(filler * 500) == -1


@pytest.mark.parametrize(
    "typed",
    [
        "acepted as an orral talk, as the chairs, both raters and one later reader had thought that this is a most solid paper",
        "the chairs both raters and one later reader had thought that this most solid paper was good and so we said that it be acepted as an orral talk as hosts",
        "most later raters had thought both chairs like one solid acepted orral",
    ],
)
def test_many_unknown_words_do_not_hide_a_mention(typed):
    assert matcher().match(typed) == 1


def every_reading(m, words):
    """Brute force: the rank of the best mention in any reading, else the best similarity."""
    best, similar = [], [(0.0, 0, 1)]
    for way in itertools.product(*(m.near(w) for w in words)):
        read, slipped = [w for _, w in way], [n for n, _ in way]
        for i, j in itertools.combinations(range(len(read) + 1), 2):
            if (found := m.patterns.get(" ".join(read[i:j]))) is not None and not (j - i == 1 and slipped[i] > 1 and len(read[i]) < 6):
                best.append(((j - i - 0.4 * sum(slipped[i:j]), sum(map(len, read[i:j])), -sum(slipped)), found))
        for s, i in m.sets.items():
            common = len(s & set(read))
            score = 1.0 if common == len(s) > 1 else 2 * common / (len(s) + len(set(read)))
            similar.append((score - 0.05 * sum(slipped), common, -i))
    if best:
        return {i for r, i in best if r == max(best)[0]}
    return {-max(similar)[2] if max(similar)[0] >= C.LEAST_SIMILARITY else -1}


def test_one_pass_equals_all_readings():
    names = {"Green Apple": 1, "Apple Pie": 2, "Pear": 3, "Great Grain Bread": 4, "Bread with Pear and Apple Jam": 5}
    m, rng = C.Matcher(names, [("grape pie", "Apple Pie")]), random.Random(2)
    words = ["green", "gren", "apple", "aple", "appel", "pie", "pia", "pear", "peaar", "great", "greet", "grain", "gran", "bread", "braed", "jam", "jim", "with", "wiht", "and", "house", "xx"]
    for _ in range(400):
        typed = [rng.choice(words) for _ in range(rng.randint(1, 7))]
        assert m.match(" ".join(typed)) in every_reading(m, typed), typed


def test_longest_mention_wins():
    m = C.Matcher({"New York": 1, "York": 2, "New": 3}, [("big apple", "New York")])
    assert [m.match(x) for x in ("in New York today", "york", "The Big-Apple!", "old york road", "")] == [1, 2, 1, 2, -1]


def test_rows(spark):
    t = dt.datetime(2026, 1, 1)
    schema = "platform_id string, decision string, loaded_at timestamp_ntz, ref_id string, ref_name string"
    rows = [("a", "Reject", t, "x", "y"), ("b", "reject", t, "x", "y"), ("c", None, t, "x", "y"), ("d", " \t", t, None, None), ("e", "rej.", t, None, None), ("e", "w/d", t + dt.timedelta(1), None, None), (None, "rej.", t, None, None)]
    rows += [("f", "so " * 30_000 + "rejected", t, None, None), ("g", "Hall A", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in C.paper_decisions(df, reference(spark)).collect()} == {("b", 10), ("e", 13), ("f", 10), ("g", -1)}
    assert [tuple(r) for r in C.unmatched_decisions(df, reference(spark)).collect()] == [("Hall A", 1)]
    assert C.paper_decisions(df.limit(0), reference(spark)).count() == 0
    none = C.match_values(df, F.col("decision"), reference(spark).limit(0), "ref_name", "ref_id")
    assert {r.ref_id for r in none.collect()} == {None, -1}


def brute_edits(a, b, most):
    """Words within some edits of ``a``, a swap being one edit: whether ``b`` is among them, and how near."""
    letters, seen = set(a) | set(b), {a}
    for k in range(most + 1):
        if b in seen:
            return k
        near = set()
        for w in seen:
            near |= {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
            near |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        seen |= near
    return most + 1


def test_slips_against_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
        b = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
        assert C.slips(a, b, 2) == brute_edits(a, b, 2), (a, b)
    assert C.slips("rejte", "reject", 2) == C.slips("poesr", "poster", 2) == 2


def test_what_is_denied_is_not_meant():
    m = matcher()
    typed = {"not rejected": -1, "NOT desk-rejected": -1, "never withdrawn": -1, "not accepted": 10, "No - reject": 10, "was not rejected but accepted as poster": 2, "withdrawn, not rejected": 13, "not quite": -1}
    assert {v: m.match(v) for v in typed} == typed


def test_aliases_and_notes_are_tables(spark):
    cities = spark.createDataFrame([(1, "New York", "the big apple"), (2, "Rome", None), (3, None, "x"), (None, "Oslo", "y"), (9, "Rome", None)], "ref_id int, ref_name string, ref_note string")
    said = spark.createDataFrame([("NYC", "New York"), ("eternal city", "Rome"), ("eternal city", "Zurich"), (None, "Rome"), ("vanished", "Atlantis")], "alias string, ref_name string")
    df = spark.createDataFrame([("nyc!", 1), ("in the Eternal-City", 2), ("romme", 3), ("vanished", 4), (None, 5)], "v string, ref_id int")
    got = {r.v: r.ref_id for r in C.match_values(df, F.col("v"), cities, "ref_name", "ref_id", said).collect()}
    assert got == {"nyc!": 1, "in the Eternal-City": 2, "romme": 2, "vanished": -1, None: None}
    with pytest.raises(ValueError):
        C.match_values(df, F.col("v"), cities, "ref_name", "ref_id", said, most=1)
    assert {tuple(r) for r in C.paper_decisions(spark.createDataFrame([("p", "note", None)], "platform_id string, decision string, loaded_at timestamp_ntz"), reference(spark)).collect()} != set()
