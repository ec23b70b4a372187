"""Several values packed in one text field, split into one value per row.

Method: minimum description length. A dialect says which characters separate values and
which quotation marks protect them. Every field is parsed in every dialect; the cost of a
parse is the code length of its dialect, its marks and its values, where the code of a value
is as long as its share among the values of all fields makes it. Those shares are counted
once over the whole table, from the parses that are cheapest when every value is spelled out.
Each field is then parsed in the dialect that is cheapest with these shares.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.workspace import materialize

#: The separators that occur in typed lists, with the pattern that finds each.
#: A slash or bar pair counts as one mark; a single slash separates only between blanks.
SEPARATORS = {
    ",": r"[,，]",
    ";": r"[;；]",
    "|": r"\|\|?",
    "/": r"//|(?<=\s)/(?=\s)",
    "•": r"[•·]",
    "、": r"、",
    "\t": r"\t",
    "\n": r"(?:\r\n|\n|\r)+",
}
#: Quotation marks, opening to closing.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "'": "'"}
#: Brackets that may wrap a whole field.
WRAPS = {"[": "]", "{": "}"}
#: A heading in front of the list.
HEADING = re.compile(r"^\s*(?:author\s+)?(?:key\s*-?\s*words?(?:\s+and\s+phrases)?|index\s+terms?|subject\s+terms?|topics|tags)\s*(?:[:：]|[-–—](?=\s)|—)", re.I)
ESCAPE = "\\"

#: A dialect: the separators in force and whether quotation marks protect.
Dialect = tuple[frozenset, bool]
NONE: Dialect = (frozenset(), True)
#: Bits for naming a dialect: one of the plain ones, or a set of separators.
PLAIN_BITS, MIXED_BITS, UNQUOTED_BITS = 3.0, 6.0, 8.0
#: A value is hot if it makes more than one in so many uses.
HOT_VALUES = 1000
LETTER_BITS, MARK_BITS, VALUE_BITS, OPEN_BITS = 4.5, 8.0, 3.0, 12.0


def unwrap(field: str) -> str:
    """Without the heading in front and the brackets around the whole field."""
    field = HEADING.sub("", field, count=1).strip()
    for _ in range(3):
        if len(field) < 2 or field[0] not in WRAPS or field[-1] != WRAPS[field[0]]:
            break
        depth, closed = 0, False
        for i, ch in enumerate(field):
            depth += (ch == field[0]) - (ch == WRAPS[field[0]])
            if depth == 0 and i < len(field) - 1:
                closed = True
                break
        if closed:
            break
        field = HEADING.sub("", field[1:-1], count=1).strip()
    return field


@lru_cache(maxsize=4096)
def _finder(marks: frozenset) -> re.Pattern:
    return re.compile("|".join(SEPARATORS[m] for m in SEPARATORS if m in marks) or r"(?!)")


def parse(field: str, dialect: Dialect) -> tuple[list[str], int]:
    """The values of a field without heading and wrapping, and how many marks were left open.

    Quotation marks protect from where a value begins to the closing mark that ends it; round
    brackets protect while they balance; an escaped character stands for itself. Runs in time
    linear in the field.
    """
    marks, quoting = dialect
    find = _finder(marks)
    values, here, i, n, open_marks, depth = [], [], 0, len(field), 0, 0
    started = False  # something other than blanks seen in this value
    paired = _paired_brackets(field) if "(" in field else ()
    hopeless: set[str] = set()  # marks of which no closing one is left

    def done():
        nonlocal here, started
        if v := "".join(here).strip():
            values.append(v)
        here, started = [], False

    while i < n:
        ch = field[i]
        if ch == ESCAPE and i + 1 < n and not field[i + 1].isalnum() and not field[i + 1].isspace():
            here.append(field[i + 1])
            started, i = True, i + 2
            continue
        if depth == 0 and (m := find.match(field, i)):
            done()
            i = m.end()
            continue
        if quoting and not started and ch in QUOTES:
            if ch not in hopeless and (end := _closing(field, i, QUOTES[ch], find)) is not None:
                here = [_content(field[i + 1 : end], QUOTES[ch])]
                started, i = True, end + 1
                continue
            hopeless.add(ch)
            open_marks += 1
        if i in paired:
            depth += 1 if ch == "(" else -1
        here.append(ch)
        started = started or not ch.isspace()
        i += 1
    done()
    return values, open_marks


def _paired_brackets(field: str) -> set[int]:
    """Where round brackets open and close in pairs; a lone one protects nothing."""
    stack, out, skip = [], set(), False
    for i, ch in enumerate(field):
        if skip:
            skip = False
        elif ch == ESCAPE:
            skip = True
        elif ch == "(":
            stack.append(i)
        elif ch == ")" and stack:
            out |= {stack.pop(), i}
    return out


def _closing(field: str, start: int, close: str, find: re.Pattern) -> int | None:
    """Where the quotation opened at ``start`` ends: at a mark followed by a separator or the end."""
    i, n = start + 1, len(field)
    while (i := field.find(close, i)) >= 0:
        if field[i - 1] == ESCAPE:
            i += 1
            continue
        if close == '"' and field[i + 1 : i + 2] == close:
            i += 2
            continue
        j = i + 1
        while j < n and field[j].isspace() and not find.match(field, j):
            j += 1
        if j == n or find.match(field, j):
            return i
        i += 1
    return None


def _content(quoted: str, close: str) -> str:
    if close == '"':
        quoted = quoted.replace('""', '"')
    return re.sub(r"\\([^\w\s])", r"\1", quoted)


def dialects_for(field: str) -> list[Dialect]:
    """The dialects whose separators occur in the field: none, each one, and every set of several,
    larger ones first; each with and, where there are quotation marks, without protecting them."""
    present = [m for m in SEPARATORS if re.search(SEPARATORS[m], field)]
    ways = (True, False) if any(c in field for c in QUOTES) else (True,)
    out = [NONE] + [(frozenset([m]), q) for m in present for q in ways]
    for left_out in range(len(present) - 1):
        out += [(frozenset(present) - set(few), q) for few in itertools.combinations(present, left_out) for q in ways]
    return out


def dialect_bits(dialect: Dialect) -> float:
    marks, quoting = dialect
    return (PLAIN_BITS if len(marks) < 2 else MIXED_BITS + len(marks)) + (0 if quoting else UNQUOTED_BITS)


def spelled_bits(value: str) -> float:
    """Code length of a value spelled out: its letters, and far more for each mark that could
    have separated values or opened a quotation but is left inside as text."""
    inside = len(re.findall(r"[,，;；|•·、\t\n]|//|\s/\s", re.sub(r"\([^()]*\)", "", value)))
    return VALUE_BITS + LETTER_BITS * len(value) + MARK_BITS * inside


def value_key(value: str) -> str:
    return " ".join(value.lower().split())


@lru_cache(maxsize=100_000)
def parses(field: str) -> list[tuple[float, list[str]]]:
    """The different parses of a field: (code length of dialect and open marks, values), cheapest
    dialect first where several give the same values."""
    body, seen = unwrap(field), {}
    for d in dialects_for(body):
        values, left_open = parse(body, d)
        cost = dialect_bits(d) + OPEN_BITS * left_open
        if (k := tuple(values)) not in seen or cost < seen[k]:
            seen[k] = cost
    return [(c, list(v)) for v, c in seen.items()]


_PARSED = "id string, no int, first boolean, sole boolean, bits double, values array<struct<v: string, k: string, bits: double>>"
_PARSED_ARROW = pa.schema(
    [
        ("id", pa.string()),
        ("no", pa.int32()),
        ("first", pa.bool_()),
        ("sole", pa.bool_()),
        ("bits", pa.float64()),
        ("values", pa.list_(pa.struct([("v", pa.string()), ("k", pa.string()), ("bits", pa.float64())]))),
    ]
)


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, field in zip(batch["id"].to_pylist(), batch["field"].to_pylist()):
            found = parses(field)
            costs = [c + sum(map(spelled_bits, v)) for c, v in found]
            best = min(range(len(found)), key=lambda i: (costs[i], i))
            for i, (c, v) in enumerate(found):
                values = [{"v": x, "k": value_key(x), "bits": spelled_bits(x)} for x in v]
                rows.append({"id": key, "no": i, "first": i == best, "sole": len(found) == 1, "bits": c, "values": values})
        yield pa.RecordBatch.from_pylist(rows, _PARSED_ARROW)


def split_packed(df: DataFrame, key: Column, field: Column) -> DataFrame:
    """(id, pos, value): one row per value of every field, pos from 1 in order of appearance.

    ``key`` (string) must be unique in ``df``; rows with a null key or a null or blank field give
    no rows. Values come without blanks around them, without enclosing quotation marks, escapes,
    a wrapping of the whole field and a heading in front. Empty values take no position, repeated
    ones stay. A field without any separator is one value.

    Nothing is collected: parses are written once, the shares of values are an aggregate combined
    before its shuffle, and the scores join those shares by value.
    """
    fields = df.select(key.cast("string").alias("id"), field.alias("field")).filter(F.col("id").isNotNull() & F.col("field").rlike(r"\S"))
    parsed = materialize(fields.mapInArrow(_parse_all, _PARSED), "parses")
    counted = parsed.filter("first").select(F.explode("values").alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.count("*").alias("n"))
    counted = materialize(counted, "value-shares")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    # The first use of a value spells it out, every further one names it by its share.
    named = -F.log2(F.col("n") / F.lit(float(total))) + F.col("spelled") / F.col("n")
    unsure = parsed.filter("NOT sole").select("id", "no", "bits", F.explode_outer("values").alias("x")).select("id", "no", "bits", F.col("x.k").alias("k"), F.col("x.bits").alias("spelled"))
    # Values with more than a thousandth of all uses are fewer than a thousand: they are looked up
    # where the parses lie, so that a value in a third of all fields sends no third to one task.
    hot = F.broadcast(counted.filter(F.col("n") * HOT_VALUES > total))
    known = unsure.join(hot, "k").unionByName(unsure.join(hot, "k", "left_anti").join(counted, "k", "left"))
    scored = (
        known.groupBy("id", "no")
        .agg((F.first("bits") + F.coalesce(F.sum(F.least("spelled", F.coalesce(named, "spelled"))), F.lit(0.0))).alias("cost"))
        .groupBy("id")
        .agg(F.min(F.struct(F.round("cost", 6).alias("cost"), "no")).alias("best"))
        .select("id", F.col("best.no").alias("no"))
    )
    chosen = parsed.filter("NOT sole").join(scored, ["id", "no"], "left_semi").unionByName(parsed.filter("sole"))
    return chosen.select("id", F.posexplode("values").alias("p", "x")).select("id", (F.col("p") + 1).cast("int").alias("pos"), F.col("x.v").alias("value"))


def paper_keywords(papers: DataFrame) -> DataFrame:
    """One row per keyword of each platform_id; of repeated rows the latest loaded counts."""
    valid = papers.filter("platform_id IS NOT NULL").groupBy("platform_id").agg(F.max(F.struct("loaded_at", "keywords")).alias("r"))
    out = split_packed(valid, F.col("platform_id"), F.col("r.keywords"))
    return out.select(F.col("id").alias("platform_id"), "pos", F.col("value").alias("keyword"))
