"""Column expressions on text, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind: ASCII blanks, no-break and other Unicode spaces, zero-width marks.
BLANK = r"[\s\x{0085}\p{Z}\x{200B}\x{2060}\x{FEFF}]"


def strip_blanks(c: Column) -> Column:
    """Without leading and trailing blanks of any kind."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def squeeze_blanks(c: Column) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def drop_blanks(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def or_empty(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def is_missing(c: Column) -> Column:
    """Null or empty; blanks count as text."""
    return or_empty(c) == ""


def slug(c: Column) -> Column:
    """Lower case with every run of other characters as one "_", none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_or_pending(c: Column) -> Column:
    """The slug of a decision as a folder name; nothing typed is pending_unknown."""
    return F.coalesce(F.nullif(slug(c), F.lit("")), F.lit("pending_unknown"))


#: Words that make a decision an acceptance, how captions and mentions of figures
#: begin, and the units of sizes.
ACCEPTING = "accept|spotlight|poster|oral"
FIGURE = r"(?:Figure|Fig)s?\.?"
UNITS = ("B", "KB", "MB", "GB", "TB")


def is_accepted(c: Column) -> Column:
    """Whether a decision or its slug names an acceptance; a substring is enough."""
    return or_empty(F.lower(c)).rlike(ACCEPTING)


def join_list(c: Column) -> Column:
    """A list as text, ", " between its values; empty for null."""
    return or_empty(F.array_join(c, ", "))


def yyyymmdd(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def preview(c: Column, n: int = 100) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def human_bytes(n: Column) -> Column:
    """A size with a unit, base 1024, two decimals at most as a shortest float; 0 is "0 B"."""
    power = F.when(n >= 1 << 40, 4).when(n >= 1 << 30, 3).when(n >= 1 << 20, 2).when(n >= 1 << 10, 1).otherwise(0)
    unit = F.element_at(F.array(*map(F.lit, UNITS)), power + 1)
    return F.when(n == 0, "0 B").otherwise(F.concat(F.round(n / F.pow(F.lit(1024.0), power), 2).cast("string"), F.lit(" "), unit))


def figure_key(c: Column) -> Column:
    """The digits of a figure number."""
    return F.regexp_replace(c, r"(?U)\D", "")


def unbroken(c: Column) -> Column:
    """Text with words broken at line ends joined and all runs of blanks as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"-\s*[\n\r]+", ""), r"\n", " "), r"(?U)\s+", " "))


def block_text(blocks: Column) -> Column:
    """The text of a page's blocks, structs of (kind, text): those of kind 0, unbroken, without
    empty ones, a blank line apart; empty for null."""
    texts = F.transform(F.filter(blocks, lambda b: b["kind"] == 0), lambda b: unbroken(b["text"]))
    return or_empty(F.array_join(F.filter(texts, lambda x: x != ""), "\n\n"))


def paragraphs(c: Column) -> Column:
    return F.split(c, "\n\n")


def is_caption(c: Column) -> Column:
    """Whether a paragraph is the caption of a figure and not text about one."""
    return c.rlike(rf"(?iU)^\s*{FIGURE}\s*\d+\s*[:.]")


def is_context(c: Column, least: int = 20) -> Column:
    """Paragraphs long enough to say something that are no captions."""
    return (F.length(c) >= least) & ~is_caption(c)


def mentioned_figures(c: Column) -> Column:
    """The numbers that follow a mention of a figure within 50 characters, each once.

    Every number counts, so "Figure 3 shows 5 models" gives 3 and 5; "Figure1" gives none. One
    literal pattern finds all keys of a paragraph at once, so figures join by equality.
    """
    windows = F.regexp_extract_all(c, F.lit(rf"(?iUd)\b(?=({FIGURE}.{{0,50}}\d*))"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(windows, lambda w: F.regexp_extract_all(w, F.lit(r"(?U)\b\d+"), F.lit(0)))))


def tagged(c: Column, tag: str = "paragraph") -> Column:
    """An array of texts as one, each between numbered tags, a line each."""
    return F.array_join(F.transform(c, lambda x, i: F.concat(F.lit(f"<{tag}_"), i + 1, F.lit(">"), x, F.lit(f"</{tag}_"), i + 1, F.lit(">"))), "\n")


def data_url(binary: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(binary))


def grouped(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def padded(*cells: tuple[Column, int]) -> Column:
    """Cells as a line of a table: filled with blanks on the right up to a width, on the left where
    the width is negative; longer cells stay whole."""
    fill = lambda c, w: F.when(F.length(c) >= abs(w), c).otherwise(F.rpad(c, w, " ") if w > 0 else F.lpad(c, -w, " "))
    return F.concat_ws(" ", *[fill(or_empty(c.cast("string")), w) for c, w in cells])


def pdf_url(pid: Column, base: str) -> Column:
    """Where the PDF of a paper lies."""
    return F.concat(F.lit(f"{base}/pdf?id="), pid)
