"""Reading level of documents.

Six classic readability formulas, from sentence length and from syllables and letters of words,
give each sentence six grade estimates. Long words that children know and short ones that only
specialists know mislead them; so, as Gunning's rule excepts familiar words from the hard ones, a
word that ratings show to be familiar to a reader counts as one syllable and one shown not to be
as a hard word, whatever its letters; other words count as they are. Ratings of a bounded sample
turn each formula's grade into a level by a monotone fit, and the median of the six is the level
of the sentence. A document has the level of the median of its words, so a stray sentence decides
nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fit takes this many rated documents at most, chosen by a hash of their id, of at most
#: so many characters each. Scoring reads every document whole.
MAX_RATED, MAX_RATED_CHARS = 4000, 20_000
#: Fewer rated documents than this calibrate nothing; levels are then read off the median grade.
LEAST_RATED = 20
#: More words than this without a mark are no sentence but text that has lost its marks; it counts
#: as sentences of a usual length.
LONGEST, USUAL = 60, 15
#: Clauses joined by a conjunction count as sentences if both have so many words.
LEAST_CLAUSE = 5
LEVELS = 5
#: A word is familiar up to a level if it is at least half as frequent there as it would be if all
#: levels used it alike; of a word in a single rated document nothing is known.
FAMILIAR, LEAST_SEEN = 0.5, 2
#: Syllables and letters that a familiar word has at most, and an unfamiliar one at least.
EASY_SYLLABLES, EASY_LETTERS, HARD_SYLLABLES, HARD_LETTERS = 1, 4, 3, 8
#: A text of unstated language is scored if so many of its words occur in rated texts.
LEAST_KNOWN = 0.5
#: Grades at which levels 2, 3, 4 and 5 begin where nothing is calibrated.
GRADE_STEPS = (3.5, 6.5, 10.5, 15.0)

_TAG = re.compile(r"<[^<>]{1,200}>")
_LINK = re.compile(r"\b(?:https?://|www\.)\S+")
_MATH = re.compile(r"\$[^$\n]{1,300}\$|\\[a-zA-Z]+")
_CITED = re.compile(r"\[\d[\d,\s–-]*\]|\((?:[^()\d]{1,80}\s)?(?:et al\.?,?\s)?\d{4}[a-z]?\)|\([^()]{1,60}et al\.[^()]{0,20}\)")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*[\r\n]+[ \t]*(?=[^\W\d_])")
#: A word, or the end of a sentence: its mark, a blank line or the begin of a list item.
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?…]+[\"'”’)\]]*(?=\s|$)|\n[ \t\r]*\n|\n[ \t]*[-*•][ \t]|[;:](?=\s)")
#: Conjunctions that join clauses.
JOINING = ("and", "but", "so")


def clean(text: str) -> str:
    """Text without markup, links, formulas and references, with words broken by lines joined."""
    text = html.unescape(_TAG.sub(" ", text)).replace("&", " and ")
    text = _BROKEN.sub("", text.replace("\u00ad", ""))
    return _CITED.sub(" ", _MATH.sub(" ", _LINK.sub(" ", text)))


_VOWELS = re.compile(r"[aeiouyàâäæéèêëíîïóôöœúùûüÿ]+")
#: Endings in which a vowel is silent, and places where two vowels are two syllables.
_SILENT = re.compile(r"(?:[^aeiouylrw]|[^l]l|[^r]r)e$|[^aeiouytd]ed$|[^aeiouyscxzgh]es$|[aeiouy][^aeiouy]+ely$|[^aeiouy]eful$|[^aeiouy]eless$|[^aeiouy]ement")
_APART = re.compile(r"ia(?!l$|n$|r$)|io(?!n|us)|eo(?!n$|us|p)|iu|[^qg]ua(?!r)|ii|uo|[aiouy]ing$|eing$|[^aeiouy]les?$|sm$|thm$|ience|iety")


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of a word by rules on its letters; at least one."""
    return max(1, len(_VOWELS.findall(word)) + len(_APART.findall(word)) - len(_SILENT.findall(word)))


FORMULAS = ("flesch_kincaid", "fog", "smog", "ari", "coleman_liau", "lix")
_END, _JOIN = 0, 1


class Vocabulary(dict):
    """Words to numbers; a mark that ends a sentence is _END. Numbered words keep letters and syllables."""

    def __init__(self):
        self.words = ["", *JOINING]
        self.update({w: n for n, w in enumerate(JOINING, 1)})

    def __missing__(self, token: str) -> int:
        if token[0] in ".!?…;:\n":
            return _END
        self[token] = n = len(self.words)
        self.words.append(token)
        return n


@dataclass(frozen=True)
class Parsed:
    """Texts as word numbers: ``words`` one after another, ``lengths`` of the sentences and the
    document of each sentence."""

    words: np.ndarray
    lengths: np.ndarray
    document: np.ndarray
    documents: int


def parse(texts: list[str], known: Vocabulary) -> Parsed:
    """Sentences of texts. Joined clauses count as sentences, and text of more than LONGEST words
    that has lost its marks as sentences of about USUAL words."""
    tokens = [np.array([_END, *map(known.__getitem__, _TOKEN.findall(clean(t).lower()))], dtype=np.int32) for t in texts]
    flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int32)
    document = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
    word = flat != _END
    # A sentence is numbered by the ends before it; documents begin with one.
    sentence, words, document = np.cumsum(~word)[word], flat[word], document[word]
    if not len(words):
        return Parsed(words, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), len(texts))
    at = np.arange(len(words))
    new = np.r_[True, sentence[1:] != sentence[:-1]]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.r_[starts, len(words)])
    for i in np.flatnonzero(lengths > LONGEST):
        pieces = -(-lengths[i] // USUAL)
        new[starts[i] + lengths[i] * np.arange(pieces) // pieces] = True
    # A clause begins at a conjunction far enough from the conjunction or begin before it and from the end.
    left = np.r_[np.flatnonzero(new)[1:], len(words)][np.cumsum(new) - 1] - at
    joins = (words >= _JOIN) & (words <= len(JOINING))
    before = np.maximum.accumulate(np.where(new | joins, at, 0))
    new |= joins & (at - np.r_[0, before[:-1]] >= LEAST_CLAUSE) & (left >= LEAST_CLAUSE)
    starts = np.flatnonzero(new)
    return Parsed(words, np.diff(np.r_[starts, len(words)]), document[starts], len(texts))


@dataclass(frozen=True)
class Model:
    """lexicon: for each word bits 1, 2, 4, 8 for being familiar up to level 1, 2, 3, 4. steps: for
    each of these levels and each formula the grades at which the share of text beyond the level
    rises, and the shares. languages: those with enough rated documents."""

    lexicon: dict[str, int]
    steps: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)
    languages: frozenset[str] = frozenset()


def grades(parsed: Parsed, known: Vocabulary, lexicon: dict[str, int] | None = None) -> np.ndarray:
    """[sentence, level, formula]: the six grades with the words familiar up to each level but the
    last; without a lexicon words count as they are written, for a single level."""
    letters = np.array([len(w) for w in known.words], dtype=float)
    sounded = np.array([syllables(w) for w in known.words], dtype=float)
    n = parsed.lengths.astype(float)
    start = np.r_[0, np.cumsum(parsed.lengths)[:-1]].astype(np.int64)
    out = np.zeros((len(n), LEVELS - 1 if lexicon is not None else 1, len(FORMULAS)))
    if not len(n):
        return out
    bits = np.array([lexicon.get(w, -1) for w in known.words]) if lexicon is not None else None
    for k in range(out.shape[1]):
        long, many = letters, sounded
        if bits is not None:
            familiar, strange = (bits >= 0) & (bits >> k & 1 == 1), (bits >= 0) & (bits >> k & 1 == 0)
            long = np.where(familiar, np.minimum(letters, EASY_LETTERS), np.where(strange, np.maximum(letters, HARD_LETTERS), letters))
            many = np.where(familiar, EASY_SYLLABLES, np.where(strange, np.maximum(sounded, HARD_SYLLABLES), sounded))
        table = np.column_stack([long, many, many >= 3, long > 6])
        L, S, hard, longer = (np.add.reduceat(table[parsed.words], start, axis=0) / n[:, None]).T
        out[:, k] = np.column_stack(
            [
                0.39 * n + 11.8 * S - 15.59,
                0.4 * (n + 100 * hard),
                1.043 * np.sqrt(30 * hard * n) + 3.1291,
                4.71 * L + 0.5 * n - 21.43,
                5.88 * L - 29.6 / n - 15.8,
                (n + 100 * longer) / 5 - 1,
            ]
        )
    return out


def learn_lexicon(parsed: Parsed, known: Vocabulary, levels: np.ndarray) -> dict[str, int]:
    """Up to which levels the words of rated documents are familiar. Levels weigh alike however
    many documents they have."""
    owner = np.repeat(parsed.document, parsed.lengths)
    pairs = np.unique(owner * len(known.words) + parsed.words)
    owner, word = pairs // len(known.words), pairs % len(known.words)
    count = np.bincount(levels, minlength=LEVELS + 1)
    weight = len(levels) / ((count > 0).sum() * np.maximum(count, 1))
    use = np.zeros((len(known.words), LEVELS))
    np.add.at(use, (word, levels[owner] - 1), weight[levels[owner]])
    alike = np.arange(1, LEVELS) / LEVELS
    share = (np.cumsum(use, axis=1)[:, : LEVELS - 1] + 0.5 * alike) / (use.sum(1, keepdims=True) + 0.5)
    bits = ((share >= FAMILIAR * alike) << np.arange(LEVELS - 1)).sum(1)
    seen = np.bincount(word, minlength=len(known.words))
    return {known.words[i]: int(bits[i]) for i in np.flatnonzero(seen >= LEAST_SEEN)}


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values): the rising step function of x nearest to y by weighted squares."""
    x, inverse = np.unique(x, return_inverse=True)
    w = np.bincount(inverse, weight)
    means = np.bincount(inverse, weight * y) / w
    blocks: list[tuple[float, float, int]] = []
    for i in range(len(x)):
        mean, mass, first = means[i], w[i], i
        while blocks and blocks[-1][0] >= mean:
            m, v, first = blocks.pop()
            mean, mass = (m * v + mean * mass) / (v + mass), v + mass
        blocks.append((mean, mass, first))
    return x[[b[2] for b in blocks]], np.array([b[0] for b in blocks])


def fit(texts: list[str], levels: list[int], languages: frozenset[str] = frozenset()) -> Model:
    """Calibrate on rated texts. Grades of a half of the texts use the other half's lexicon."""
    if len(texts) < LEAST_RATED or len(set(levels)) < 2:
        return Model({})
    known, rated = Vocabulary(), np.array(levels)
    halves = [np.arange(len(texts)) % 2 == k for k in (0, 1)]
    parsed = [parse([t for t, mine in zip(texts, h) if mine], known) for h in halves]
    G, W, Y = [], [], []
    for k in (0, 1):
        here = parsed[k]
        G.append(grades(here, known, learn_lexicon(parsed[1 - k], known, rated[halves[1 - k]])))
        # A document weighs one, whatever its length.
        W.append(here.lengths / np.bincount(here.document, here.lengths, minlength=here.documents)[here.document])
        Y.append(rated[halves[k]][here.document])
    g, w, y = np.concatenate(G), np.concatenate(W), np.concatenate(Y)
    w = w / np.bincount(y, w)[y]
    steps = [[rising(g[:, k, f], (y > k + 1).astype(float), w) for f in range(len(FORMULAS))] for k in range(LEVELS - 1)]
    whole = Vocabulary()
    return Model(learn_lexicon(parse(texts, whole), whole, rated), steps, languages)


def sentence_levels(g: np.ndarray, model: Model) -> np.ndarray:
    """[sentence]: the median of the formulas' levels; the share beyond each level adds up to a level."""
    out = np.ones((len(g), len(FORMULAS)))
    for k, formulas in enumerate(model.steps):
        for f, (start, share) in enumerate(formulas):
            out[:, f] += share[np.maximum(np.searchsorted(start, g[:, k, f], side="right") - 1, 0)]
    return np.median(out, axis=1)


def score(texts: list[str], model: Model) -> list[tuple[float, float, int, float]]:
    """(median grade, level as a number, level from 1 to 5, share of words that occur in rated
    texts) of each text; nan and 0 without words."""
    known = Vocabulary()
    parsed = parse(texts, known)
    grade = np.median(grades(parsed, known)[:, 0], axis=1)
    level = sentence_levels(grades(parsed, known, model.lexicon), model) if model.steps else 1.0 + np.searchsorted(GRADE_STEPS, grade, side="right")
    seen = np.array([w in model.lexicon for w in known.words])[parsed.words]
    starts, ends = (np.searchsorted(parsed.document, np.arange(len(texts)), side=side) for side in ("left", "right"))
    word_at = np.r_[0, np.cumsum(parsed.lengths)]
    out = []
    for a, b in zip(starts, ends):
        if a == b:
            out.append((float("nan"), float("nan"), 0, 0.0))
            continue
        g, v = (_weighted_median(y[a:b], parsed.lengths[a:b]) for y in (grade, level))
        out.append((g, v, int(min(LEVELS, max(1, np.floor(v + 0.5)))), float(seen[word_at[a] : word_at[b]].mean())))
    return out


def _weighted_median(x: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    total = np.cumsum(weight[order])
    return float(x[order][np.searchsorted(total, total[-1] / 2)])


def language(c: Column) -> Column:
    """A language in one spelling; null where none is stated."""
    return F.nullif(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("und"))


def rated_texts(documents: DataFrame, ratings: DataFrame) -> list[tuple[str, int, str | None]]:
    """The bounded sample that the fit sees: text, the median of its valid ratings, language.

    Rated documents are kept by a hash of their id, at the share that makes them about MAX_RATED;
    so few ids are broadcast to the scan of the texts, and only their texts come to the driver.
    """
    valid = ratings.filter(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull())
    rated = valid.select("doc_id").agg(F.approx_count_distinct("doc_id")).first()[0]
    kept = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, MAX_RATED / max(1, rated))))
    level = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY reading_level)").cast("int").alias("level")
    levels = valid.filter(kept).groupBy("doc_id").agg(level)
    texts = documents.filter((F.length("text") <= MAX_RATED_CHARS) & F.col("text").rlike(r"\S") & kept).select("doc_id", "text", language(F.col("lang")).alias("lang"))
    # A document id that is repeated without end must not flood the driver: each text counts once.
    one = texts.join(F.broadcast(levels), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t"), F.first("level").alias("level"))
    return sorted(((r.t.text, r.level, r.t.lang) for r in one.collect()), key=lambda r: (r[0], r[1], r[2] or ""))


def fitted(documents: DataFrame, ratings: DataFrame) -> Model:
    rated = rated_texts(documents, ratings)
    often = Counter(lang for *_, lang in rated if lang is not None)
    return fit([t for t, *_ in rated], [k for _, k, _ in rated], frozenset(lang for lang, n in often.items() if n >= LEAST_RATED))


_READ = "grade double, level_score double, reading_level int, known double"
_READ_ARROW = pa.struct([("grade", pa.float64()), ("level_score", pa.float64()), ("reading_level", pa.int32()), ("known", pa.float64())])


def with_reading_level(df: DataFrame, text: Column, model: Model) -> DataFrame:
    """``df`` plus grade double, level_score double, reading_level int and known double (the share
    of words that occur in rated texts); columns of these names are replaced. Null, blank and
    wordless texts have nulls. No shuffle; texts are read whole."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list = []
            for start in range(0, len(batch), 200):
                texts = batch.slice(start, 200).to_pylist()
                out += [None if not k else {"grade": g, "level_score": v, "reading_level": k, "known": s} for g, v, k, s in score([t or "" for t in texts], model)]
            yield pa.array(out, _READ_ARROW)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kept = [c for c in df.columns if c not in _READ_ARROW.names]
    return df.select(*[df[f"`{c}`"] for c in kept], F.arrow_udf(run, _READ)(text).alias("_read")).select(*[F.col(f"`{c}`") for c in kept], "_read.*")


def document_levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every row of documents with its grade and level, calibrated on the ratings. Texts of a
    language with fewer than LEAST_RATED rated documents have no grade and no level; where no
    language is stated, the share of known words decides."""
    model = fitted(documents, ratings)
    levels = with_reading_level(documents, F.col("text"), model)
    if not model.steps:
        return levels
    said = language(F.col("lang"))
    fits = F.when(said.isNull(), F.col("known") >= LEAST_KNOWN).otherwise(said.isin(sorted(model.languages)))
    return levels.withColumns({c: F.when(fits, F.col(c)) for c in ("grade", "level_score", "reading_level")})


def easy_documents(documents: DataFrame, ratings: DataFrame, most: int = 2, least_words: int = 40) -> DataFrame:
    """doc_id of English documents of enough words whose level is at most ``most``."""
    model = fitted(documents, ratings)
    english = documents.filter((F.col("lang") == "en") & (F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")) >= least_words))
    return with_reading_level(english.select("doc_id", "text"), F.col("text"), model).filter(F.col("reading_level") <= most).select("doc_id")


def level_profile(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """How many documents of each source and language have which level, and their mean grade."""
    levels = document_levels(documents, ratings)
    return levels.groupBy("source", "lang", "reading_level").agg(F.count("*").alias("documents"), F.round(F.avg("grade"), 4).alias("mean_grade"))
