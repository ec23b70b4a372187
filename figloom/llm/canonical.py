"""Mapping freely typed values to the entries of a reference list.

Method: a value is brought to plain words; a word that is no known word may be read as known ones
a slip or two away. A trie of canonical names and aliases is walked from every word through all
readings at once, and the longest mention with the least mended wins. What has no mention goes to
token-set similarity, the best over all readings; what is like no entry is reported with id -1.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.llm.decision_aliases import alias_table

#: Reference entries or aliases held by every worker, by default.
MAX_REFERENCE = 100_000
#: Share of words in common from which a value without a mention is taken for an entry.
LEAST_SIMILARITY = 0.75
UNMATCHED = -1
#: What a slip costs in similarity, and the most slips that leave enough of it.
SLIP_COST = 0.05
MOST_SLIPS = int((1 - LEAST_SIMILARITY) / SLIP_COST + 1e-9)

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсхуіјѕԁкмтвнαοερτυνι", "aeopcxyijsdkmtbhaoeptuvi")

#: Words that deny the mention right after them.
NEGATIONS = frozenset({"not", "never", "nicht", "cannot", "isnt", "wasnt"})


def plain(value: str) -> str:
    """Letters and digits of a value in one spelling, words one space apart."""
    value = html.unescape(re.sub(r"<[^<>]*>", " ", value))
    value = unicodedata.normalize("NFKC", value)
    value = re.sub(r"\b(?:[A-Z][a-z]+){2,}\b", lambda m: re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[0]), value)
    value = value.casefold().translate(LOOKALIKES)
    value = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", value))


def slips(a: str, b: str, most: int) -> int:
    """Edits between two words, or more than ``most``. A swap is one edit also of letters between
    which one has been left out or put in."""
    # An edit changes the letters that occur by two at most.
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    # rows[i][j]: edits between the first i letters of a and the first j of b.
    rows = [list(range(len(b) + 1))]
    last: dict[str, int] = {}  # where in a each letter was seen last
    for i, x in enumerate(a, 1):
        row, before, match = [i], rows[-1], 0
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            k = last.get(y, 0)
            if k and match:
                cost = min(cost, rows[k - 1][match - 1] + (i - k) + (j - match) - 1)
            if x == y:
                match = j
            row.append(cost)
        last[x] = i
        rows.append(row)
    return min(rows[-1][-1], most + 1)


class Matcher:
    """Finds the entry that a value means; built once per worker."""

    def __init__(self, names: dict[str, int], aliases: list[tuple[str, str]]):
        """``aliases``: (alias, name); those of unknown names are left out, and a name counts before
        an alias that reads alike."""
        self.patterns: dict[str, int] = {}
        for alias, name in aliases:
            if name in names:
                self.patterns.setdefault(plain(alias), names[name])
        self.patterns |= {plain(n): i for n, i in names.items() if plain(n)}
        # A node holds its followers by word; under None the pattern that ends there: (letters, id).
        self.trie: dict = {}
        for p, i in self.patterns.items():
            node = self.trie
            for w in p.split():
                node = node.setdefault(w, {})
            node[None] = len(p), i
        self.words = {w for p in self.patterns for w in p.split()}
        self.by_length: dict[int, list[str]] = {}
        for w in self.words:
            self.by_length.setdefault(len(w), []).append(w)
        self.sets: dict[frozenset, int] = {}
        for p, i in self.patterns.items():
            self.sets.setdefault(frozenset(p.split()), i)
        self.by_word: dict[str, list[frozenset]] = {}
        for s in self.sets:
            for w in s:
                self.by_word.setdefault(w, []).append(s)
        self.near = lru_cache(maxsize=100_000)(self._near)
        self.match = lru_cache(maxsize=200_000)(self._match)

    def _near(self, word: str) -> list[tuple[int, str]]:
        """(slips, known word), nearest first: the word itself if known or not a plain word, else
        itself and the known words one slip away, or two from four letters on."""
        if word in self.words or not word.isalpha() or not 2 <= len(word) <= 40:
            return [(0, word)]
        most = 1 if len(word) < 4 else 2
        alike = [w for k in range(max(3, len(word) - most), len(word) + most + 1) for w in self.by_length.get(k, ())]
        near = sorted((n, abs(len(w) - len(word)), w) for w in alike if (n := slips(word, w, most)) <= most)
        return [(0, word), *((n, w) for n, _, w in near)]

    def _mention(self, near: list[list[tuple[int, str]]]) -> int | None:
        """The id of the best mention in any reading, None if there is none.

        The rank of a mention depends on its own words only, and the reading that mends no others
        is its best; a longer mention that overlaps it there has no lower rank. So the best one is
        found by walking the trie from every word; a node is met once, as its words are given.
        """
        best, denied = None, 0
        for start in range(len(near)):
            if start and near[start - 1][0][1] in NEGATIONS:
                denied = max(denied, start + self._longest(near, start))
            if start < denied:
                continue
            # (node, slips, letters, which words are mended and how)
            live = [(self.trie, 0, 0, ())]
            n = 0
            while live and start + n < len(near):
                further = []
                for node, slipped, letters, mended in live:
                    for at, (k, w) in enumerate(near[start + n]):
                        if w in node:
                            further.append((node[w], slipped + k, letters + len(w), (*mended, (-(start + n), at)) if at else mended))
                live, n = further, n + 1
                for node, slipped, letters, mended in live:
                    # One word alone must be close: two slips need six letters, one slip three.
                    if None not in node or n == 1 and slipped > 1 and letters < 6:
                        continue
                    # Words found count most, less what had to be mended; of equal ones the first
                    # reading, the words as typed before others, and in it the first mention.
                    rank = (-(n - 0.4 * slipped), -letters, slipped, mended, -n, start)
                    if best is None or rank < best[0]:
                        best = rank, node[None][1]
        return best and best[1]

    def _cover(self, wanted: dict[str, int], places: list[tuple[list[tuple[int, str]], int]]) -> int | None:
        """The least slips with which different places of the value give all of ``wanted``."""
        least = {0: 0}
        for options, times in places:
            use = [(k, wanted[w]) for k, w in options if w in wanted]
            for _ in range(min(times, len(use))):
                for mask, slipped in list(least.items()):
                    for k, bit in use:
                        total = slipped + k
                        if total <= MOST_SLIPS and total < least.get(mask | bit, MOST_SLIPS + 1):
                            least[mask | bit] = total
        return least.get(sum(wanted.values()))

    def _partly(self, wanted: dict[str, int], common: int, places: list[tuple[list[tuple[int, str]], int]]) -> Iterator[tuple[int, int, int]]:
        """(words of ``wanted``, different words, slips) of the readings that can be similar enough."""
        # A word of one place only, not wanted, just counts; no word is mended to become it.
        seen = Counter(w for options, _ in places for _, w in options)
        shared = {w for w, n in seen.items() if n > 1} | wanted.keys()
        most = common if len(wanted) == 1 else min(common, len(wanted) - 1)
        # With so many slips, how many words beside the wanted ones leave the similarity needed.
        room = [2 * most / (LEAST_SIMILARITY + SLIP_COST * k) - len(wanted) - most + 1e-6 for k in range(MOST_SLIPS + 1)]
        states = {(frozenset(), 0): 0}
        for options, times in places:
            use = [(k, w) for k, w in options if w in shared]
            lone = options[0][1] not in shared
            # From one more time than slips on, one is left as typed.
            within = {(words, others, False): slipped for (words, others), slipped in states.items()}
            for _ in range(min(times, MOST_SLIPS + 1) if len(options) > 1 else 1):
                after: dict = {}
                for (words, others, kept), slipped in within.items():
                    ways = [(slipped + k, (words | {w}, others, kept)) for k, w in use]
                    if lone:
                        ways.append((slipped, (words, others + (not kept), True)))
                    for total, state in ways:
                        if total <= MOST_SLIPS and len(state[0] - wanted.keys()) + state[1] <= room[total] and total < after.get(state, MOST_SLIPS + 1):
                            after[state] = total
                within = after
            states = {}
            for (words, others, _), slipped in within.items():
                states[words, others] = min(slipped, states.get((words, others), slipped))
        for (words, others), slipped in states.items():
            yield len(words & wanted.keys()), len(words) + others, slipped

    def _similar(self, near: list[list[tuple[int, str]]]) -> int:
        """The entry with most words in common in any reading, UNMATCHED if none has enough. A slip
        costs so much that no reading with more than MOST_SLIPS counts, whatever its length."""
        typed = Counter(options[0][1] for options in near)
        known = {options[0][1]: options for options in near}
        places = [(known[w], n) for w, n in typed.items()]
        at: dict[str, list[int]] = {}
        for j, (options, _) in enumerate(places):
            for _, w in options:
                at.setdefault(w, []).append(j)
        similar = (0.0, 0, -UNMATCHED)
        for s, common in Counter(s for w in at for s in self.by_word.get(w, ())).items():
            wanted = {w: 1 << j for j, w in enumerate(s)}
            if common == len(s) > 1:
                slipped = self._cover(wanted, [places[j] for j in sorted({j for w in s for j in at[w]})])
                if slipped is not None:
                    similar = max(similar, (1.0 - SLIP_COST * slipped, len(s), -self.sets[s]))
            # A mended word takes at most one from the different words typed.
            if 2 * common >= LEAST_SIMILARITY * (len(s) + max(common, len(places) - MOST_SLIPS)):
                for c, n, slipped in self._partly(wanted, common, places):
                    if c < len(s) or c == 1:
                        similar = max(similar, (2 * c / (len(s) + n) - SLIP_COST * slipped, c, -self.sets[s]))
        return -similar[2] if similar[0] >= LEAST_SIMILARITY else UNMATCHED

    def _longest(self, near: list[list[tuple[int, str]]], start: int) -> int:
        """Words of the longest name or alias, in any reading, that begins at a word."""
        live, found, n = [self.trie], 0, 0
        while live and start + n < len(near):
            live, n = [node[w] for node in live for _, w in near[start + n] if w in node], n + 1
            if any(None in node for node in live):
                found = n
        return found

    def _denied(self, near: list[list[tuple[int, str]]]) -> bool:
        """Whether a name or alias is said right after a word that denies it."""
        return any(near[i][0][1] in NEGATIONS and self._longest(near, i + 1) for i in range(len(near) - 1))

    def _match(self, value: str) -> int:
        near = [self.near(w) for w in plain(value).split()]
        found = self._mention(near)
        if found is not None:
            return found
        # What is denied is not meant because it has the words.
        return UNMATCHED if self._denied(near) else self._similar(near)


@lru_cache(maxsize=4)
def matcher_of(names: tuple[tuple[str, int], ...], aliases: tuple[tuple[str, str], ...]) -> Matcher:
    """A worker keeps its matcher from task to task."""
    return Matcher(dict(names), list(aliases))


def match_values(df: DataFrame, value: Column, reference: DataFrame, name: str, ref_id: str, aliases: DataFrame | None = None, most: int = MAX_REFERENCE) -> DataFrame:
    """``df`` plus ref_id int: the id of the entry that ``value`` means, -1 if none, null for a
    null or blank value. No shuffle: every row is mapped where it is, a worker keeps what it has
    already mapped. Columns of ``df`` stay as they are; one called ref_id is replaced.

    ``aliases`` (alias, ref_name): other ways of saying the names. A name or alias right after a
    word of NEGATIONS is not meant. ``reference`` and ``aliases`` are held by every worker; more
    than ``most`` rows of either are refused. Of entries with one name, and of names with one
    alias, the smallest counts; rows with nulls are left out; an empty list matches nothing.
    """
    rows = reference.filter(F.col(name).isNotNull() & F.col(ref_id).isNotNull()).groupBy(name).agg(F.min(ref_id).alias("i")).limit(most + 1).collect()
    others = [] if aliases is None else aliases.filter("alias IS NOT NULL AND ref_name IS NOT NULL").groupBy("alias").agg(F.min("ref_name").alias("n")).limit(most + 1).collect()
    if max(len(rows), len(others)) > most:
        raise ValueError(f"more than {most} reference entries or aliases")
    names = tuple((r[0], int(r[1])) for r in sorted(rows, key=lambda r: r[0]))
    said = tuple(sorted((r[0], r[1]) for r in others))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = matcher_of(names, said)
        for batch in batches:
            yield pa.array([None if v is None or not v.strip() else matcher.match(v) for v in batch.to_pylist()], pa.int32())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn("ref_id", F.arrow_udf(run, "int")(value))


def typed_decisions(papers: DataFrame, reference: DataFrame) -> DataFrame:
    """platform_id, decision, ref_id of every paper whose decision is typed, not a ref_name."""
    valid = papers.filter("platform_id IS NOT NULL").groupBy("platform_id").agg(F.max(F.struct("loaded_at", "decision")).alias("r")).select("platform_id", "r.decision")
    # match_values refuses a long reference list before anything is broadcast.
    typed = valid.filter(F.col("decision").rlike(r"[^\s\p{Z}]")).join(F.broadcast(reference.select(F.col("ref_name").alias("decision"))), "decision", "left_anti")
    # What the list itself says about an entry is one more way of saying it.
    notes = reference.select(F.col("ref_note").alias("alias"), "ref_name")
    return match_values(typed, F.col("decision"), reference, "ref_name", "ref_id", alias_table(papers.sparkSession).unionByName(notes))


def paper_decisions(papers: DataFrame, reference: DataFrame) -> DataFrame:
    return typed_decisions(papers, reference).select("platform_id", "ref_id")


def unmatched_decisions(papers: DataFrame, reference: DataFrame) -> DataFrame:
    """The values that mean no entry, and how many papers have each."""
    return typed_decisions(papers, reference).filter(F.col("ref_id") == UNMATCHED).groupBy("decision").agg(F.count("*").alias("papers"))
