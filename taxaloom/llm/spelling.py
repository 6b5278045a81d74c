"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found over halves of words.

One edit touches one half of a word at most, so of two near words the second holds a half of the first unchanged: the left
one at its start or the right one at its end. Both halves (segments) of every word are dealt to shards by their text, and
every word is sent to the shards of the segments that it could hold there. A shard builds an Aho-Corasick automaton over its
segments, scans the words that come, and keeps a match only where its offset and both lengths allow one edit; what the
segment leaves of both words is then compared. Segments that many words share have an index of what is left with one code
point taken out, so no list is compared pair by pair. A segment of more than ``MOST`` words is dealt to several shards.

Every near pair is reported once, by the left segment if it fits, and counted where it is found: a shard sends one row for
a word, not its pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .rows import in_batches

# What a run is made of, and of which run a code point is taken out.
RUN, TYPO = r"[A-Za-zÀ-ÿ]+", 199
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Segments of a shard, words of a segment above which it is dealt to several, words of a list that are compared one by
#: one, and rows of a table that may be broadcast.
SHARD, MOST, FEW, SMALL = 4096, 4096, 12, 100_000

Entry = tuple[str, str, int]  # what a segment leaves of a word, the word, its n


def words(docs: DataFrame, least: int = 6, often: int = 5) -> DataFrame:
    """word, n: results of the runs of all texts, of at least ``least`` code points and ``often`` occurrences."""
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(RUN), F.lit(0))).alias("run")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    each = docs.select(name.alias("name"), "text").select("name", runs).select("run", F.crc32(F.concat("name", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % TYPO == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def one_edit(a: str, b: str) -> bool:
    """Whether the texts differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _without(text: str) -> list[str]:
    return [text[:k] + text[k + 1 :] for k in range(len(text))]


class _List:
    """What a segment leaves of the words of one length; asked for those that differ from a text by one edit."""

    def __init__(self) -> None:
        self.entries: list[Entry] = []
        self.index: dict[object, list[Entry]] | None = None

    def near(self, rest: str, longer: int) -> list[Entry]:
        """Entries one edit from ``rest``; ``longer``: their length less that of ``rest`` (-1, 0 or 1)."""
        if len(self.entries) <= FEW:
            return [e for e in self.entries if one_edit(e[0], rest)]
        if self.index is None:
            self.index = defaultdict(list)
            for e in self.entries:
                self.index[e[0]].append(e)
                shorter = _without(e[0])
                for key in {*enumerate(shorter), *((None, x) for x in shorter)}:
                    self.index[key].append(e)
        if longer == 0:
            return [e for key in enumerate(_without(rest)) for e in self.index.get(key, ()) if e[0] != rest]
        keys = [(None, rest)] if longer == 1 else set(_without(rest))
        return [e for key in keys for e in self.index.get(key, ())]


class Shard:
    """The automaton over the segments of a shard, with the words that hold them."""

    def __init__(self, postings: list[tuple[bool, str, int]]) -> None:
        """``postings``: whether the segment is the left one, the word, its n."""
        self.lists: dict[tuple[bool, str, int], _List] = defaultdict(_List)
        self.automaton = ahocorasick.Automaton()
        for left, word, n in postings:
            half = len(word) // 2
            segment, rest = (word[:half], word[half:]) if left else (word[half:], word[:half])
            self.lists[left, segment, len(word)].entries.append((rest, word, n))
            self.automaton.add_word(segment, segment)
        self.automaton.make_automaton()

    def near(self, word: str) -> list[Entry]:
        """Entries of the near words of ``word`` that this shard has to report."""
        out = []
        for end, segment in self.automaton.iter(word):
            start = end - len(segment) + 1
            for longer in (-1, 0, 1):
                if not start and (own := self.lists.get((True, segment, len(word) + longer))):
                    out += own.near(word[end + 1 :], longer)
                if end == len(word) - 1 and (own := self.lists.get((False, segment, len(word) + longer))):
                    out += (e for e in own.near(word[:start], longer) if not word.startswith(e[1][: len(e[1]) // 2]))
        return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (shard, kind, word, n) in this order: kinds 0 and 1 are left and right segments, kind 2 words to scan."""
    now, last, postings, shard = None, None, [], None
    for pdf in batches:
        out = []
        columns = (pdf[c].tolist() for c in ("shard", "kind", "word", "n"))
        for number, rows in groupby(zip(*columns, strict=True), key=itemgetter(0)):
            if number != now:
                now, last, postings, shard = number, None, [], None
            for _, kind, word, n in rows:
                if kind < 2:
                    postings.append((kind == 0, word, n))
                elif word != last:  # a word comes once for each segment that it could hold here
                    last = word
                    if postings:
                        shard = shard or Shard(postings)
                        if found := shard.near(word):
                            n_best, best = min((-e[2], e[1]) for e in found)
                            out.append((word, len(found), -n_best, best))
        yield pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def _segments(word: Column) -> tuple[list[tuple[int, Column]], list[tuple[int, Column]]]:
    """Own segments of a word, and those that it holds if a near word has them, with their side (0: left)."""
    n = F.length(word)
    left = lambda m: F.substr(word, F.lit(1), F.floor(m / 2).cast("int"))
    right = lambda m: F.right(word, (m - F.floor(m / 2)).cast("int"))
    return [(0, left(n)), (1, right(n))], [(side, f(n + more)) for more in (-1, 0, 1) for side, f in ((0, left), (1, right))]


def near(words: DataFrame) -> DataFrame:
    """``words`` (word, n) -> word, n_near, and n and text of its near word of largest n (ties: smallest): form_n, form."""
    shards = max(1, -(-2 * words.count() // SHARD))
    own, held = _segments(F.col("word"))
    key = lambda side, segment: F.xxhash64(F.lit(side), segment)
    postings = words.select("word", "n", F.explode(F.array(*(F.struct(F.lit(side).alias("kind"), key(side, s).alias("key")) for side, s in own))).alias("x")).select("word", "n", "x.*")
    scans = words.select("word", F.explode(F.array_distinct(F.array(*(key(side, s) for side, s in held)))).alias("key"))
    hot = stored(postings.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > MOST).select("key", F.ceil(F.col("m") / MOST).cast("int").alias("parts")), "spelling-hot")
    hot = F.broadcast(hot) if hot.count() <= SMALL else hot.hint("merge")
    parts = F.coalesce("parts", F.lit(1))
    place = F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int").alias("shard")
    postings = postings.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).select(place, "kind", "word", "n")
    scans = scans.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(place, F.lit(2).alias("kind"), "word", F.lit(0).cast("long").alias("n"))
    dealt = postings.unionByName(scans).repartition("shard").sortWithinPartitions("shard", "kind", "word")
    found = dealt.transform(in_batches, _scan, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) -> word, root: the end of each chain. A round doubles the steps, so chains cost their logarithm."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.toDF("at", "next")
        met = stored(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = met.select("word", "root")
        if met.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = 6, often: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for every word of ``docs`` (doc_id, text).

    Words come from maximal runs of letters (A-Z lower-cased) of which some lose a code point, as their crc32 says; those of
    at least ``least`` code points and ``often`` occurrences count. The form of a word is its near word of largest n, if that
    is at least ``times`` its own n, else null; the root is where the forms lead to, the word itself without a form. Null and
    empty texts have no run; a null doc_id counts as an empty one; repeated rows count each; ties go to the smallest word in
    code-point order; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    every = stored(words(docs, least, often), "spelling-words")
    met = every.join(near(every), "word", "left")
    form = lambda c: F.when(F.col("form_n") >= times * F.col("n"), F.col(c)).alias(c)
    met = stored(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form("form"), form("form_n")), "spelling-met")
    last = roots(met.where("form is not null").select("word", "form"))
    return met.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
