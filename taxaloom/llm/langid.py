"""Language identification by word-first backoff.

A known word is scored by its log frequency per language. A word that training has not shown falls back to its character
n-grams, longest order first: the first order at which any n-gram of the padded word is known gives the score (the mean
of its known n-grams). Training reads a bounded sample of the labelled rows (``rows`` of ``fit``), shared evenly among the
languages; of these rows every word and every n-gram is kept, whatever its frequency, and every language is predicted.

A table of the model holds 64-bit hashes of its items in ascending order and, for each, only the languages that showed it,
so it grows with what the sample shows and not with items times languages. Texts are scored many at a time: a word's row is
looked up once, and the rows of all words of the texts are summed by numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import bound_batches, fresh, in_batches, release

#: Runs of word characters without digits; what is no letter in them (numerals that are no digits) is cut out afterwards.
RUN = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Labelled rows that a model is learnt from, over all languages.
ROWS = 6_000
#: Longest n-grams.
ORDERS = 4
#: Distinct words a training task counts before it hands its counts on, and unseen words a prediction task remembers.
HELD_WORDS, REMEMBERED = 50_000, 60_000
#: Words, and cells of texts times languages, that are scored at once.
AT_ONCE, CELLS = 100_000, 1_000_000
#: Words whose n-grams the driver counts at once.
GRAMS_OF = 20_000
#: Words whose evidence counts in full; the evidence of longer texts is scaled to as many, so scores stay comparable.
EVIDENCE = 25
#: Counts that an item which a language has not shown is given.
SMOOTH = 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased words of a text: runs of letters (general categories L*)."""
    found = RUN.findall((text or "").lower())
    if not "".join(found).isascii() and not "".join(found).isalpha():
        found = [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return found


def _hashed(items: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in items), np.uint64, len(items))


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _grams(items: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the padded words, repeats included, and the number of the word each is of."""
    lengths = np.array([len(w) + 2 for w in items], np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in items).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = np.maximum(lengths - n + 1, 0)
    at = _spread(np.cumsum(lengths) - lengths, count)
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = (out ^ codes[at + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out, np.repeat(np.arange(len(items)), count)


def _summed(keys: np.ndarray, lang: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and languages in order, each pair once, with the sum of its counts."""
    order = np.lexsort((lang, keys))
    keys, lang, n = keys[order], lang[order], n[order].astype(np.float64)
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (lang[1:] != lang[:-1])][: len(keys)])
    return keys[new], lang[new], np.add.reduceat(n, new) if len(new) else n


@dataclass
class Table:
    """Items by hash: ``base`` is the log frequency per language of an item it has not shown, ``gain`` what an item adds."""

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int) -> Table:
        """From the hash, language and count of each item; repeats are summed."""
        keys, lang, n = _summed(keys, lang, n)
        known, start = np.unique(keys, return_index=True)
        base = np.log(SMOOTH / (np.bincount(lang, n, languages) + SMOOTH * max(1, len(known))))
        return cls(known, np.append(start, len(keys)).astype(np.int64), lang.astype(np.int32), np.log((n + SMOOTH) / SMOOTH), base)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class _Numbers(dict):
    """Numbers words in the order of their first request."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Rows:
    """Scores of the words met so far: the table each was found in (-1: none), and gains by language."""

    def __init__(self) -> None:
        self.number = _Numbers()
        self.table, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.lang, self.gain = np.zeros(0, np.int32), np.zeros(0)


@dataclass
class Model:
    """``tables``: of words, then of n-grams from the longest to the shortest."""

    languages: list[str]
    tables: list[Table]

    def _learn(self, rows: _Rows, new: list[str]) -> None:
        """Rows of words that were not met before."""
        n, width = len(new), len(self.languages)
        table = np.full(n, -1, np.int64)
        cell, gain = [np.zeros(0, np.int64)], [np.zeros(0)]
        left = np.arange(n)
        for k, own in enumerate(self.tables):
            items = new if k == 0 else [new[j] for j in left.tolist()]
            keys, word = (_hashed(items), np.arange(n)) if k == 0 else _grams(items, len(self.tables) - k)
            place = own.find(keys)
            word, place = left[word[place >= 0]], place[place >= 0]
            known = np.bincount(word, minlength=n)
            count = own.start[place + 1] - own.start[place]
            at = _spread(own.start[place], count)
            cell.append(np.repeat(word, count) * width + own.lang[at])
            gain.append(own.gain[at] / np.repeat(known[word], count))
            table[known > 0] = k
            left = left[known[left] == 0]
            if not len(left):
                break
        cells, back = np.unique(np.concatenate(cell), return_inverse=True)
        sums = np.bincount(back, np.concatenate(gain), len(cells))
        rows.table = np.concatenate([rows.table, table])
        rows.start = np.concatenate([rows.start, rows.start[-1] + np.cumsum(np.bincount(cells // width, minlength=n))])
        rows.lang = np.concatenate([rows.lang, (cells % width).astype(np.int32)])
        rows.gain = np.concatenate([rows.gain, sums])

    def _score(self, rows: _Rows, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Best language and posterior of texts, each with one word at least."""
        width, held = len(self.languages), len(rows.number)
        lengths = np.array([len(w) for w in found], np.int64)
        ids = np.fromiter((rows.number[w] for own in found for w in own), np.int64, int(lengths.sum()))
        if len(rows.number) > held:
            self._learn(rows, list(rows.number)[held:])
        text = np.repeat(np.arange(len(found)), lengths)
        classes = np.bincount(text * (len(self.tables) + 1) + rows.table[ids] + 1, minlength=len(found) * (len(self.tables) + 1))
        base = np.vstack([np.zeros(width), *(t.base for t in self.tables)])
        count = rows.start[ids + 1] - rows.start[ids]
        at = _spread(rows.start[ids], count)
        total = np.bincount(np.repeat(text, count) * width + rows.lang[at], rows.gain[at], len(found) * width).reshape(len(found), width)
        total += classes.reshape(len(found), -1) @ base
        total *= (np.minimum(lengths, EVIDENCE) / lengths)[:, None]
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        return best, odds[np.arange(len(found)), best] / odds.sum(axis=1)

    def predict(self, texts: list[str | None], rows: _Rows | None = None) -> pd.DataFrame:
        """lang_pred and score; ``und`` and 0 for a text without a letter or a model without a language."""
        rows = rows or _Rows()
        said, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        found: list[list[str]] = []
        who: list[int] = []
        waiting = 0

        def settle() -> None:
            nonlocal waiting
            if who:
                best, scores[who] = self._score(rows, found)
                said[who] = [self.languages[k] for k in best.tolist()]
            found.clear()
            who.clear()
            waiting = 0
            if len(rows.number) > REMEMBERED:
                rows.__init__()

        for k, text in enumerate(texts if self.languages else []):
            if own := words(text):
                found.append(own)
                who.append(k)
                waiting += len(own)
                if waiting >= AT_ONCE or len(who) * len(self.languages) >= CELLS:
                    settle()
        settle()
        return pd.DataFrame({"lang_pred": said, "score": scores})


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter] = {}

    def flush() -> pd.DataFrame:
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "word", "n"])

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            held.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, held.values())) >= HELD_WORDS:
                yield flush()
    yield flush()


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """lang, text of about ``rows`` rows in which neither is null, as many of each language; all rows where there are fewer.

    Rows are taken by a hash of their doc_id (of their text, where it is null), so the sample is the same at every run.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    left, share = rows, {}
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):  # what small languages leave goes to the others
        share[lang] = min(n, left // (len(sizes) - k)) / n
        left -= min(n, left // (len(sizes) - k))
    place = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(1 << 40)) / F.lit(1 << 40)
    most = F.create_map(*(F.lit(x) for item in share.items() for x in item))[F.col("lang")] if share else F.lit(0.0)
    return labelled.where("text is not null and lang is not null").where(place < most).select("lang", "text")


def fit(labelled: DataFrame, rows: int = ROWS) -> Model:
    """Learn from a sample of about ``rows`` rows of ``labelled`` (doc_id, lang, text)."""
    counted = sample(labelled, rows).transform(in_batches, _count_words, "lang string, word string, n long")
    # bounded by the sample: a row for each word and language that it shows
    shown = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(shown["lang"].unique())
    lang = shown["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64)
    own = shown["word"].tolist()
    tables = [Table.of(_hashed(own), lang, shown["n"].to_numpy(np.int64), len(languages))]
    for n in range(ORDERS, 0, -1):
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(own), GRAMS_OF):
            keys, word = _grams(own[at : at + GRAMS_OF], n)
            parts.append(_summed(keys, lang[at : at + GRAMS_OF][word], np.ones(len(keys))))
        tables.append(Table.of(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(languages)))
    return Model(languages, tables)


def predictor(docs: DataFrame, model: Model):
    """A function of a text column that gives a struct of lang_pred and score; the model is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, rows = shared.value, _Rows()
        for texts in batches:
            yield own.predict(texts.tolist(), rows)
        del own, rows
        release()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves no remainder. A null id counts as ''."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def identify(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from a sample of the rows that are not held out (see ``fit``) and predicts all, by their whole texts. Null, empty
    and letterless texts are ``und`` with score 0, and so is every text if no row is labelled; ties go to the language that
    sorts first; null and repeated doc_ids keep their rows; an empty table gives an empty result; other columns are not read.
    """
    own = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    said = predictor(docs, fit(own.where(~F.col("held_out")), rows))(F.col("text"))
    return own.select("doc_id", "held_out", said.alias("said")).select("doc_id", "held_out", "said.lang_pred", "said.score")


def keep_identified(docs: DataFrame, least: float = 0.5, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language with at least this score, with all their columns."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), rows)
    said = fresh(docs, "_said")[0]
    marked = docs.withColumn(said, predictor(docs, model)(docs["text"]))
    return marked.where((F.col(f"{said}.lang_pred") != UNDETERMINED) & (F.col(f"{said}.score") >= least)).select(*docs.columns)
