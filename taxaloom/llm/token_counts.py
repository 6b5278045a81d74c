"""Token counts that follow edits without counting a document anew.

A document is cut into pre-tokens, and a segment tree holds the token counts of its pre-tokens: leaf ``k`` is pre-token
``k``, a node is the sum of its two children, the root the document's count. An edit replaces a span of the text. Only
pre-tokens that the span touches are cut and encoded again, with boundary context on both sides: cutting starts two
pre-tokens before the edit and goes on until the new cuts agree with the old ones at two successive pre-tokens behind
it. Where the number of pre-tokens stays, only the paths from the changed leaves to the root are summed anew; where it
changes, the leaves behind move and the tree's sums are rebuilt from counts, still without encoding.

Added tokens in the text are found first, as the library does: each is a pre-token of one token, and what lies between
them is cut by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import BYTES, byte_alphabet, byte_pieces, odd
from .rows import in_batches

#: Pre-tokens whose counts a worker remembers, in each of two generations.
CACHE = 200_000
#: Pre-tokens of boundary context on each side of an edit.
CONTEXT = 2


class Counter:
    """Token counts of pre-tokens under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        library = Tokenizer.from_file(path)
        self.model = library.model
        self.added = {t.content for t in library.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.reach = max(map(len, self.added), default=0)
        self.shown = dict(enumerate(byte_alphabet()))
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.encoded = 0  # pre-tokens that were given to the merges or their memory

    def count(self, piece: str) -> int:
        got = self.cache.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                got = 1 if piece in self.added else len(self.model.tokenize("".join(map(self.shown.__getitem__, piece.encode("utf-8", "surrogatepass")))))
            if len(piece) <= 64:
                self.cache[piece] = got
                if len(self.cache) >= CACHE:
                    self.older, self.cache = self.cache, {}
        return got

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text, each added token being one."""
        out: list[str] = []
        at = 0
        for found in self.special.finditer(text):
            out += byte_pieces(text[at : found.start()])
            out.append(found[0])
            at = found.end()
        return out + byte_pieces(text[at:]) if at else byte_pieces(text)

    def counts(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        known, count = self.cache.get, self.count
        return [known(p) or count(p) for p in pieces]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


class CountTree:
    """The text of a document, the starts of its pre-tokens and the segment tree over their token counts."""

    def __init__(self, text: str | None, counter: Counter) -> None:
        self.text, self.counter = text or "", counter
        pieces = counter.pieces(self.text)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64) if pieces else np.zeros(0, np.int64)
        self.starts: list[int] = [0, *ends[:-1].tolist()] if pieces else []
        self._build(np.array(counter.counts(pieces), np.int64))

    def _build(self, leaves: np.ndarray) -> None:
        self.n = len(leaves)
        self.size = 1 << max(0, self.n - 1).bit_length()
        self.nodes = np.zeros(2 * self.size, np.int64)
        self.nodes[self.size : self.size + self.n] = leaves
        level = self.size
        while level > 1:
            self.nodes[level // 2 : level] = self.nodes[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.nodes[1]) if self.size > 1 or self.n else 0

    def between(self, first: int, last: int) -> int:
        """Tokens of the pre-tokens from ``first`` up to, not including, ``last``."""
        a, b, out = first + self.size, last + self.size, 0
        while a < b:
            if a & 1:
                out += int(self.nodes[a])
                a += 1
            if b & 1:
                b -= 1
                out += int(self.nodes[b])
            a, b = a // 2, b // 2
        return out

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the code points from ``start`` to ``end``; returns how many pre-tokens were encoded again."""
        start, end = max(0, min(start, len(self.text))), max(0, min(end, len(self.text)))
        end = max(start, end)
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        special, reach = self.counter.special, self.counter.reach
        low = max(0, start - reach)
        near = special.search(self.text, low, end + reach) or special.search(text, low, start + len(new) + reach)
        first = max(0, bisect_right(self.starts, low if near else start) - 1 - CONTEXT)
        at = self.starts[first] if self.starts else 0
        cut = (odd().bytes if odd().search(text) else BYTES).match
        pieces: list[str] = []
        starts: list[int] = []
        agreed, last = 0, self.n
        mark = special.search(text, at)
        while at < len(text):
            if at >= start + len(new):
                k = bisect_left(self.starts, at - shift)
                agreed = agreed + 1 if k < self.n and self.starts[k] == at - shift and at - shift >= end else 0
                if agreed > CONTEXT:
                    last = k
                    break
            if mark and mark.start() < at:
                mark = special.search(text, at)
            found = mark[0] if mark and mark.start() == at else cut(text, at, mark.start() if mark else len(text))[0]
            pieces.append(found)
            starts.append(at)
            at += len(found)
        counts = np.array(self.counter.counts(pieces), np.int64)
        self.text = text
        if len(pieces) == last - first:
            self.starts[first:last] = starts
            if shift:
                self.starts[last:] = [s + shift for s in self.starts[last:]]
            self.nodes[self.size + first : self.size + last] = counts
            a, b = (self.size + first) // 2, (self.size + last - 1) // 2
            while a and pieces:
                self.nodes[a : b + 1] = self.nodes[2 * a : 2 * b + 2].reshape(-1, 2).sum(axis=1)
                a, b = a // 2, b // 2
        else:
            leaves = self.nodes[self.size : self.size + self.n]
            self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[last:]]
            self._build(np.concatenate([leaves[:first], counts, leaves[last:]]))
        return len(pieces)


def count_tokens(docs: DataFrame, path: str, edits: DataFrame | Column | None = None) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text): doc_id, n_tokens, n_pretokens, n_tokens_edited, n_reencoded.

    ``edits`` (doc_id, step, start, end, new) lists replacements of code points; the edits of a document are applied in the
    order of step, each to the text that the one before left; positions beyond the text are clipped; edits with a null
    doc_id match no document; a null start counts as 0, a null end as the start, a null new text as empty. Without edits the
    last two columns equal the count and 0. ``edits`` may also be a column over ``docs``: an array of structs of step, start,
    end and new. Null and empty texts have no tokens; null and repeated doc_ids keep their rows,
    and each row of a repeated doc_id gets its edits; an empty table gives an empty result; other columns are not read.
    """
    kind = "array<struct<step:long,start:long,end:long,new:string>>"
    given = edits if isinstance(edits, Column) else F.array()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", given.cast(kind).alias("edits"))
    if isinstance(edits, DataFrame):
        one = F.struct(F.col("step").cast("long").alias("step"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("new").cast("string").alias("new"))
        listed = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("edits"))
        rows = rows.drop("edits").join(listed.hint("merge"), "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for pdf in batches:
            out = []
            for text, changes in zip(pdf["text"], pdf["edits"], strict=True):
                tree = CountTree(text, own)
                total, pieces, again = tree.total, tree.n, 0
                for e in changes if changes is not None else ():
                    start = int(e["start"] or 0)
                    again += tree.edit(start, start if e["end"] is None else int(e["end"]), e["new"] or "")
                out.append((total, pieces, tree.total, again))
            yield pd.DataFrame(out, columns=["n_tokens", "n_pretokens", "n_tokens_edited", "n_reencoded"]).assign(doc_id=pdf["doc_id"].astype("Int64"))

    return rows.transform(in_batches, run, "doc_id long, n_tokens long, n_pretokens long, n_tokens_edited long, n_reencoded long")
