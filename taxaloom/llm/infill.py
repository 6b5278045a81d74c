"""Fill-in-middle: documents are cut at two unit borders and put together in another order, by a parallel automaton scan.

A unit is a maximal run of A-Za-z, or any other code point. An automaton over code points knows whether it is inside such a
run and how much of a marker it has seen. A stretch of text is summed up by what it does to every state: the state it ends
in, and how many units begin in it. Such functions compose associatively, so stretches are scanned without knowing how they
are entered: first all rows of ``ROW`` code points side by side, then their compositions by doubling. Documents above
``LONG`` are cut to chunks that are dealt over all tasks, each giving one function; a fold over a document's functions (a
few dozen bytes for each 16,384 code points) gives its units, the chunk in which each cut lies and the state that chunk is
entered in; the place is then selected within that chunk alone. Shorter documents are one chunk, scanned and selected at
once. The length decides on the way only, not on the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .rows import in_batches

#: Code points of a row that is scanned step by step, of a chunk, and above which a document is dealt in chunks.
ROW, CHUNK, LONG = 64, 16_384, 65_536
#: Chunks that are handed on at once.
AT_ONCE = 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# States: between units, in a run of letters, after "<", after "<" and a marker's letter (in a run), marker seen and
# between units, marker seen and in a run. Classes: nothing, "<", ">", a marker's letter, another letter, all else.
STATES, CLASSES = 6, 6
_NEXT = np.array([[0, 2, 0, 1, 1, 0], [1, 2, 0, 1, 1, 0], [2, 2, 0, 3, 1, 0], [3, 2, 4, 1, 1, 0], [4, 4, 4, 5, 5, 4], [5, 4, 4, 5, 5, 4]], np.uint8)
_STARTS = np.array([[0, 1, 1, s in (0, 2, 4), s in (0, 2, 4), 1] for s in range(STATES)], np.int32)
_CLASS = np.array([1 if c == "<" else 2 if c == ">" else 3 if c in "PSM" else 4 if c.isascii() and c.isalpha() else 5 for c in map(chr, range(129))], np.uint8)
_FOUND = 4


class Scan:
    """The functions of all rows of some texts, composed from the start of each text on."""

    def __init__(self, texts: list[str]) -> None:
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.first = np.r_[0, np.cumsum(-(-self.lengths // ROW))]  # the first row of each text, and the end
        flat = np.zeros(int(self.first[-1]) * ROW, np.uint8)
        for at, c in zip(self.first[:-1].tolist(), codes, strict=True):
            flat[at * ROW : at * ROW + len(c)] = _CLASS[np.minimum(c, 128)]
        self.rows = flat.reshape(-1, ROW)
        n = len(self.rows)
        self.next = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
        self.units = np.zeros((n, STATES), np.int64)
        for k in range(ROW):
            at = self.next * np.uint8(CLASSES) + self.rows[:, k, None]
            self.units += _STARTS.ravel()[at]
            self.next = _NEXT.ravel()[at]
        place = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))
        step = 1
        while n and step <= place.max():
            late = np.flatnonzero(place >= step)
            before = self.next[late - step]
            units = self.units[late - step] + np.take_along_axis(self.units[late], before.astype(np.int64), 1)
            self.next[late], self.units[late] = np.take_along_axis(self.next[late], before.astype(np.int64), 1), units
            step *= 2

    def function(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """What text ``k`` does to every state, and the units that begin in it."""
        if self.first[k] == self.first[k + 1]:
            return np.arange(STATES, dtype=np.uint8), np.zeros(STATES, np.int64)
        return self.next[self.first[k + 1] - 1], self.units[self.first[k + 1] - 1]

    def select(self, texts: np.ndarray, states: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Code points before unit ``wanted`` (from 0) of each of these texts, entered in these states; all if there is none."""
        row, state, rest = np.zeros(len(texts), np.int64), states.astype(np.uint8), wanted.astype(np.int64)
        out = self.lengths[texts].copy()
        for j, (k, s, w) in enumerate(zip(texts.tolist(), states.tolist(), wanted.tolist(), strict=True)):
            own = self.units[self.first[k] : self.first[k + 1], s]
            at = int(np.searchsorted(own, w, side="right"))
            row[j] = -1 if at == len(own) else self.first[k] + at
            if 0 < at < len(own):
                state[j], rest[j] = self.next[self.first[k] + at - 1, s], w - own[at - 1]
        live = np.flatnonzero(row >= 0)
        state, rest, cells = state[live], rest[live], self.rows[row[live]]
        offset = np.full(len(live), -1, np.int64)
        for k in range(ROW):
            at = state * np.uint8(CLASSES) + cells[:, k]
            starts = _STARTS.ravel()[at]
            offset = np.where((offset < 0) & (starts > 0) & (rest == 0), k, offset)
            rest = rest - starts
            state = _NEXT.ravel()[at]
        out[live] = (row[live] - self.first[texts[live]]) * ROW + offset
        return out


def plan(doc_id: int | None, n: int, marked: bool, rate: int = 90, spm: int = 20) -> tuple[str, int, int]:
    """Form of a document of ``n`` units, and the units before its middle and before its suffix, drawn from its doc_id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    form = "plain" if not n or marked or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"
    return form, *sorted((h[0] % (n + 1), h[1] % (n + 1)))


def _joined(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _short(rate: int, spm: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
            texts = [t or "" for t in pdf["text"]]
            scan = Scan(texts)
            plans = []
            for k, i in enumerate(ids):
                after, units = scan.function(k)
                plans.append((int(units[0]), *plan(i, int(units[0]), after[0] >= _FOUND, rate, spm)))
            which = np.repeat(np.arange(len(texts)), 2)
            cuts = scan.select(which, np.zeros(len(which), np.int64), np.array([p[2:] for p in plans], np.int64).ravel()).reshape(-1, 2)
            out = []
            for i, t, (n, form, *_), (a, b) in zip(ids, texts, plans, cuts.tolist(), strict=True):
                out.append((i, n, form, None, None, t) if form == "plain" else (i, n, form, a, b - a, _joined(form, t[:a], t[a:b], t[b:])))
            yield pd.DataFrame(out, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]).astype({"doc_id": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def _cut(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, h, text in zip(pdf["doc_id"].astype("Int64"), pdf["h"], pdf["text"], strict=True):
                starts = range(0, len(text), chunk)
                for at in range(0, len(starts), AT_ONCE):
                    own = starts[at : at + AT_ONCE]
                    yield pd.DataFrame({"doc_id": pd.array([doc_id] * len(own), dtype="Int64"), "h": h, "chunk": np.arange(at, at + len(own)), "text": [text[x : x + chunk] for x in own]})

    return run


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        scan = Scan(list(pdf["text"]))
        each = [scan.function(k) for k in range(len(pdf))]
        yield pdf[["doc_id", "h", "chunk"]].assign(doc_id=pdf["doc_id"].astype("Int64"), next=[x.astype(np.int32) for x, _ in each], units=[x for _, x in each])


def _resolve(rate: int, spm: int):
    def entries(doc_id: pd.Series, functions: pd.Series) -> pd.DataFrame:
        out = []
        for i, own in zip(doc_id, functions, strict=True):
            states, before = [0], [0]
            for f in own:
                before.append(before[-1] + int(f["units"][states[-1]]))
                states.append(int(f["next"][states[-1]]))
            n = before[-1]
            form, *wanted = plan(None if pd.isna(i) else int(i), n, states[-1] >= _FOUND, rate, spm)
            places = []
            for w in wanted:
                k = min(int(np.searchsorted(before, w, side="right")), len(own)) - 1
                places += [k, states[k], w - before[k]]
            out.append((n, form, *places))
        return pd.DataFrame(out, columns=["n", "form", "chunk1", "state1", "rest1", "chunk2", "state2", "rest2"])

    entries.__annotations__ = {"doc_id": pd.Series, "functions": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(entries, "n long, form string, chunk1 int, state1 int, rest1 long, chunk2 int, state2 int, rest2 long")


def _place(text: pd.Series, state: pd.Series, rest: pd.Series) -> pd.Series:
    scan = Scan(list(text))
    return pd.Series(scan.select(np.arange(len(text)), state.to_numpy(np.int64), rest.to_numpy(np.int64)))


_place.__annotations__ = {"text": pd.Series, "state": pd.Series, "rest": pd.Series, "return": pd.Series}


def _long(docs: DataFrame, chunk: int, rate: int, spm: int) -> DataFrame:
    """The rows of long documents; the key of a document is its id and a hash of its text, so repeated rows share all steps."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    chunks = keyed.transform(in_batches, _cut(chunk), "doc_id long, h long, chunk int, text string").repartition("doc_id", "h", "chunk")
    own = stored(chunks.transform(in_batches, _functions, "doc_id long, h long, chunk int, next array<int>, units array<long>"), "infill-functions")
    ordered = F.array_sort(F.collect_set(F.struct("chunk", "next", "units")))
    known = own.groupBy("doc_id", "h").agg(ordered.alias("functions")).select(F.col("doc_id").alias("id"), F.col("h").alias("k"), _resolve(rate, spm)("doc_id", "functions").alias("p"))
    known = stored(known.select("id", "k", "p.*"), "infill-places").hint("merge")
    met = keyed.join(known, keyed["doc_id"].eqNullSafe(known["id"]) & (keyed["h"] == known["k"]))
    place = F.pandas_udf(_place, "long")
    for c in "12":
        start = F.col(f"chunk{c}") * chunk
        met = met.withColumn(f"cut{c}", start + place(F.substr("text", start + 1, F.lit(chunk)), F.col(f"state{c}"), F.col(f"rest{c}")))
    a, b = F.col("cut1").cast("int"), F.col("cut2").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), a), F.substr("text", a + 1, b - a), F.substr("text", b + 1)
    plain = F.col("form") == "plain"
    psm, spm_ = (F.concat(*(F.lit(x) if isinstance(x, str) else x for x in order)) for order in ((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    output = F.when(plain, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    return met.select("doc_id", "n", "form", F.when(~plain, F.col("cut1")).alias("prefix_chars"), F.when(~plain, F.col("cut2") - F.col("cut1")).alias("middle_chars"), output.alias("output"))


def infill(docs: DataFrame, rate: int = 90, spm: int = 20, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` of a hundred documents are cut, ``spm`` of a hundred of these with the suffix first; draws and cuts are taken
    from the SHA-256 of ``1:`` and the doc_id (of ``1:`` alone where it is null). Null and empty texts, and those that
    contain a marker, are plain: the output is the text, and the lengths of prefix and middle are null. Repeated rows all
    stay, rows of one doc_id are cut alike only if their texts are equal; an empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short = texts.where(F.length("text") <= long).transform(in_batches, _short(rate, spm), _OUT)
    return short.unionByName(_long(texts.where(F.length("text") > long), chunk, rate, spm))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Texts that were cut hold no marker, so each is found by its first occurrence."""
    p, s, m = F.instr(output, PREFIX), F.instr(output, SUFFIX), F.instr(output, MIDDLE)
    between = lambda low, high: F.substr(output, low + 3, high - low - 3)
    tail = F.substr(output, m + 3)
    return F.when(form == "psm", F.concat(between(p, s), tail, between(s, m))).when(form == "spm", F.concat(between(p, m), tail, between(s, p))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``infill`` with SHA-256 digests of the output and of the text that is rebuilt from it, in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = infill(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
