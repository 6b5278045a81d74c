"""Matching statistics of a set of byte strings against each other, from a run-compressed Burrows-Wheeler transform.

The strings are joined with separators that match nothing. Of the suffix order only the transform's runs are kept: at both
ends of every run the text position is sampled, with the length it has in common with its neighbour outside the run. Inside
a run neighbours stay neighbours when both suffixes lose their first byte, so the common length just falls by one: the
statistics are streamed in text order from one sample to the next. Work and samples follow the number of runs, which copies
don't add to.
"""

from __future__ import annotations

import numpy as np

_FIRST = 7  # symbols of the first sort key
#: Least values of a 64-bit word with 1, 2, ... 8 significant bytes.
_BYTES = np.array([1 << (8 * k) for k in range(8)], np.uint64)


def suffix_order(text: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order; separators differ from each other and from every byte. Prefix doubling."""
    n = len(text)
    symbol = np.where(separator, 0, text.astype(np.uint64) + np.uint64(1)).astype(np.uint64)
    padded = np.concatenate([symbol, np.zeros(_FIRST, np.uint64)])
    key, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
    stop = np.concatenate([separator, np.ones(_FIRST, bool)])
    for k in range(_FIRST):
        ended |= stop[k : k + n]
        key = (key << np.uint64(9)) | np.where(ended, np.uint64(0), padded[k : k + n])
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    # a suffix that meets a separator is unlike all others
    new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | ended[order][1:] | ended[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    h = _FIRST
    while rank[order[-1]] < n - 1:
        after = np.full(n, -1, np.int64)
        after[: n - h] = rank[h:] if h < n else after[:0]
        # only ranks that are shared need sorting; the places of a rank are a stretch of the order
        group = rank[order]
        shared = np.zeros(n, bool)
        same = group[1:] == group[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        places = np.flatnonzero(shared)
        who = order[places]
        who = who[np.argsort(rank[who] * np.int64(n + 1) + after[who] + 1)]
        order[places] = who
        group, later = rank[order], after[order]
        rank[order] = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (later[1:] != later[:-1])])) - 1
        h *= 2
    return order


def _common(words: np.ndarray, left: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``p`` and ``q``, within what is left of their strings."""
    most = np.minimum(left[p], left[q])
    out = np.zeros(len(p), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = words[p[live] + out[live]] ^ words[q[live] + out[live]]
        full = x == 0
        # the number of equal leading bytes of a big-endian word, in integers only
        out[live[~full]] += 8 - np.searchsorted(_BYTES, x[~full], side="right")
        out[live[full]] += 8
        live = live[full]
        live = live[out[live] < most[live]]
    return np.minimum(out, most)


class RunIndex:
    """Run-compressed transform of the strings, with samples at both ends of its runs."""

    def __init__(self, strings: list[bytes]) -> None:
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
        n = self.n = len(text)
        separator = np.zeros(n, bool)
        separator[self.starts + lengths] = True
        left = np.repeat(self.starts + lengths, lengths + 1) - np.arange(n)
        order = suffix_order(text, separator)
        before = order - 1
        symbol = np.where(separator[before], -2 - before, text[before].astype(np.int64))  # separators differ
        edge = np.flatnonzero(symbol[1:] != symbol[:-1])  # places where a run ends and the next begins
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.zeros(n, np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | padded[k : k + n]
        common = _common(words, left, order[edge], order[edge + 1])
        self.runs = len(edge) + 1
        # samples: the last suffix of a run against the next, the first of a run against the one before
        self.ends, self.heads = (order[edge], common), (order[edge + 1], common)
        self.tail, self.top = int(order[-1]), int(order[0])  # these have no neighbour on one side

    def statistics(self) -> np.ndarray:
        """For every text position the length of the longest match that starts at another position."""
        out = np.zeros(self.n, np.int64)
        for (places, common), alone in ((self.heads, self.top), (self.ends, self.tail)):
            at = np.full(self.n, -1, np.int64)
            length = np.zeros(self.n, np.int64)
            at[places], length[places] = places, common
            at[alone] = alone
            at = np.maximum.accumulate(at)
            streamed = length[at] - (np.arange(self.n) - at)
            np.maximum(out, np.where(at >= 0, streamed, 0), out=out)
        return out


def repeated_starts(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string the places where a substring of this width starts that also starts elsewhere among the strings."""
    if not strings:
        return []
    index = RunIndex(strings)
    long = index.statistics() >= width
    return [np.flatnonzero(long[a : a + len(s)]) for a, s in zip(index.starts, strings, strict=True)]
