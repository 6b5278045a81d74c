"""An adaptive context-mixing range coder for token ids, in blocks that are reset and checksummed one by one.

A block is cut into up to ``LANES`` runs of neighbouring ids, which are coded side by side: step t codes id t of every run, by
one model of the whole block, which then learns all of them. The model mixes three distributions over ids. Order 2 says the
id that last followed the two before it, order 1 the id that last followed the one before, order 0 is all ids by how often
they occurred where neither was right. How much order 2 gets is learnt twice, by how sure the two predictions have been and
by the id before, and both estimates are mixed by weights that move to the one that was closer; the rest is shared by how
sure they have been. So an id is one choice of three, and in the third case one number of 16 bits.

The range coder is carry-free: an interval of 64 bits is narrowed, and its upper 16 bits are put out once they are settled;
an interval that gets too narrow across a border is cut off there. All is integer arithmetic, so every machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, the most runs of a block, and the least ids of a run but for the last; they bound a worker's memory to
#: some tens of MB.
BLOCK, LANES, RUN = 1 << 20, 4096, 64
MAGIC = b"TXM3"
#: log2 of the alphabet, of the slots of order 2, of the contexts by the id before, and of the scale of a probability.
BITS, SLOTS, BEFORE, SCALE = 16, 16, 10, 15
U64 = np.uint64
_SURE = 80  # contexts by how sure the predictions are: four states of each and none, and whether they agree
#: Steps after which the model learns, but for the first ones of a block; a context's counts and those of order 0 are halved
#: above these sums; what an occurrence adds in order 0.
_EVERY, _FIRST, _MOST, _TOTAL, _GAIN = 8, 8, 1 << 12, 1 << 22, 32
_NARROW, _UPPER, _WORD = U64(1 << 40), U64(1 << 48), U64(16)
_SURER = np.array([1, 2, 3, 3, 0])
_NONE = (1 << 20) * 8 + 4  # no id yet: an entry is id * 8 and how often it was right since, up to 3


class _Choice:
    """Estimates of which of the three distributions is right, by context: shares of the first, and of the second in the rest."""

    def __init__(self, contexts: int) -> None:
        self.counts = np.ones((contexts, 3), np.int64)
        self.share()

    def share(self) -> None:
        one, two, three = self.counts.T
        self.first, self.second = (one << SCALE) // (one + two + three), (two << SCALE) // (two + three)

    def learn(self, context: np.ndarray, choice: np.ndarray) -> None:
        self.counts += np.bincount(context * 3 + choice, minlength=self.counts.size).reshape(-1, 3)
        full = self.counts.sum(axis=1) > _MOST
        if full.any():
            self.counts[full] = (self.counts[full] + 1) >> 1
        self.share()


class _Block:
    """Model and coder states of one block; ``words`` of each run are given when decoding."""

    def __init__(self, n: int, words: list[np.ndarray] | None) -> None:
        self.lanes = max(1, min(LANES, -(-n // RUN)))
        self.run_length = -(-n // self.lanes)
        self.lengths = np.clip(n - np.arange(self.lanes) * self.run_length, 0, self.run_length)  # longest first
        self.low, self.high = np.zeros(self.lanes, U64), np.full(self.lanes, (1 << 64) - 1, U64)
        self.order2, self.order1 = np.full(1 << SLOTS, _NONE, np.int64), np.full(1 << BITS, _NONE, np.int64)
        self.order0 = np.ones(1 << BITS, np.int64)
        self.starts = np.arange((1 << BITS) + 1, dtype=U64)
        self.by_sure, self.by_before = _Choice(_SURE), _Choice(1 << BEFORE)
        self.weight = np.full(_SURE, 128, np.int64)
        self.seen: list[tuple[np.ndarray, ...]] = []
        self.buffer = np.zeros((self.lanes, (max(map(len, words), default=0) if words else self.run_length) + 4), np.uint16)
        self.filled = np.zeros(self.lanes, np.int64)
        self.code = None
        if words is not None:
            for k, w in enumerate(words):
                self.buffer[k, : len(w)] = w
            self.code = np.zeros(self.lanes, U64)
            for k in range(4):
                self.code = (self.code << _WORD) | self.buffer[:, k]
            self.filled += 4

    def settle(self, live: int) -> None:
        """Put out or take in words until the upper bits of the intervals differ and none is too narrow."""
        low, high = self.low[:live], self.high[:live]
        who = np.flatnonzero(((low ^ high) < _UPPER) | (high - low < _NARROW))
        while len(who):
            low, high, at = self.low[who], self.high[who], self.filled[who]
            if self.code is not None:
                self.code[who] = (self.code[who] << _WORD) | self.buffer[who, np.minimum(at, self.buffer.shape[1] - 1)]
            else:
                if at.max() >= self.buffer.shape[1]:
                    self.buffer = np.concatenate([self.buffer, np.zeros_like(self.buffer)], axis=1)
                self.buffer[who, at] = low >> U64(48)
            self.filled[who] = at + 1
            high = np.where((low ^ high) < _UPPER, (high << _WORD) | U64(0xFFFF), U64((1 << 64) - 1))
            low = low << _WORD
            self.low[who], self.high[who] = low, high
            who = who[((low ^ high) < _UPPER) | (high - low < _NARROW)]

    def learn(self, sure: np.ndarray, p: np.ndarray, q: np.ndarray, choice: np.ndarray) -> None:
        """Learn the steps since the last time; weights move by the last one, towards the estimate that was closer."""
        contexts, before, choices, values = (np.concatenate(x) for x in zip(*self.seen, strict=True))
        self.seen.clear()
        self.by_sure.learn(contexts, choices)
        self.by_before.learn(before, choices)
        closer = np.where((p > q) == (choice == 0), 1, -1) * (p != q)
        moved = np.bincount(sure, weights=closer, minlength=_SURE).astype(np.int64)
        self.weight = np.clip(self.weight + np.clip(moved, -8, 8), 16, 240)
        if len(values):
            self.order0 += np.bincount(values, minlength=1 << BITS) * _GAIN
            np.cumsum(self.order0, out=self.starts[1:].view(np.int64))
            if int(self.starts[-1]) > _TOTAL:
                self.order0 = (self.order0 + 1) >> 1
                np.cumsum(self.order0, out=self.starts[1:].view(np.int64))

    def step(self, live: int, first: np.ndarray, second: np.ndarray, g2: np.ndarray, g1: np.ndarray, x: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code an id of every run; the first two distributions have these shares. Returns ids, choices, and where order 0 was it."""
        low, high = self.low[:live], self.high[:live]
        unit = (high - low) >> U64(SCALE)
        if x is None:
            code, a = self.code[:live], low + unit * first.view(U64)
            later = code >= a
            last = code >= a + unit * second.view(U64)
            x = np.where(later, g1, g2) & ((1 << BITS) - 1)
            decoding = True
        else:
            later = x != g2
            last = later & (x != g1)
            decoding = False
        rest = np.flatnonzero(last)
        ends = high[rest]
        top = (first + later * second).view(U64)
        bottom = (later * first + last * second).view(U64)
        self.high[:live] = low + unit * top - U64(1)
        self.low[:live] = low + unit * bottom
        if len(rest):
            own = self.low[rest]
            part = (ends - own) // self.starts[-1]
            if decoding:
                at = np.minimum((self.code[rest] - own) // part, self.starts[-1] - U64(1))
                x[rest] = np.searchsorted(self.starts, at, side="right") - 1
            value = x[rest]
            self.high[rest] = own + part * self.starts[value + 1] - U64(1)
            self.low[rest] = own + part * self.starts[value]
        self.settle(live)
        return x, later.astype(np.int64) + last, rest

    def run(self, ids: np.ndarray | None) -> np.ndarray:
        """Code all ids, or decode them; in order."""
        out = np.zeros((self.run_length, self.lanes), np.int64)
        if ids is not None:
            flat = np.zeros(self.lanes * self.run_length, np.int64)
            flat[: len(ids)] = ids
            out[:] = flat.reshape(self.lanes, self.run_length).T
        two, one = np.zeros(self.lanes, np.int64), np.zeros(self.lanes, np.int64)
        lives = np.searchsorted(-self.lengths, -np.arange(self.run_length)).tolist()  # runs with more than t ids
        for t, live in enumerate(lives):
            a, b = two[:live], one[:live]
            slot = ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 13) & ((1 << SLOTS) - 1)
            e2, e1 = self.order2[slot], self.order1[b]
            g2, g1, c2, c1 = e2 >> 3, e1 >> 3, e2 & 7, e1 & 7
            sure = c2 * 16 + c1 * 2 + (g1 == g2)
            before = b & ((1 << BEFORE) - 1)
            w, p, q = self.weight[sure], self.by_sure.first[sure], self.by_before.first[before]
            first = (w * (p - q) + (q << 8)) >> 8
            first = np.minimum(np.maximum(first, 1), (1 << SCALE) - 3)
            second = np.maximum((((1 << SCALE) - 1 - first) * self.by_sure.second[sure]) >> SCALE, 1)
            x, choice, rest = self.step(live, first, second, g2, g1, None if ids is None else out[t, :live])
            if ids is None:
                out[t, :live] = x
            self.seen.append((sure, before, choice, x[rest]))
            if t < _FIRST or t % _EVERY == 0:
                self.learn(sure, p, q, choice)
            entry = x << 3
            self.order2[slot] = entry | (x == g2) * _SURER[c2]
            self.order1[b] = entry | (x == g1) * _SURER[c1]
            two, one = one, np.append(x, one[live:]) if live < self.lanes else x
        return out.T.reshape(-1)


def encode_block(ids: np.ndarray) -> bytes:
    """Code ids (0 to 65,535) as a block; others are a ValueError."""
    ids = np.asarray(ids)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << BITS:
        raise ValueError(f"ids are coded in {BITS} bits")
    raw = ids.astype("<u4").tobytes()
    head = MAGIC + struct.pack("<II", len(ids), zlib.crc32(raw))
    if not len(ids):
        return head
    block = _Block(len(ids), None)
    block.run(ids)
    if block.filled.max() >= block.buffer.shape[1]:
        block.buffer = np.concatenate([block.buffer, np.zeros_like(block.buffer[:, :1])], axis=1)
    # the upper bits of the interval's end, with zeros behind them, lie in the interval
    block.buffer[np.arange(block.lanes), block.filled] = block.high >> U64(48)
    counts = block.filled + 1
    there = np.arange(block.buffer.shape[1])[None, :] < counts[:, None]
    return head + counts.astype("<u2").tobytes() + block.buffer[there].astype("<u2").tobytes()


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a coded block, as little-endian 32-bit integers; a block whose checksum fails is a ValueError."""
    if len(block) < 12 or block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, crc = struct.unpack("<II", block[4:12])
    ids = np.zeros(0, "<u4")
    if n:
        lanes = max(1, min(LANES, -(-n // RUN)))
        counts = np.frombuffer(block[12 : 12 + 2 * lanes], "<u2").astype(np.int64)
        body = block[12 + 2 * lanes :]
        if len(counts) < lanes or len(body) != 2 * int(counts.sum()):
            raise ValueError("a block of token ids has lost a part")
        words = np.split(np.frombuffer(body, "<u2"), np.cumsum(counts)[:-1])
        with np.errstate(all="ignore"):
            ids = _Block(n, words).run(None)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block of token ids fails its checksum")
    return ids
