"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A piece (what the pre-tokeniser hands to the merges) is scanned once by an Aho-Corasick automaton of all tokens, which
gives the tokens that start at each place. The encoder takes the longest one that may follow the token before it, goes on
behind it, and steps back where nothing fits; places once found to be dead ends are not tried again, so the work is linear
in the piece. Whether two tokens may stand side by side is read from a table of pairs: undoing the merges of both in turn,
no pair that meets at the border may have a merge of lower rank than those undone. The result is exactly that of applying
the merges in order of rank.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .rows import in_batches

#: Stands for the end-of-word suffix behind the last character of a piece.
END = "\ue000"
#: Pieces a worker remembers in each of two generations; when the young one is full, it becomes the old one.
CACHE = 200_000
#: Ids that a worker hands on at once.
HANDED = 500_000
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
BYTES_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def _patterns(letter: str = r"\p{L}", number: str = r"\p{N}") -> tuple[regex.Pattern, regex.Pattern]:
    """The pre-tokeniser's patterns for words and for bytes, given the members of the classes of letters and numbers."""
    words = rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACES}{letter}{number}]+"
    return regex.compile(words), regex.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACES}{letter}{number}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


SPLIT, BYTES = _patterns()


def _latin(letter: str, number: str) -> tuple[re.Pattern, re.Pattern]:
    """The same for texts of Latin-1 alone, which are cut faster by classes written out."""
    spaces = "".join(c for c in map(chr, range(256)) if regex.match(f"[{SPACES}]", c))
    escaped = "".join(rf"\x{ord(c):02x}" for c in spaces)
    words = rf"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{escaped}{letter}{number}]+"
    return re.compile(words), re.compile(rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{escaped}{letter}{number}]+|[{escaped}]+(?![^{escaped}])|[{escaped}]+")


def in_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _members(places: set[int]) -> str:
    """A set of code points as the inside of a character class."""
    out, run = [], []
    for c in [*sorted(places), -1]:
        if run and c != run[-1] + 1:
            out.append(rf"\U{run[0]:08x}-\U{run[-1]:08x}")
            run = []
        run.append(c)
    return "".join(out)


class _Odd:
    """Code points that the library's Unicode tables class or lower-case unlike those of Python and ``regex``.

    Such tables differ by version only in characters that the older one does not know. Texts that hold one are cut by
    patterns with the library's own classes; all others by the plain ones.
    """

    def __init__(self) -> None:
        every = [c for c in range(0x80, 0x40000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, every))
        theirs, ours = {}, {}
        for name in ("L", "N"):
            split = pre_tokenizers.Split(Regex(rf"\p{{{name}}}+"), "removed", invert=True)
            theirs[name] = {ord(c) for piece, _ in split.pre_tokenize_str(text) for c in piece}
            ours[name] = set(map(ord, regex.findall(rf"\p{{{name}}}", text)))
        lower = normalizers.Lowercase()
        new = [c for c in every if unicodedata.category(chr(c)) == "Cn"]
        self.lower = {c: low for c in new if (low := lower.normalize_str(chr(c))) != chr(c)}
        low = {name: _members({c for c in range(256) if regex.match(rf"\p{{{name}}}", chr(c))}) for name in ("L", "N")}
        self.latin_split, self.latin_bytes = _latin(low["L"], low["N"])
        odd = (theirs["L"] ^ ours["L"]) | (theirs["N"] ^ ours["N"]) | set(self.lower)
        self.latin = not any(c < 256 for c in odd)  # all tables agree on Latin-1
        self.search = regex.compile(f"[{_members(odd)}]").search if odd else lambda text: None
        self.split, self.bytes = _patterns("A-Za-z" + _members(theirs["L"]), "0-9" + _members(theirs["N"])) if odd else (SPLIT, BYTES)


@lru_cache(maxsize=1)
def odd() -> _Odd:
    return _Odd()


def byte_pieces(text: str) -> list[str]:
    """Pre-tokens of the byte-level pattern; joined they are the text."""
    if text.isascii():
        return BYTES_ASCII.findall(text)
    if odd().latin and in_latin(text):
        return odd().latin_bytes.findall(text)
    return (odd().bytes if odd().search(text) else BYTES).findall(text)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of the tokenizers library: byte-level BPE, with or without an end-of-word suffix."""

    remembered = CACHE

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["normalizer"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words = steps is not None  # normalises, and drops white space
        alphabet = byte_alphabet()
        self.bytes = {b: c for b, c in enumerate(alphabet)}
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = 1 + max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"]))
        self.left, self.right = list(range(size)), list(range(size))
        self.rank = [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs[a, b] = whole
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = a, b, rank
        self.trie = ahocorasick.Automaton()
        strings = [""] * size
        for token, number in vocab.items():
            strings[number] = token
            shown = token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token
            if self.rank[number] >= 0 or len(shown.rstrip(END)) == 1:
                self.trie.add_word(shown, (number, len(shown)))
        self.trie.make_automaton()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, number in self.added.items():
            strings[number] = content
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # the offset table of decoding: where each token's bytes begin, and how many there are
        back = {c: b for b, c in enumerate(alphabet)}
        if spec["decoder"] is None:  # tokens as they are, joined by spaces
            parts = [f"{s} ".encode() for s in strings]
        else:
            parts = [s.encode() if s in self.added else bytes(back[c] for c in s) for s in strings]
        self.joined = spec["decoder"] is None
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave token ``a`` and token ``b`` side by side."""
        limit = len(self.pairs) + len(self.rank)
        rank, pairs = self.rank, self.pairs
        while True:
            whole = pairs.get((a, b))
            if whole is not None and rank[whole] < limit:
                return False
            # undo the later of the two; on the left side a merge of equal rank would still come first
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece of text."""
        shown = "".join(map(self.bytes.__getitem__, piece.encode("utf-8", "surrogatepass"))) + (END if self.suffix else "")
        starts: list[list[tuple[int, int]]] = [[] for _ in shown]
        for last, (number, length) in self.trie.iter(shown):
            starts[last - length + 1].append((last + 1, number))
        fits, end = self.fits, len(shown)
        tokens: list[int] = []
        trail: list[tuple[int, int]] = []  # place and choice of each token taken
        dead = bytearray(end + 1)
        at, choice = 0, len(starts[0]) - 1
        while at < end:
            options = starts[at]
            while choice >= 0:
                to, number = options[choice]
                if not dead[to] and (not tokens or fits(tokens[-1], number)):
                    break
                choice -= 1
            if choice >= 0:
                tokens.append(number)
                trail.append((at, choice))
                at = to
                choice = len(starts[at]) - 1 if at < end else 0
            else:
                if not trail:
                    raise ValueError("a piece that no tokens cover")
                dead[at] = 1
                tokens.pop()
                at, choice = trail.pop()
                choice -= 1
        return tokens

    def pieces(self, text: str) -> list[str]:
        """What the normaliser and the pre-tokeniser make of a text without added tokens."""
        if not self.words:
            return byte_pieces(text)
        if text.isascii():
            return SPLIT_ASCII.findall(text.lower())
        if odd().latin and in_latin(text):  # Latin-1 is its own normal form
            return odd().latin_split.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if odd().search(text):
            return odd().split.findall(text.translate(odd().lower))
        return SPLIT.findall(text)

    def packed(self, piece: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers, remembered."""
        got = self.cache.get(piece)
        if got is None:
            got = self.older.get(piece) or struct.pack(f"<{len(ids := self.encode_piece(piece))}I", *ids)
            if len(piece) <= 64:
                self.cache[piece] = got
                if len(self.cache) >= self.remembered:
                    self.older, self.cache = self.cache, {}
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; null is empty. Added tokens in the text are found first, as the library does."""
        text, packed, known = text or "", self.packed, self.cache.get
        out: list[bytes] = []

        def take(pieces: list[str]) -> None:
            got = list(map(known, pieces))
            out.extend(got if None not in got else [g or packed(p) for g, p in zip(got, pieces, strict=True)])

        at = 0
        for found in self.special.finditer(text) if self.special else ():
            take(self.pieces(text[at : found.start()]))
            out.append(np.array([self.added[found[0]]], "<u4").tobytes())
            at = found.end()
        take(self.pieces(text[at:] if at else text))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included, gathered through the offset table."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return ""
        take = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        data = self.blob[take].tobytes()
        return (data[:-1] if self.joined else data).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once a worker."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids (array of int), decoded: a row for every row, whole texts.

    Null text counts as empty and has no ids; null and repeated doc_ids keep their rows; an empty table gives an empty
    result; other columns are not read. ``path`` names a tokenizer file that every worker can open.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = vocabulary(path)
        for pdf in batches:
            ids, size, at = [], 0, 0
            for k, text in enumerate(pdf["text"], 1):
                ids.append(own.encode(text))
                size += len(ids[-1])
                if size >= HANDED or k == len(pdf):
                    yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at:k].astype("Int64"), "ids": [x.astype(np.int32) for x in ids], "decoded": [own.decode(x) for x in ids]})
                    ids, size, at = [], 0, k

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, with digests for ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = vocabulary(path)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ids = own.encode(text)
                decoded = own.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=pdf["doc_id"].astype("Int64"))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, run, schema)
