"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, scheme marks and identifier cues.
Deterministic parsers then expand from an anchor to the boundaries of what it may be part of, and validate it. There is
no search outside the surroundings of anchors.

Base kinds, each leftmost and non-overlapping by itself: ``email``, ``ip``, ``card``, ``phone``. A candidate that fails
its validation is dropped and not retried. Added kinds: ``url`` (a URL that carries a user or password), ``iban`` (mod 97)
and ``account`` (an identifier of at least six digits behind a cue such as "account number"). They never replace a base
span.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import in_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "customer id", "tax id")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_URL = re.compile(r"[^\s<>\"'@/]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"']*)?")
_AFTER_CUE = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|id|is|code|#|:|=))*\s*([A-Za-z0-9](?:[ -]?[A-Za-z0-9])*)", re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"[A-Z]{0,3}[ -]?[0-9](?:[ -]?[0-9]){5,19}(?![0-9A-Za-z])")


def _automaton() -> ahocorasick.Automaton:
    trie = ahocorasick.Automaton()
    for c in "0123456789":
        trie.add_word(c, ("digit", 1))
    trie.add_word("@", ("at", 1))
    trie.add_word("+", ("plus", 1))
    trie.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.title(), cue.upper()):
            trie.add_word(form, ("cue", len(form)))
    trie.make_automaton()
    return trie


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether the check digits of an IBAN hold."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str, signs: list[int]) -> Iterator[tuple[int, int]]:
    free = 0
    for at in signs:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of digits."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        else:
            out.append((p, p + 1))
    return out


def _chains(text: str, runs: list[tuple[int, int]], joints: str) -> Iterator[list[tuple[int, int]]]:
    """Runs that single joint characters hold together."""
    chain: list[tuple[int, int]] = []
    for run in runs:
        if chain and not (run[0] == chain[-1][1] + 1 and text[run[0] - 1] in joints):
            yield chain
            chain = []
        chain.append(run)
    if chain:
        yield chain


def _ips(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in _chains(text, runs, "."):
        for k in range(0, len(chain) - 3, 4):
            four = chain[k : k + 4]
            if all(len(part := text[a:b].lstrip("0")) <= 3 and int(part or "0") <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in _chains(text, runs, " -"):
        if 16 <= sum(b - a for a, b in chain) <= 19 and luhn("".join(text[a:b] for a, b in chain)):
            yield chain[0][0], chain[-1][1]


def _phones(text: str, signs: list[int]) -> Iterator[tuple[int, int]]:
    for at in signs:
        if found := _PHONE.match(text, at):
            end = found.end()
            while text[end - 1] not in "0123456789":
                end -= 1
            if end - at >= 4 and 8 <= sum(c.isdigit() for c in text[at:end]) <= 15:
                yield at, end


def _urls(text: str, marks: list[int]) -> Iterator[tuple[int, int]]:
    free = 0
    for at in marks:
        start = at
        while start > free and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
            start -= 1
        if start < at and text[start].isalpha() and (rest := _URL.match(text, at + 3)):
            free = start + len(text[start : rest.end()].rstrip(".,;:!?)"))
            yield start, free


def _identifiers(text: str, ends: list[int]) -> Iterator[tuple[str, int, int]]:
    free = 0
    for end in ends:
        found = _AFTER_CUE.match(text, end)
        if not found or found.start(1) < free or found.start(1) == end:
            continue
        start = found.start(1)
        if (iban := _IBAN.match(text, start)) and mod97(iban[0]):
            free = iban.end()
            yield "iban", start, free
        elif account := _ACCOUNT.match(text, start):
            free = account.end()
            yield "account", start, free


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, as code points with the end exclusive; null text has none."""
    text = text or ""
    anchors: dict[str, list[int]] = defaultdict(list)
    for last, (what, length) in _ANCHORS.iter(text):
        anchors[what].append(last + 1 if what == "cue" else last + 1 - length)
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if not anchors:
        return spans
    runs = _runs(anchors["digit"])
    spans["email"] += _emails(text, anchors["at"])
    spans["ip"] += _ips(text, runs)
    spans["card"] += _cards(text, runs)
    spans["phone"] += _phones(text, anchors["plus"])
    spans["url"] += _urls(text, anchors["scheme"])
    for kind, start, end in _identifiers(text, anchors["cue"]):
        spans[kind].append((start, end))
    return spans


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans[k]))


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, own in spans.items() for a, b in own):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Whole texts; null counts as empty and has no spans; null and repeated doc_ids keep their rows; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                spans = find(text)
                rows.append((*(len(spans[k]) for k in BASE), hashlib.sha256(listed(spans, BASE).encode()).hexdigest(), listed(spans)))
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"]).assign(doc_id=pdf["doc_id"].astype("Int64"))

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, run, schema)
