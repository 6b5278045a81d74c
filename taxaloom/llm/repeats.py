"""Removal of long repeated byte strings, decided by a run-length index of a run-compressed Burrows-Wheeler transform.

A corpus is too large for one index, so windows (all strings of the wanted width) are dealt to indexes by content. Every
window has an anchor, the leftmost smallest hash of its short substrings, and falls into one of a few fixed ranges of
offset to it; windows of a range share a core of bytes around the anchor. Equal windows have equal anchors, offsets and
cores, so they have the same core hash, and meet in one index. A run of windows of one text with one core is a segment;
segments with one core that follow each other, as periodic text makes them, are one. Every window lies in exactly one
segment, so a match between two places of an index is a match between two places of the corpus. Cores that occur once are
left out. Of segments that are equal only one is indexed, with its count.

The indexes (``runindex``) find which windows have a match: matching statistics of at least the width. A core whose different
segments are too much for one index is dealt again, as a corpus of its own, into narrower ranges of offset, which share
longer cores; in the last level a range is one offset, a core is the whole window, and equal segments are all there is to
find. So no group has to fit into a task and no pairs of groups are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import bloom
from .rows import in_batches
from .runindex import repeated_starts

#: Bytes of an anchor, and ranges of offset at each level; None stands for a range an offset.
ANCHOR, LEVELS = 64, (2, 8, 32, 128, None)
#: Bytes of text hashed at once, and windows of a segment of periodic text (about).
STRETCH, PIECE = 1 << 20, 8192
#: Bytes an index should hold, and of different segments of one core in it; a worker takes about 150 bytes for a byte of index.
SHARD, CROWD = 1 << 20, 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def _hashes(text: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes (mod 2 ** 64) of all substrings of each width, by doubling and joining of halves."""
    h = text.astype(np.uint64) + np.uint64(1)
    level, power = 1, np.uint64(_BASE)
    out: dict[int, tuple[np.ndarray, np.uint64]] = {}
    with np.errstate(over="ignore"):
        while True:
            for w in widths:
                if w & level:
                    if w in out:
                        done, p = out[w]
                        width = w & (level - 1)
                        n = len(text) - width - level + 1
                        out[w] = (h[: max(n, 0)] * p + done[level : level + max(n, 0)], p * power) if n > 0 else (np.zeros(0, np.uint64), p)
                    else:
                        out[w] = (h, power)
            if level * 2 > max(widths) or len(h) <= level:
                break
            h = h[:-level] * power + h[level:]
            power = power * power
            level *= 2
    return {w: out[w][0] if w in out and len(text) >= w else np.zeros(0, np.uint64) for w in widths}


def _scrambled(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _segments(text: np.ndarray, width: int, ranges: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First window and core hash of every segment of a text that has a window."""
    n = len(text) - width + 1
    anchor = min(ANCHOR, max(1, width // 2))
    span = width - anchor + 1  # places of an anchor in a window
    step = -(-span // (ranges or span))
    core = width - step + 1
    found = _hashes(text, [anchor, core])
    # smallest hash of every window, the leftmost of equals: the place is put below the hash
    half = np.uint64(32)
    least = (_scrambled(found[anchor]) >> half << half) | np.arange(len(found[anchor]), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    place = (least[:n] & np.uint64((1 << 32) - 1)).astype(np.int64)
    part = (place - np.arange(n)) // step
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])]))
    # the core of a range: the bytes that all its windows share, from the last possible start on
    at = place[first] - part[first] * step
    key = _scrambled(found[core][np.minimum(at, len(found[core]) - 1)] + part[first].astype(np.uint64))
    return first, key.view(np.int64)


def segments(text: np.ndarray, width: int, ranges: int | None = LEVELS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, core hash and number of plain segments of every segment of a text."""
    n = len(text) - width + 1
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for low in range(0, n, STRETCH):
        first, key = _segments(text[low : min(low + STRETCH, n) + width - 1], width, ranges)
        parts.append((first + low, key))
    first, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(first) or not ranges:  # where a segment is one window, equal ones are told by their digests
        return first, np.append(first[1:], n)[: len(first)] - 1, key, np.ones(len(first), np.int64)
    # periodic text: one core again and again; pieces begin where a plain segment does, so most of them are equal
    run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    begin = first[np.flatnonzero(np.r_[True, key[1:] != key[:-1]])]
    piece = (first - begin[run]) // PIECE
    new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (piece[1:] != piece[:-1])])
    return first[new], np.append(first[new[1:]], n) - 1, key[new], np.diff(np.append(new, len(first)))


def _text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _bytes(text: str | bytes | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text or b"")


_SEGMENTS = "tk binary, a int, b int, key long, times int"


def _cut(width: int, ranges: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tks, parts, size = [], [], 0

            def made() -> pd.DataFrame:
                counts = [len(p[0]) for p in parts]
                a, b, key, times = (np.concatenate([p[k] for p in parts]) for k in range(4))
                return pd.DataFrame({"tk": np.repeat(np.array([*tks, None], object)[:-1], counts), "a": a.astype(np.int32), "b": b.astype(np.int32), "key": key, "times": times.astype(np.int32)})

            for tk, text in zip(pdf["tk"], pdf["text"], strict=True):
                own = segments(np.frombuffer(_bytes(text), np.uint8), width, ranges)
                if len(own[0]):
                    tks.append(tk)
                    parts.append(own)
                    size += len(own[0])
                if size > 50_000:
                    yield made()
                    tks, parts, size = [], [], 0
            if parts:
                yield made()

    return run


_MEMBERS = ["tk", "a", "size", "copies", "key", "times", "digest", "body"]


def _extract(width: int, whole: bool):
    """Bytes of the listed segments of each text (if ``whole``), with a digest that tells different ones apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for tk, text, copies, own in zip(pdf["tk"], pdf["text"], pdf["copies"], pdf["own"], strict=True):
                data = _bytes(text)
                for s in own:
                    body = data[s["a"] : s["b"] + width]
                    rows.append((tk, s["a"], len(body), copies, s["key"], s["times"], hashlib.blake2b(body, digest_size=16).digest(), body if whole else b""))
                    size += len(body) if whole else 100
                    if size > 1 << 23:
                        yield pd.DataFrame(rows, columns=_MEMBERS)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=_MEMBERS)

    return run


def _match(width: int):
    """Windows of the segments of an index that have a match in it, as ranges [first, last] of offsets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for digest, key, places in zip(pdf["digest"], pdf["key"], repeated_starts(list(pdf["body"]), width), strict=True):
            if len(places):
                breaks = np.flatnonzero(np.diff(places) > 1)
                rows.append((key, digest, places[np.append(0, breaks + 1)].tolist(), places[np.append(breaks, len(places) - 1)].tolist()))
        return pd.DataFrame(rows, columns=["key", "digest", "firsts", "lasts"])

    return run


def _spans(texts: DataFrame, width: int, level: int) -> DataFrame:
    """``texts`` (tk: key of a text, text: string or binary; copies have one key) -> tk, spans of window ranges (x, y)."""
    ranges, last = LEVELS[level], level == len(LEVELS) - 1
    cut = stored(texts.where(F.octet_length("text") >= width).transform(in_batches, _cut(width, ranges), _SEGMENTS), "repeat-segments")
    shared = stored(cut.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key"), "repeat-cores")
    passes = bloom.member(shared.select(F.col("key").alias("h")), shared.count())
    # repeats (copies of a text) are left to the sets: a distinct would be planned on the join's key and keep AQE from splitting hot cores
    suspects = cut.where(passes("key")).join(shared.hint("merge"), "key", "left_semi")
    own = stored(suspects.groupBy("tk").agg(F.collect_set(F.struct("a", "b", "key", "times")).alias("own")), "repeat-suspects")
    wanted = own.select(F.xxhash64("tk").alias("h"))
    passes = bloom.member(wanted, own.count())
    bodies = texts.where(passes(F.xxhash64("tk"))).groupBy("tk").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    members = bodies.join(own.hint("merge"), "tk").transform(in_batches, _extract(width, not last), "tk binary, a int, size int, copies long, key long, times int, digest binary, body binary")
    members = stored(members, "repeat-members")
    different = members.groupBy("key", "digest").agg(F.sum("copies").alias("copies"), F.first("body").alias("body"), F.first("size").alias("size"), F.max("times").alias("times"))
    different = stored(different, "repeat-bodies")
    # equal segments: all their windows match
    found = different.where("copies > 1").select("key", "digest", F.array(F.lit(0)).alias("firsts"), F.array(F.col("size") - width).alias("lasts"))
    if not last:
        cores = different.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("times").alias("times")).where("n > 1 or times > 1")
        cores = stored(cores.select("key", "bytes", (F.col("bytes") > CROWD).alias("crowd")), "repeat-crowds")
        total = cores.where("not crowd").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        shards = max(1, -(-int(total) // SHARD))
        met = different.join(cores.select("key", "crowd").hint("merge"), "key")
        indexed = met.where("not crowd").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("index"), "key", "digest", "body")
        # indexes are dealt by number, not by bytes: what is repeated compresses well and would be put together
        tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        indexed = indexed.repartition(max(tasks, min(shards, 8 * tasks)), "index").groupBy("index")
        found = found.unionByName(indexed.applyInPandas(_match(width), "key long, digest binary, firsts array<int>, lasts array<int>"))
        if not cores.where("crowd").isEmpty():
            crowd = stored(met.where("crowd").select("key", "digest", "body"), "repeat-crowd")
            inner = _spans(crowd.select(F.col("digest").alias("tk"), F.col("body").alias("text")), width, level + 1)
            inner = crowd.select("key", "digest").join(inner, F.col("digest") == F.col("tk"))
            found = found.unionByName(inner.select("key", "digest", F.col("spans.x").alias("firsts"), F.col("spans.y").alias("lasts")))
    found = stored(found, "repeat-found")
    marked = members.select("tk", "a", "key", "digest").join(found.hint("merge"), ["key", "digest"])
    both = F.arrays_zip(F.transform("firsts", lambda x: x + F.col("a")).alias("x"), F.transform("lasts", lambda x: x + F.col("a")).alias("y"))
    return marked.select("tk", both.alias("r")).groupBy("tk").agg(F.flatten(F.collect_list("r")).alias("spans"))


def matches(docs: DataFrame, width: int = 400) -> DataFrame:
    """``docs`` (text) -> tk (key of a distinct text), spans: array of structs of window ranges (first, last), by index."""
    return _spans(docs.select(_text_key(F.col("text")).alias("tk"), "text"), width, 0)


def covered(spans, width: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the windows of these ranges cover."""
    out: list[tuple[int, int]] = []
    for x, y in sorted((int(s[0]), int(s[1])) for s in spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y + width))
        else:
            out.append((x, y + width))
    return out


def _clean(width: int, with_kept: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                runs = covered([(s["x"], s["y"]) for s in spans], width) if spans is not None else []
                at, kept = 0, []
                for x, y in runs:
                    kept.append(data[at:x])
                    at = y
                body = b"".join([*kept, data[at:]])
                flat = [int(v) for r in runs for v in r]
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(data), len(data) - len(body), len(runs), hashlib.sha256(body).hexdigest(), flat, body))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])
            yield (frame if with_kept else frame.drop(columns="kept")).astype({"doc_id": "Int64"})

    return run


def remove_repeats(docs: DataFrame, width: int = 400, with_kept: bool = True) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text), texts as UTF-8 bytes.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, removed (starts and ends of the runs)
    and, if asked for, kept (the bytes left). A byte is removed if a string of ``width`` bytes that covers it also starts anywhere else in
    the corpus, the same text included; matches lie within one document. Null counts as empty; copies of a text, repeated
    rows included, match each other whole; null doc_ids keep their rows; an empty table gives an empty result; other
    columns are not read.
    """
    marks = stored(matches(docs, width), "repeat-marks")
    passes = bloom.member(marks.select(F.xxhash64("tk").alias("h")), marks.count())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tk", _text_key(F.col("text")))
    hit = passes(F.xxhash64("tk"))
    touched = rows.where(hit).join(marks.hint("merge"), "tk", "left").select("doc_id", "text", "spans")
    rest = rows.where(~hit).select("doc_id", "text", F.lit(None).cast("array<struct<x:int,y:int>>").alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>" + ", kept binary" * with_kept
    return touched.unionByName(rest).transform(in_batches, _clean(width, with_kept), schema)
