"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most two bits share at least six of their eight positional bytes: that is the
guaranteed minimum of the count filter. Lists of single bytes would each hold a 256th of the corpus, and tallying their
pairs grows with its square. So positions are taken in twos, of which such a pair shares two of four at least, and the
index has a list for every choice of two of the four and their four bytes. Pairs that meet in a list are tallied over all
eight positions; those that reach the minimum are verified bit by bit. A list that is long is split first: its fingerprints
go to lists of two more positions each, where the tally has reached the minimum already. Those fix 48 bits and so have at
most 65,536 distinct fingerprints, whatever the input. A list reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import rows as rows_
from .components import components
from .rows import in_batches

#: Shingle hashes that are turned to bits at once, which bounds memory for very long texts.
BLOCK = 65_536
#: Choices of two of the four twos of positions, and of two positions to leave free.
TWOS, FREE = list(combinations(range(4), 2)), list(combinations(range(8), 2))
#: Fingerprints of a list above which it is split, and rows of a table of such lists that may be broadcast.
LONG, SMALL = 256, 100_000


def fingerprint(text: str | None, words: int = 3, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """SimHash of the word shingles of ``text``, 64 bits a seed; 0 where it has no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return [0] * len(seeds)
    shingles = [b" ".join(parts)] if len(parts) <= words else [*map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False))]
    digest, out = xxhash.xxh64_intdigest, []
    for seed in seeds:
        hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), BLOCK):
            block = hashes[at : at + BLOCK]
            ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), h (of the text) for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, words)[0] for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps, "h": pdf["h"]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").transform(in_batches, run, "doc_id long, fp long, h long")


def _near_masks(bits: int) -> np.ndarray:
    """All non-zero 16-bit patterns of at most ``bits`` ones."""
    every = np.arange(1, 1 << 16)
    return every[np.bitwise_count(every) <= bits]


def spanning(n: int, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs of places below ``n`` that connect what was not connected yet."""
    root = list(range(n))
    out = []
    for x, y in pairs:
        s, t = x, y
        while root[s] != s:
            root[s] = s = root[root[s]]
        while root[t] != t:
            root[t] = t = root[root[t]]
        if s != t:
            root[max(s, t)] = min(s, t)
            out.append((x, y))
    return out


def tallied(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest of a list: positional bytes that each pair shares are counted, enough of them verified by their bits."""
    differ = fps[:, None] ^ fps[None, :]
    shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2)
    a, b = np.nonzero(np.triu(shared >= 8 - bits, 1))
    near = np.bitwise_count(differ[a, b]) <= bits
    return spanning(len(fps), zip(a[near].tolist(), b[near].tolist(), strict=True))


def forest(codes: np.ndarray, bits: int, masks: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (pairs of places) of the distinct 16-bit ``codes`` that differ in at most ``bits`` bits."""
    n = len(codes)
    place = np.full(1 << 16, -1, np.int64)
    place[codes] = np.arange(n)
    found = [(np.flatnonzero(m := place[codes ^ x] > np.arange(n)), place[codes ^ x][m]) for x in masks]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (codes[:0], codes[:0])
    return spanning(n, zip(a.tolist(), b.tolist(), strict=True))


def _lists(bits: int):
    masks = _near_masks(bits)

    def links(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        """Links within the whole lists of these sorted postings."""
        starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        two = starts[sizes == 2]
        u = fp.view(np.uint64)
        differ = u[two] ^ u[two + 1]
        enough = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - bits
        ok = enough & (np.bitwise_count(differ) <= bits)
        pairs = [np.stack([fp[two[ok]], fp[two[ok] + 1]], axis=1)]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            own = u[at : at + n]
            if choice[at] < len(TWOS) or n <= 64:
                edges = tallied(own, bits)
            else:
                p, q = FREE[choice[at] - len(TWOS)]
                codes = ((own >> np.uint64(8 * p)) & np.uint64(255)) | (((own >> np.uint64(8 * q)) & np.uint64(255)) << np.uint64(8))
                edges = forest(codes.astype(np.int64), bits, masks)
            if edges:
                pairs.append(fp[at + np.array(edges)])
        every = np.concatenate(pairs)
        return pd.DataFrame({"a": every[:, 0], "b": every[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # postings of the list that the last batch ended in
        for pdf in batches:
            now = [pdf["choice"].to_numpy(np.int64), pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)]
            if not len(now[0]):
                continue
            if held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            change = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = change[-1] + 1 if len(change) else 0
            held = [x[cut:] for x in now]
            if cut:
                yield links(*(x[:cut] for x in now))
        if held:
            yield links(*held)

    return run


def _keeping(positions: Iterable[int]) -> int:
    """A mask of these bytes as a signed long."""
    return int(np.uint64(sum(255 << (8 * p) for p in positions)).view(np.int64))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """``fps`` (fp: distinct longs) -> a, b: links that connect all fingerprints at ``bits`` (0 to 2) or fewer bits."""
    if not 0 <= bits <= 2:
        raise ValueError("six shared bytes are guaranteed for at most two differing bits")
    fixed = [{p for two in choice for p in (2 * two, 2 * two + 1)} for choice in TWOS]
    entry = lambda k, keep: F.struct(F.lit(k).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(_keeping(keep))).alias("key"))
    postings = fps.select("fp", F.explode(F.array(*(entry(k, keep) for k, keep in enumerate(fixed)))).alias("x")).select("x.choice", "x.key", "fp")
    long_ = stored(postings.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("choice", "key"), "simhash-long")
    long_ = F.broadcast(long_) if long_.count() <= SMALL else long_.hint("merge")
    short = postings.join(long_, ["choice", "key"], "left_anti").select("choice", "key", "fp")
    finer = F.lit(None)
    for k, keep in enumerate(fixed):
        free = [(j, pair) for j, pair in enumerate(FREE) if not keep & set(pair)]
        finer = F.when(F.col("choice") == k, F.array(*(entry(len(TWOS) + j, set(range(8)) - set(pair)) for j, pair in free))).otherwise(finer)
    split = postings.join(long_, ["choice", "key"], "left_semi").select("fp", F.explode(finer).alias("x")).select("x.choice", "x.key", "fp").distinct()
    listed = short.unionByName(split).repartition("choice", "key").sortWithinPartitions("choice", "key")
    return listed.transform(in_batches, _lists(bits), "a long, b long")


def _rooted(classes: DataFrame, bits: int) -> DataFrame:
    """``classes`` (fp: distinct, ...) with root: the same for all fingerprints that links connect."""
    reach = stored(components(links(classes.select("fp"), bits)), "simhash-reach")
    return classes.join(reach, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that is reachable over links of ``bits`` or fewer differing bits. Copies are one
    class: only distinct fingerprints are indexed. Texts without a word have fingerprint 0 and are linked like any other;
    null text counts as empty; a null doc_id is kept and belongs to its class (whose id is null if no member has one);
    repeated rows stay; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = stored(fingerprints(docs, words).drop("h"), "simhash-rows")
    rooted = _rooted(stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes"), bits)
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(rooted.join(lows, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the smallest doc_id of each of the ``near_groups``.

    A null doc_id stays only if its group has no other; of repeated rows one stays.
    """
    rows = stored(fingerprints(docs, words), "simhash-rows")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    classes = stored(rows.groupBy("fp").agg(F.min(own).alias("first")), "simhash-classes")
    stays = stored(_rooted(classes, bits).groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.h"), "simhash-first")
    return _kept(docs, stays, rows.select(F.col("doc_id").alias("id"), "h"))


def _kept(docs: DataFrame, stays: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (id, h) are in ``stays``, one of each; ``rows`` has those of all."""
    per = rows.groupBy("id", "h").agg(F.count("*").alias("n")).alias("per")
    keys = stays.alias("s").join(per, F.col("s.id").eqNullSafe(F.col("per.id")) & (F.col("s.h") == F.col("per.h")))
    return rows_.keep(docs, keys.select("s.id", "s.h", F.lit(1).cast("long").alias("stay"), "per.n"))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of ``text`` as sorted 64-bit hashes; a shorter text is one shingle, one without a word has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    out = np.full(len(each) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ each[k : len(each) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest (pairs of places) of the sets whose Jaccard similarity is ``similarity`` or more."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    known, place, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1  # a shingle of one set is in no intersection
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(m), sizes)[shared[place]]
    column = column[place[shared[place]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((m, m), np.float64)
    step = max(1, (1 << 22) // m)
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (low, low + step))
        there = np.zeros((m, step), np.float32)
        there[owner[a:b], column[a:b] - low] = 1
        both += there @ there.T
    union = sizes[:, None] + sizes[None, :] - both
    return spanning(m, zip(*(k.tolist() for k in np.nonzero(np.triu(both / np.maximum(union, 1) >= similarity, 1))), strict=True))


def _verified(words: int, similarity: float):
    """Links (a, b: nodes) of the texts in each block pair of a group, by all their distinct shingles."""

    def links(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, own in pdf.groupby(["grp", "low", "high"], sort=False):
            own = own.drop_duplicates("node")
            if len(own) > 1:
                node = own["node"].to_numpy(np.int64)
                if found := similar([shingles(t, words) for t in own["text"]], similarity):
                    yield pd.DataFrame(node[np.array(found)], columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            now = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = now.iloc[-1]
            same = ((now["grp"] == last["grp"]) & (now["low"] == last["low"]) & (now["high"] == last["high"])).to_numpy()
            held = now[same]
            yield from links(now[~same])
        if held is not None:
            yield from links(held)

    return run


#: Texts, and shingles, of a block of a group of candidates; a task compares two blocks.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1_000_000


def _links_within(docs: DataFrame, own: DataFrame, groups: DataFrame, words: int, similarity: float) -> DataFrame:
    """``groups`` (node, grp) of candidates -> a, b: links that connect all of a group that are as similar.

    ``own`` has id, h (of the text), node and size of every row. A group above a block is cut into blocks. First each block
    is compared within itself and with two pivots of the group, which is linear and links what is alike. Texts that are then
    outside of the largest part of their group are compared with all blocks; pairs inside it need no more links. So every
    pair is either compared or connected already, and no group has to fit into one task.
    """
    nodes = own.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("one"), F.first("size").alias("size"))
    nodes = stored(nodes.join(groups, "node").select("node", "grp", "size", F.col("one.id").alias("one_id"), F.col("one.h").alias("one_h")), "near-nodes")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    mark = F.xxhash64("node")
    tally = nodes.groupBy("grp").agg(F.count("*").alias("m"), blocks(F.count("*"), F.sum("size")).alias("parts"), F.min_by("node", mark).alias("p"), F.max_by("node", mark).alias("q")).where("m > 1")
    tally = stored(tally.drop("m"), "near-tally")
    wanted = stored(nodes.join(tally, "grp").select("node", "grp", "size", "parts", F.col("node").isin(F.col("p"), F.col("q")).alias("pivot"), "one_id", "one_h"), "near-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    found = texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("one_id")) & (F.col("h") == F.col("one_h")))
    found = stored(found.select("node", "grp", "size", "parts", "pivot", "text"), "near-texts")
    block = F.pmod(mark, F.col("parts")).cast("int")

    def compared(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("grp", "low", "high", "node", "text").repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")
        return dealt.transform(in_batches, _verified(words, similarity), "a long, b long")

    every = F.sequence(F.lit(0), F.col("parts") - 1)
    first = found.select("*", F.explode(F.when(F.col("pivot"), every).otherwise(F.array(block))).alias("low")).withColumn("high", F.lit(-1))
    links = stored(compared(first), "near-links-first")
    large = found.where("parts > 1")
    if large.isEmpty():
        return links
    reach = stored(components(links), "near-linked").toDF("at", "root")
    parted = large.drop("text").join(reach, F.col("node") == F.col("at"), "left").withColumn("part", F.coalesce("root", "node"))
    sizes = parted.groupBy("grp", "part").agg(F.count("*").alias("k"), F.sum("size").alias("bytes"))
    most = sizes.groupBy("grp").agg(F.max_by("part", F.struct("k", "part")).alias("largest"))
    outside = sizes.join(most, "grp").where("part <> largest").groupBy("grp").agg(blocks(F.sum("k"), F.sum("bytes")).alias("outer"))
    outside = stored(outside.join(most, "grp"), "near-outside")
    if outside.isEmpty():
        return links
    rest = parted.select("grp", "node", "part").join(outside, "grp").select("grp", "node", "outer", (F.col("part") != F.col("largest")).alias("out"))
    rest = large.join(rest, ["grp", "node"])
    others = rest.select("grp", "node", "text", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("low"), block.alias("high"))
    outer = rest.where("out").select("grp", "node", "text", F.pmod(mark, F.col("outer")).cast("int").alias("low"), F.explode(every).alias("high"))
    return links.unionByName(compared(others.unionByName(outer)))


#: Documents of which one in ``SAMPLE`` is read for the order of shingles; a shingle that ``COMMON`` of these have comes
#: late in the order, and so do at most ``COMMONS`` of them. The order only decides on cost, never on what is found.
SAMPLE, COMMON, COMMONS = 8, 6, 300_000
#: A list of more texts than this reports its texts as a group, not their pairs.
MANY = 256


def _least(size: np.ndarray | int, share: float) -> np.ndarray:
    """Smallest whole number that is at least this share of ``size``."""
    return np.ceil(np.asarray(size) * share - 1e-9).astype(np.int64)


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, in ascending order, and how often they occur in the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [shingles(t, words) for t in pdf["text"]]
            if own:
                yield pd.DataFrame({"key": np.concatenate(own).view(np.int64)})

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).transform(in_batches, run, "key long")
    counted = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    top = counted.orderBy(F.desc("n"), "key").limit(COMMONS).toPandas()
    key, n = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def _prefix_lists(similarity: float, many: int):
    """Pairs of the texts in each list (rows of key, node, size, held in that order): a, b, need, held.

    need is 0 for links of a group; held says whether the shorter of the two has the key in its head.
    """
    half = similarity / (1 + similarity)

    def pairs(key: np.ndarray, node: np.ndarray, size: np.ndarray, held: np.ndarray) -> pd.DataFrame:
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, size, held = key[new], node[new], size[new], held[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        out = [np.zeros((4, 0), np.int64)]
        for n in np.unique(sizes[sizes > 1]).tolist():
            own = starts[sizes == n]
            if n > many:
                at = own[:, None] + np.arange(n)
                at = at[held[at].any(axis=1)].ravel()
                out.append(np.stack([key[at], node[at], np.zeros(len(at), np.int64), np.ones(len(at), np.int64)]))
                continue
            x, y = np.triu_indices(n, 1)
            x, y = (own[:, None] + x).ravel(), (own[:, None] + y).ravel()
            fits = np.minimum(size[x], size[y]) >= _least(np.maximum(size[x], size[y]), similarity)
            x, y = x[fits], y[fits]
            behind = np.maximum(_least(size[x], similarity), _least(size[y], similarity)) - 1
            short = ((held[x] > 0) & (size[x] <= size[y])) | ((held[y] > 0) & (size[y] <= size[x]))
            out.append(np.stack([node[x], node[y], np.maximum(_least(size[x] + size[y], half) - behind, 1), short.astype(np.int64)]))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["a", "b", "need", "held"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list[np.ndarray] = []
        for pdf in batches:
            now = [pdf[c].to_numpy(np.int64) for c in ("key", "node", "size", "held")]
            if not len(now[0]):
                continue
            if last:
                now = [np.concatenate(x) for x in zip(last, now, strict=True)]
            change = np.flatnonzero(now[0] != now[0][-1])
            cut = change[-1] + 1 if len(change) else 0
            last = [x[cut:] for x in now]
            if cut:
                yield pairs(*(x[:cut] for x in now))
        if last:
            yield pairs(*last)

    return run


def _told_apart(own: DataFrame) -> DataFrame:
    """``own`` with nodes that are equal only where all 128 bits (node and check) of the shingles' hash are."""
    pairs = own.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least <> most").select("node", "least")
    pairs = stored(pairs, "near-equal")
    if pairs.isEmpty():
        return own
    met = own.join(pairs.hint("merge"), "node", "left")
    other = F.col("least").isNotNull() & (F.col("check") != F.col("least"))
    return stored(met.withColumn("node", F.when(other, F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("least"), "near-rows")


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the smallest doc_id of each group of near copies.

    Near copies are texts whose distinct word shingles have this Jaccard similarity or more, directly or over others. None
    is missed: under one order of all shingles, two such texts of n shingles or more have one in common among the first
    n - ceil(similarity * n) + 1 of each (the prefix), so the index lists texts by these only. A pair is a candidate if its
    sizes allow the similarity and the shingles that the prefixes share, with all behind them, can reach it. The shorter of
    the two shares one already among the first n - ceil(2 * similarity / (1 + similarity) * n) + 1 (the head). Shingles that
    are frequent in a sample come last in the order; texts that still meet in one of them, or in a list of more than
    ``MANY``, form one group of candidates, unless none has it in its head: texts that share a form but no more than 0.88 of
    their shingles so are in no group for it. Groups are compared by all shingles, in blocks, without a cap.

    A null doc_id stays only if its group has no other; texts without a word form one group; of repeated rows one stays.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    common, often = _common(docs, words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                own = shingles(text, words)
                n = len(own)
                first = own[: n - int(_least(n, similarity)) + 1]
                met = np.zeros(len(first), bool)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    count = np.where(common[at] == own, often[at], 0)
                    order = np.argsort(count, kind="stable")[: len(first)]
                    first, met = own[order], count[order] > 0
                node, check = np.array([xxhash.xxh64_intdigest(own.tobytes(), seed) for seed in (0, 1)], np.uint64).view(np.int64)
                head = n - int(_least(n, 2 * similarity / (1 + similarity))) + 1
                out.append((node, check, n, head, first[~met].view(np.int64), first[met].view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "check", "size", "head", "rare", "common"]).assign(id=pdf["id"].astype("Int64"), h=pdf["h"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    own = stored(texts.transform(in_batches, run, "id long, h long, node long, check long, size long, head long, rare array<long>, common array<long>"), "near-rows")
    own = _told_apart(own)
    listed = lambda c, before: own.select("node", F.col("size").cast("int").alias("size"), "head", F.posexplode(c).alias("pos", "key"), before.alias("before")).select("node", "size", "key", ((F.col("pos") + F.col("before")) < F.col("head")).cast("int").alias("held"))
    postings = listed("rare", F.lit(0)).repartition("key").sortWithinPartitions("key", "node")
    met = postings.transform(in_batches, _prefix_lists(similarity, MANY), "a long, b long, need long, held long")
    met = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need"), F.max("held").alias("held")).where("n >= need and held > 0").select("a", "b")
    forms = stored(listed("common", F.size("rare")).select(F.col("key").alias("a"), F.col("node").alias("b"), "held").distinct(), "near-forms")
    heads = forms.where("held > 0").select("a").distinct()  # of at most ``COMMONS`` shingles
    forms = forms.join(F.broadcast(heads) if heads.count() <= SMALL else heads.hint("merge"), "a", "left_semi").select("a", "b").distinct()
    met = stored(met.union(forms), "near-candidates")
    reach = stored(components(met), "near-groups").toDF("node", "grp")
    groups = own.select("node").distinct().join(reach, "node")
    linked = stored(_links_within(docs, own, groups, words, similarity), "near-links")
    reach = stored(components(linked), "near-reach").toDF("at", "root")
    rooted = own.join(reach, F.col("node") == F.col("at"), "left").select("id", "h", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "near-rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"))
    stays = stored(first.select("first.id", "first.h"), "near-first")
    return _kept(docs, stays, rooted)
