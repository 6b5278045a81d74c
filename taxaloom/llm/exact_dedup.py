"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Every input partition hashes its normalised texts and sends each owner of a fingerprint range one message: its sorted
   distinct fingerprints of that range, Golomb-Rice coded, with a bit for those it holds more than once itself. A text
   that fills a third of the table costs one code a partition.
2. Owners merge the messages and answer each with a bitmap of the fingerprints that occur more than once.
3. Partitions look their rows up in the bitmaps. Only the suspects' texts are shuffled, and compared byte by byte: a
   Bloom filter of bounded size over the suspects' ids keeps the other texts where they are.

The rows of step 1 (ids, lengths, SHA-256) are written to the shared folder, so every later step refers to the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import bloom, golomb, rows as rows_
from .rows import in_batches

#: Bits of a fingerprint; the share of unique texts that are suspected by chance is the number of texts over 2 ** 48.
FP_BITS = 48
#: Rows of a partition for which it sends one set of messages; bounds what a task holds.
CHUNK = 200_000
#: Rows whose fingerprints one owner merges, about; below that there is an owner for each shuffle partition.
OWNED = 8_000_000
SPACES = b" \t\n\x0b\x0c\r"

_SENT = "kind byte, part int, chunk int, row long, doc_id long, h long, n_points long, sha binary, owner int, pos int, n int, width int, fps binary, twice binary"


def _send(owner_bits: int):
    shift = FP_BITS - owner_bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chunk, row = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, list[int], list[bytes], np.ndarray]] = []

        def flush() -> Iterator[pd.DataFrame]:
            ids = [x for h in held for x in h[0]]
            points = np.array([x for h in held for x in h[1]], np.int64)
            shas = [x for h in held for x in h[2]]
            fps = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64) >> np.uint64(64 - FP_BITS)
            values, inverse, counts = np.unique(fps, return_inverse=True, return_counts=True)
            owners = (values >> np.uint64(shift)).astype(np.int64)
            firsts = np.searchsorted(owners, np.arange(1 << owner_bits))
            ends = np.append(firsts[1:], len(values))
            yield pd.DataFrame(
                {
                    "kind": np.int8(0), "part": np.int32(part), "chunk": np.int32(chunk), "row": np.arange(row, row + len(ids)), "doc_id": pd.array(ids, dtype="Int64"), "h": np.concatenate([x[3] for x in held]), "n_points": points, "sha": shas,
                    "owner": owners[inverse].astype(np.int32), "pos": (inverse - firsts[owners[inverse]]).astype(np.int32), "n": np.int32(0), "width": np.int32(0), "fps": None, "twice": None,
                }
            )
            sent = []
            for owner in np.unique(owners):
                a, b = firsts[owner], ends[owner]
                width = golomb.rice_bits(1 << shift, b - a)
                code = golomb.encode(values[a:b] - (np.uint64(owner) << np.uint64(shift)), width)
                sent.append((np.int8(1), part, chunk, 0, None, 0, 0, None, int(owner), 0, int(b - a), width, code, np.packbits(counts[a:b] > 1).tobytes()))
            frame = pd.DataFrame(sent, columns=["kind", "part", "chunk", "row", "doc_id", "h", "n_points", "sha", "owner", "pos", "n", "width", "fps", "twice"])
            yield frame.astype({"doc_id": "Int64"})

        for pdf in batches:
            ids, points, shas = [], [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                ids.append(None if pd.isna(doc) else int(doc))
                points.append(len(text))
                shas.append(hashlib.sha256(text.encode("utf-8", "surrogatepass").translate(None, SPACES)).digest())
            held.append((ids, points, shas, pdf["h"].to_numpy(np.int64)))
            if sum(len(h[0]) for h in held) >= CHUNK:
                yield from flush()
                row += sum(len(h[0]) for h in held)
                chunk += 1
                held.clear()
        if any(h[0] for h in held):
            yield from flush()

    return run


def _answer(owner_bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb.decode(code, n, width) for code, n, width in zip(pdf["fps"], pdf["n"], pdf["width"], strict=True)]
        own = [np.unpackbits(np.frombuffer(x, np.uint8))[:n] > 0 for x, n in zip(pdf["twice"], pdf["n"], strict=True)]
        values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        repeated = counts > 1
        repeated[inverse[np.concatenate(own)]] = True
        marks, at, words = repeated[inverse], 0, []
        for n in pdf["n"]:
            bits = np.zeros(-(-n // 64) * 64, np.uint8)
            bits[:n] = marks[at : at + n]
            words.append(np.packbits(bits, bitorder="little").view("<i8"))
            at += n
        return pd.DataFrame({"part": pdf["part"], "chunk": pdf["chunk"], "owner": pdf["owner"], "words": words})

    return run


def groups(docs: DataFrame) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text), dropped ones too.

    Texts are equal when identical after deleting space, tab, newline, vertical tab, form feed and carriage return; null
    counts as empty. Of equal texts the row with the most code points, then the smallest doc_id (null last) stays; of
    rows equal in both, exactly one. Returns doc_id, keep_id, group_size, kept, text_sha256, n_points (code points) and h (xxhash64 of
    the original text).
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    owners = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNED))
    owner_bits = (owners - 1).bit_length()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = stored(texts.withColumn("h", F.xxhash64("text")).transform(in_batches, _send(owner_bits), _SENT), "dedup-sent")
    rows = sent.where("kind = 0").select("part", "chunk", "row", "doc_id", "h", "n_points", "sha", "owner", "pos")
    messages = sent.where("kind = 1").select("part", "chunk", "owner", "n", "width", "fps", "twice")
    bitmaps = messages.groupBy("owner").applyInPandas(_answer(owner_bits), "part int, chunk int, owner int, words array<long>")
    bit = F.expr("(shiftrightunsigned(words[cast(pos div 64 as int)], cast(pos % 64 as int)) & 1) = 1")
    marked = stored(rows.join(bitmaps, ["part", "chunk", "owner"]).select("part", "row", "doc_id", "h", "n_points", "sha", bit.alias("suspect")), "dedup-marked")
    suspects = marked.where("suspect")
    # byte verification: equal digests must mean equal bytes, whichever rows are compared
    wanted = stored(suspects.select(F.col("doc_id").alias("id")).distinct().withColumn("h", F.xxhash64("id")), "dedup-wanted")
    passes = bloom.member(wanted, wanted.count())
    body = F.translate(F.coalesce("text", F.lit("")), SPACES.decode(), "")
    # the filter keeps the other rows' texts out of the shuffle; the join is the same at every size
    read = texts.where(passes(F.xxhash64("doc_id"))).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(body.alias("body")).select("body", F.unhex(F.sha2("body", 256)).alias("sha"))
    extremes = read.groupBy("sha").agg(F.min("body").alias("a"), F.max("body").alias("b"))
    verified = extremes.select(F.when(F.col("a") == F.col("b"), F.col("sha")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).alias("sha"))
    first = F.min(F.struct((-F.col("n_points")).alias("len"), F.col("doc_id").isNull().alias("none"), "doc_id", "part", "row"))
    found = stored(suspects.groupBy("sha").agg(F.count("*").alias("group_size"), first.alias("first")).join(verified, "sha"), "dedup-groups")
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha, "n_points", "h")
    stays = (F.col("first.part") == F.col("part")) & (F.col("first.row") == F.col("row"))
    shared = suspects.join(found, "sha").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), sha, "n_points", "h")
    return alone.unionByName(shared)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    decided = groups(docs).groupBy(F.col("doc_id").alias("id"), "h").agg(F.count_if("kept").alias("stay"), F.count("*").alias("n"))
    return rows_.keep(docs, decided)
