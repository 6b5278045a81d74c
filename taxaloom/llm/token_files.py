"""Token ids of a corpus as compressed, checksummed blocks, written in ascending order of doc_id and read back.

The container is a Parquet folder in the shared folder. A row is a block: the part and number that give its place, the
coded ids (see ``mixcoder``), and the documents that have ids in it. Parts are ranges of doc_id, so the order of parts,
blocks and ids is the order of documents; a part is written by one task and committed as a whole, so a lost executor
costs that part only. A long document may span blocks; blocks never span parts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import shared_dir, stored
from . import mixcoder
from .bpe import Vocabulary
from .rows import in_batches

BLOCKS = (
    "part int, block long, at long, n long, payload binary, docs array<struct<doc:long,doc_id:long,piece:int,pieces_end:boolean,n:long>>"
)


class LibraryEncoder(Vocabulary):
    """Encodes with the tokenizers library, a pre-token at a time; pre-tokens met before are remembered."""

    remembered = 400_000

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.model = Tokenizer.from_file(path).model

    def encode_piece(self, piece: str) -> list[int]:
        shown = "".join(map(self.bytes.__getitem__, piece.encode("utf-8", "surrogatepass")))
        return [t.id for t in self.model.tokenize(shown)]


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _write_part(path: str, end: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part = encoder(path), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []  # of blocks that are full
        docs: list[list[tuple]] = []
        fill: list[np.ndarray] = []
        here: list[tuple] = []
        state = {"block": 0, "at": 0, "room": block}

        def close() -> None:
            nonlocal fill, here
            ids.append(np.concatenate(fill))
            docs.append(here)
            fill, here, state["room"] = [], [], block

        def flush() -> pd.DataFrame:
            rows = []
            for own_ids, own_docs in zip(ids, docs, strict=True):
                rows.append((part, state["block"], state["at"], len(own_ids), mixcoder.encode_block(own_ids), own_docs))
                state["block"] += 1
                state["at"] += len(own_ids)
            ids.clear()
            docs.clear()
            return pd.DataFrame(rows, columns=["part", "block", "at", "n", "payload", "docs"])

        number = 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                rest, piece = np.append(own.encode(text), np.uint32(end)), 0
                while len(rest):
                    now, rest = rest[: state["room"]], rest[state["room"] :]
                    fill.append(now)
                    here.append((number, None if pd.isna(doc_id) else int(doc_id), piece, not len(rest), len(now)))
                    state["room"] -= len(now)
                    piece += 1
                    if not state["room"]:
                        close()
                number += 1
                if ids:
                    yield flush()
        if fill:
            close()
        if ids:
            yield flush()

    return run


def write(docs: DataFrame, path: str, end: int, folder: str | None = None, block: int = mixcoder.BLOCK) -> str:
    """Write the ids of ``docs`` (doc_id, text), each document closed by id ``end``, in blocks of ``block`` ids; returns the folder.

    Null text counts as empty and has the end id only; null doc_ids come last; rows of one doc_id follow each other by a
    hash of the text; an empty table makes an empty folder; other columns are not read. Ids of 65,536 and
    more are an error of the task that meets them.
    """
    if not 0 <= end < 1 << 16:
        raise ValueError("ids are coded as 16 bits")
    folder = folder or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    key = (F.col("doc_id").asc_nulls_last(), F.col("h").asc())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    ordered.transform(in_batches, _write_part(path, end, block), BLOCKS).write.option("compression", "none").parquet(folder)
    return folder


def _matrix_times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def crc32_joined(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings one after the other, from the crc32 of both and the length of the second."""
    shift = [0xEDB88320, *(1 << k for k in range(31))]  # what one zero bit does to the register
    length *= 8
    while length:
        if length & 1:
            first = _matrix_times(shift, first)
        shift = [_matrix_times(shift, row) for row in shift]
        length >>= 1
    return first ^ second


def _read_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part, first, docs, payload in zip(pdf["part"], pdf["at"], pdf["docs"], pdf["payload"], strict=True):
            ids, rows, k = mixcoder.decode_block(payload), [], 0
            for d in docs:
                n = int(d["n"])
                rows.append((part, d["doc"], d["doc_id"], d["piece"], bool(d["pieces_end"]), int(first) + k, n, zlib.crc32(ids[k : k + n].tobytes())))
                k += n
            yield pd.DataFrame(rows, columns=["part", "doc", "doc_id", "piece", "last", "at", "n", "crc"]).astype({"doc_id": "Int64"})


def _join_pieces(n: pd.Series, crc: pd.Series) -> pd.Series:
    out = []
    for lengths, own in zip(n, crc, strict=True):
        total = int(own[0])
        for length, c in zip(lengths[1:], own[1:], strict=True):
            total = crc32_joined(total, int(c), 4 * int(length))
        out.append(total)
    return pd.Series(out, dtype="int64")


_join_pieces.__annotations__ = {"n": pd.Series, "crc": pd.Series, "return": pd.Series}


def read_index(spark, folder: str) -> DataFrame:
    """Decode a folder of blocks: doc_id, start (ids of all documents before), n_tokens, ids_crc32, a row for a document."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    pieces = blocks.select("part", "at", "payload", "docs").transform(in_batches, _read_blocks, "part int, doc long, doc_id long, piece int, last boolean, at long, n long, crc long")
    pieces = stored(pieces, "token-pieces")  # blocks are decoded once
    whole = pieces.where("piece = 0 and last").select("part", "doc_id", "at", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    sorted_ = F.array_sort(F.collect_list(F.struct("piece", "n", "crc")))
    split = pieces.where("not (piece = 0 and last)").groupBy("part", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), sorted_.alias("own"))
    joined = F.pandas_udf(_join_pieces, "long")(F.col("own.n"), F.col("own.crc"))
    split = split.select("part", "doc_id", "at", "n_tokens", joined.alias("ids_crc32"))
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a part
    base, bases = 0, []
    for part, n in totals:
        bases.append((part, base))
        base += n
    offsets = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    rows = whole.unionByName(split).join(offsets, "part")
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
