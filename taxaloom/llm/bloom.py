"""A Bloom filter of bounded size over a column of 64-bit hashes, built by all tasks and broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import in_batches

#: log2 of the bits of a block, and of the most bits a filter may have (32 MB), whatever the input.
BLOCK_BITS, MOST_BITS = 19, 28
PROBES = 4
#: Rows of the table for which one task sends its part of the filter, and the tasks there are at least.
ROWS, TASKS = 16_000_000, 64


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.concatenate([(h + np.uint64(k) * step) & np.uint64((1 << bits) - 1) for k in range(PROBES)]).astype(np.int64)


def member(table: DataFrame, rows: int):
    """A function of a long column: False only where the hash is not in column ``h`` of ``table`` (``rows`` of them).

    The filter has about 16 bits a row up to its bound; beyond that more rows pass, and none is lost.
    """
    bits = min(MOST_BITS, max(BLOCK_BITS, (16 * max(1, rows)).bit_length()))
    size = 1 << (BLOCK_BITS - 3)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for pdf in batches:
            places = _places(pdf["h"].to_numpy(np.int64), bits)
            for block in np.unique(places >> BLOCK_BITS).tolist():
                bytes_ = own.setdefault(block, np.zeros(size, np.uint8))
                here = places[places >> BLOCK_BITS == block] & ((1 << BLOCK_BITS) - 1)
                np.bitwise_or.at(bytes_, here >> 3, (1 << (here & 7)).astype(np.uint8))
        yield pd.DataFrame({"block": list(own), "bits": [b.tobytes() for b in own.values()]}).astype({"block": "int32"})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [every.tobytes()]})

    schema = "block int, bits binary"
    parts = table.select("h").coalesce(max(TASKS, -(-rows // ROWS))).transform(in_batches, partial, schema).groupBy("block").applyInPandas(merge, schema).collect()
    whole = bytearray(1 << (bits - 3))
    for r in parts:
        whole[r["block"] * size : (r["block"] + 1) * size] = r["bits"]
    shared = table.sparkSession.sparkContext.broadcast(bytes(whole))

    def test(hashes: pd.Series) -> pd.Series:
        own = np.frombuffer(shared.value, np.uint8)
        places = _places(hashes.to_numpy(np.int64), bits)
        return pd.Series(((own[places >> 3] >> (places & 7).astype(np.uint8)) & 1).reshape(PROBES, -1).all(axis=0))

    test.__annotations__ = {"hashes": pd.Series, "return": pd.Series}
    return F.pandas_udf(test, "boolean")


