"""Carrying decisions about rows back to the rows themselves, and handing rows to Python in bounded batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
import pyarrow
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


#: Bytes of a batch of rows that goes to a Python worker; one long text may exceed it by itself.
BATCH = 4 << 20

Run = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def release() -> None:
    """Give freed memory of this worker back; workers are reused, and what one stage needed would count in the next."""
    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Run) -> Run:
    """``run``, with memory given back at the end of its task."""

    @wraps(run)
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        release()

    return whole


def in_batches(df: DataFrame, run: Run, schema: str) -> DataFrame:
    """``df.mapInPandas``, in batches of about ``BATCH`` bytes at most."""
    bound_batches(df)
    return df.mapInPandas(tidy(run), schema)


def bound_batches(df: DataFrame) -> None:
    """Bound the batches of the session of ``df``, which count rows only by default."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has, in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def keep(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``keys`` has a row for each (id, h), a doc_id and the xxhash64 of a text: ``n`` rows of ``docs`` have them, and
    ``stay`` of these stay. Rows without a key go. The join is a sort-merge join at every size; only keys of which some
    rows stay and some go need their rows numbered.
    """
    h, i, k, stay, n, number = fresh(docs, "_h", "_id", "_k", "_stay", "_n", "_number")
    wanted = stored(keys.where("stay > 0").select(F.col("id").alias(i), F.col("h").alias(k), F.col("stay").alias(stay), F.col("n").alias(n)), "keep")
    marked = docs.withColumn(h, F.xxhash64(docs["text"]))
    both = marked.join(wanted.hint("merge"), marked["doc_id"].eqNullSafe(wanted[i]) & (marked[h] == wanted[k]))
    if wanted.where(F.col(stay) < F.col(n)).isEmpty():
        return both.select(*(marked[c] for c in docs.columns))
    some = both.where(F.col(stay) < F.col(n)).withColumn(number, F.row_number().over(Window.partitionBy(i, k).orderBy(k)))
    return both.where(F.col(stay) >= F.col(n)).select(*docs.columns).unionByName(some.where(F.col(number) <= F.col(stay)).select(*docs.columns))
