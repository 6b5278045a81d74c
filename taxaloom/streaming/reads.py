"""Streams of classified reads. One row is one read, so per-read operators need no state and no watermark; only unique ids do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import bins
from ..sources.readers import READS


def stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """New classifier tables of a folder as a stream."""
    raw = spark.readStream.schema(READS).option("sep", "\t").option("quote", "").option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return raw.toDF("classified", "id", "taxonomy", "length", "kmers")


def start(reads: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch plan on every micro-batch; available files are taken, then the query ends."""
    def each(batch: DataFrame, number: int) -> None:
        sink(plan(batch), number)

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_plan(batch: DataFrame) -> DataFrame:
    """k-mers of every (read, taxid) of a micro-batch."""
    return bins.tax_counts(bins.runs(batch))


def unique(reads: DataFrame) -> DataFrame:
    """The reads of a stream; an id that came before, in this batch or an earlier one, is an error that ends the query.

    The state is one number an id, dealt over all tasks by id; ids are never forgotten, so long streams want a state store
    on disk (``spark.sql.streaming.stateStore.providerClass``).
    """

    def once(key: tuple[str], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in rows:
            n += len(pdf)
            if n > 1:
                raise ValueError(f"read {key[0]} occurs more than once")
            yield pdf
        state.update((n,))

    return reads.groupBy("id").applyInPandasWithState(once, reads.schema, "n long", "append", GroupStateTimeout.NoTimeout)
