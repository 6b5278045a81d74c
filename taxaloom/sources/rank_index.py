"""Which rows of which shard have a rank: row bitmaps by shard and rank, kept beside the shards.

A filter on a rank opens only the files that hold it, and counts are read from the bitmaps. Rows are numbered as they lie
in their file, from 0; a bitmap covers 32,768 of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers
from .intermediates import Intermediates, sweep

#: Rows of a bitmap, as Spark's bitmap functions have it.
BITS = 32_768


def bitmaps(rows: DataFrame) -> DataFrame:
    """``rows`` (shard, row, rank_index) -> shard, rank_index, bucket, bits: a bitmap of the rows from bucket * BITS on."""
    place = F.col("row") + 1  # the functions count from one
    keyed = rows.select("shard", F.coalesce("rank_index", F.lit(-1)).cast("int").alias("rank_index"), (F.bitmap_bucket_number(place) - 1).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    return keyed.groupBy("shard", "rank_index", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def index(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """The bitmaps of a shard folder or manifest; written once for the files as they are, and made anew if they change."""
    folders = readers.folders(spark, path)
    own = Intermediates(spark, cache or path.rstrip("/") + ".rank_index", folders)

    def make() -> DataFrame:
        rows = spark.read.parquet(*folders)
        return bitmaps(rows.select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("row"), "rank_index"))

    out = own.table("ranks", make)
    own.note(path)
    sweep(spark, own.folder)
    return out


def stats(index: DataFrame) -> DataFrame:
    """rank_index, n: rows of each rank, -1 for those of none."""
    return index.groupBy("rank_index").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def places(index: DataFrame, rank: int) -> DataFrame:
    """shard, row: where the rows of a rank lie."""
    held = F.expr(f"filter(sequence(0, {BITS - 1}), j -> shiftright(cast(conv(hex(substring(bits, j div 8 + 1, 1)), 16, 10) as int), j % 8) % 2 = 1)")
    there = index.where(F.col("rank_index") == rank).select("shard", "bucket", F.explode(held).alias("bit"))
    return there.select("shard", (F.col("bit") + F.col("bucket") * BITS).alias("row"))


def rows_of_rank(spark: SparkSession, path: str, rank: int, cache: str | None = None) -> DataFrame:
    """The rows of shards (``readers.shards``) with this rank_index, from the files that hold it alone.

    Shards without the column say nothing about ranks: then all their rows are meant.
    """
    rows = readers.shards(spark, path)
    if "rank_index" not in rows.columns:
        return rows
    held = [r["shard"] for r in index(spark, path, cache).where(F.col("rank_index") == rank).select("shard").distinct().collect()]  # names of files, as Spark lists them itself
    if not held:
        return rows.where(F.lit(False))
    return spark.read.schema(rows.drop("shard").schema).parquet(*held).withColumn("shard", F.col("_metadata.file_name")).where(F.col("rank_index") == rank)
