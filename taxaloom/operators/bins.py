"""Run positions and positional bins of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens

#: k-mers of a bin.
BIN = 1000


def runs(reads: DataFrame) -> DataFrame:
    """``reads`` (id, kmers) -> id, ord, taxid, cnt: a row for every numeric token with a positive count, in order."""
    each = reads.select("id", F.posexplode(tokens.numeric_tokens(F.col("kmers"))).alias("ord", "t"))
    return each.select("id", "ord", "t.taxid", "t.cnt").where("cnt > 0 and taxid is not null")


def tax_counts(runs: DataFrame) -> DataFrame:
    """k-mers of every (id, taxid), no-hits included as taxid 0."""
    return runs.groupBy("id", "taxid").agg(F.sum("cnt").alias("cnt"))


def positions(runs: DataFrame) -> DataFrame:
    """Adds ``start``, the number of k-mers before each run of its read. Reads are bounded, so is each window."""
    before = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum("cnt").over(before), F.lit(0)))


def bins(placed: DataFrame, size: int = BIN) -> DataFrame:
    """``placed`` (id, taxid, cnt, start) -> id, bin, taxid, cnt: k-mers of each taxon in each bin, runs split at borders."""
    first, last = F.expr(f"start div {size}"), F.expr(f"(start + cnt - 1) div {size}")
    each = placed.select("id", "taxid", "cnt", "start", F.explode(F.sequence(first, last)).alias("bin"))
    part = F.least(F.col("start") + F.col("cnt"), (F.col("bin") + 1) * size) - F.greatest(F.col("start"), F.col("bin") * size)
    return each.groupBy("id", "bin", "taxid").agg(F.sum(part).alias("cnt"))


def downsample(binned: DataFrame, most: int) -> DataFrame:
    """Keep at most this many bins of a read, evenly spaced: the bins ranked int(i * n / most)."""
    own = binned.select("id", "bin").distinct()
    per = Window.partitionBy("id")
    ranked = own.withColumn("k", F.row_number().over(per.orderBy("bin")) - 1).withColumn("n", F.count("*").over(per))
    # rank k is taken by some i if i = ceil(k * most / n) still maps to it
    i = f"((k * {most} + n - 1) div n)"
    taken = F.expr(f"n <= {most} or ({i} < {most} and ({i} * n) div {most} = k)")
    return binned.join(ranked.where(taken).select("id", "bin"), ["id", "bin"])

