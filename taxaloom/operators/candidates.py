"""Candidate taxa of a read, and their truth labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import RANKS
from .taxonomy import normalize, sized


def ranked(runs: DataFrame, least: int = 0) -> DataFrame:
    """id, taxid, total, first_ord, pos: non-zero taxa with at least this many k-mers, by support, then first appearance."""
    each = runs.where("taxid <> 0").groupBy("id", "taxid").agg(F.sum("cnt").alias("total"), F.min("ord").alias("first_ord"))
    order = Window.partitionBy("id").orderBy(F.desc("total"), "first_ord")
    return each.where(F.col("total") >= least).withColumn("pos", F.row_number().over(order))


def known_taxa(ranked: DataFrame, known: DataFrame, merged: DataFrame) -> DataFrame:
    """``ranked`` (id, taxid, ...) with ``taxon`` (merged ids replaced); taxa that are not in ``known`` (taxid) are dropped.

    Two ids that merge into one taxon stay two rows, as both have evidence of their own.
    """
    out = normalize(ranked.withColumn("taxon", F.col("taxid")), "taxon", merged)
    return out.join(sized(known.select(F.col("taxid").alias("taxon")).distinct()), "taxon", "left_semi")


def candidates(runs: DataFrame, known: DataFrame, merged: DataFrame, least: int = 0) -> DataFrame:
    """The known taxa of ``ranked``: id, taxid, taxon, total, pos."""
    return known_taxa(ranked(runs, least), known, merged).select("id", "taxid", "taxon", "total", "pos")


def training_candidates(ranked: DataFrame, reported: DataFrame, top: int | None, extra: int, seed: int = 0, least: int = 0) -> DataFrame:
    """The ``top`` ranked taxa of a read, ``extra`` of the rest by a seeded hash, and the reported taxon if it has evidence.

    ``ranked`` is that of every taxon, and ``least`` the support that a taxon needs to be in the top or drawn; a read in which
    none has it is left out, reported taxon or not. Without a ``top`` all that have it are. ``reported`` has id and taxid.
    Adds ``why``: top, extra or reported.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "id", F.col("taxid").cast("string")))
    first = F.col("pos") <= top if top else F.lit(True)
    tail = Window.partitionBy("id", first, F.col("total") >= least).orderBy(draw, "pos")
    drawn = ranked.withColumn("draw", F.row_number().over(tail)).withColumn("most", F.max("total").over(Window.partitionBy("id")))
    own = reported.select("id", "taxid", F.lit(True).alias("is_reported"))
    able = F.col("total") >= least
    why = F.when(able & first, "top").when(able & (F.col("draw") <= extra), "extra").when(F.col("is_reported"), "reported")
    chosen = drawn.where(F.col("most") >= least).join(own, ["id", "taxid"], "left").withColumn("why", why)
    return chosen.where("why is not null").select("id", "taxid", "pos", "why")


def labels(pairs: DataFrame, canon: DataFrame) -> DataFrame:
    """``pairs`` (id, taxon, true_taxon) with label_<rank>: 1 where both have the same ancestor at the rank, else 0."""
    own = canon.select(F.col("taxid").alias("taxon"), *(F.col(r).alias(f"p_{r}") for r in RANKS))
    true = canon.select(F.col("taxid").alias("true_taxon"), *(F.col(r).alias(f"t_{r}") for r in RANKS))
    both = pairs.join(sized(own), "taxon", "left").join(sized(true), "true_taxon", "left")
    return both.select("id", "taxon", "true_taxon", *(F.coalesce((F.col(f"p_{r}") == F.col(f"t_{r}")).cast("int"), F.lit(0)).alias(f"label_{r}") for r in RANKS))
