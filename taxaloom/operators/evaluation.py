"""Read-level evaluation: classified reads against the genomes they come from, and the predictions made for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.ranks import RANKS
from .metrics import outcomes
from .taxonomy import sized


def mapped_reads(names: DataFrame, genomes: DataFrame) -> DataFrame:
    """``names`` (id, name) and ``genomes`` (tax_id, fasta, path) -> id, true_taxid, path, for names whose accession is a genome's key.

    Where every tax_id is 0 it is taken from the third field of the file name. Genomes that share a key all count.
    """
    taxid = F.col("tax_id").try_cast("bigint")
    unset = genomes.agg(F.coalesce(F.bool_and(taxid == 0), F.lit(True))).first()[0]
    keyed = genomes.select(tokens.genome_key(F.col("fasta")).alias("key"), (tokens.genome_taxid(F.col("fasta")) if unset else taxid).alias("true_taxid"), "path")
    stem = F.substring_index("name", "/", 1)
    own = names.select("id", F.left(stem, F.greatest(F.length(stem) - 1, F.lit(0))).alias("key"))
    return own.join(sized(keyed), "key").select("id", "true_taxid", "path")


def read_table(reads: DataFrame, mapped: DataFrame, predictions: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each mapped read: id, classified, path, taxid (reported), true_taxid, outcome, rank of the call, prob_<rank>.

    ``reads`` has id, classified, taxonomy; ``paths`` taxid and path (lineage as an array); ``predictions`` id, taxon and
    prob_<rank>, joined on read and reported taxid: reads without one keep null probabilities.
    """
    own = reads.select("id", "classified", tokens.reported_taxid(F.col("taxonomy")).alias("taxid")).join(mapped.hint("merge"), "id")
    lines = paths.select(F.col("taxid").alias("true_taxid"), F.col("path").alias("truth_path"))
    told = outcomes(own.join(sized(lines), "true_taxid", "left")).drop("truth_path")
    rank = nodes.where(F.col("rank").isin(*RANKS)).select("taxid", "rank")
    scores = predictions.select("id", F.col("taxon").alias("taxid"), *(f"prob_{r}" for r in RANKS))
    return told.join(sized(rank), "taxid", "left").join(scores.hint("merge"), ["id", "taxid"], "left")


def summary(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """TP, FP, FN and TN reads (of each ``by``), as tp, fp, fn, tn: the input of ``metrics.rates``."""
    return table.groupBy(*(by or [])).agg(*(F.count_if(F.col("outcome") == x).alias(x.lower()) for x in ("TP", "FP", "FN", "TN")))
