"""Readers of classified reads, truth tables, taxonomies and shard folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens

READS = "Classified STRING, ID STRING, Taxonomy STRING, Length INT, Kmers STRING"


class MissingTaxonomy(FileNotFoundError):
    """The folder holds no taxonomy tables."""


def classified_reads(spark: SparkSession, path: str) -> DataFrame:
    """A headerless classifier table, tab separated: classified, id, taxonomy, length, kmers. Lengths that aren't numbers are null."""
    raw = spark.read.schema(READS).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return raw.toDF("classified", "id", "taxonomy", "length", "kmers")


def truth_one_file(spark: SparkSession, path: str) -> DataFrame:
    """Reads with their reference: seq_id, ref without header -> id, truth (second field of the reference)."""
    raw = spark.read.schema("id STRING, ref STRING").option("sep", "\t").option("quote", "").csv(path)
    return raw.select("id", F.try_element_at(F.split("ref", r"\|"), F.lit(2)).alias("truth"))


def simulated_names(spark: SparkSession, path: str) -> DataFrame:
    """A headerless map of reads to the names of a simulator: id, name."""
    return spark.read.schema("id STRING, name STRING").option("sep", "\t").option("quote", "").csv(path)


def genomes(spark: SparkSession, path: str) -> DataFrame:
    """A table of genomes with a header: tax_id, fasta and, for evaluation, path, as text."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def truth_two_files(spark: SparkSession, reads: str, table: str) -> DataFrame:
    """A map of reads to simulated names and a table of genomes (tax_id, fasta) -> id, truth.

    Where every tax_id is 0, it is read from the third field of the file name.
    """
    own = genomes(spark, table)
    taxid = F.col("tax_id").try_cast("bigint")
    unset = own.agg(F.coalesce(F.bool_and(taxid == 0), F.lit(True))).first()[0]
    keyed = own.select(tokens.genome_key(F.col("fasta")).alias("key"), (tokens.genome_taxid(F.col("fasta")) if unset else taxid).cast("string").alias("truth"))
    one = keyed.groupBy("key").agg(F.min("truth").alias("truth"))
    return simulated_names(spark, reads).select("id", tokens.accession(F.col("name")).alias("key")).join(one, "key", "left").select("id", "truth")


def taxonomy_dump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """nodes.dmp, names.dmp and merged.dmp -> nodes (taxid, parent, rank, name) and merged (old, new)."""
    def dump(name: str) -> DataFrame:
        return spark.read.text(f"{folder}/{name}").select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f"))

    names = dump("names.dmp").where(F.col("f")[3] == "scientific name").select(F.col("f")[0].cast("bigint").alias("taxid"), F.col("f")[1].alias("name"))
    nodes = dump("nodes.dmp").select(F.col("f")[0].cast("bigint").alias("taxid"), F.col("f")[1].cast("bigint").alias("parent"), F.col("f")[2].alias("rank"))
    merged = dump("merged.dmp").select(F.col("f")[0].cast("bigint").alias("old"), F.col("f")[1].cast("bigint").alias("new"))
    return nodes.join(names, "taxid", "left"), merged


def taxonomy(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The tables that ``sinks.store_taxonomy`` wrote."""
    try:
        return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/merged")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingTaxonomy(f"no taxonomy in {folder}; run setup first") from error
        raise


def manifest(spark: SparkSession, path: str) -> dict:
    """A shard manifest; ``outputs`` may be relative to its folder."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    spec = json.loads(text)
    if not spec.get("outputs"):
        raise ValueError(f"{path} lists no outputs")
    return spec


def folders(spark: SparkSession, path: str) -> list[str]:
    """A shard folder, or the folders and files that a manifest (``*.json``, or a folder ``*.manifest``) lists."""
    if not path.rstrip("/").endswith((".json", ".manifest")):
        return [path]
    base = path.rstrip("/").rsplit("/", 1)[0]
    return [p if p.startswith("/") or "://" in p or p.startswith("file:/") else f"{base}/{p}" for p in manifest(spark, path)["outputs"]]


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of a shard folder, or of what a manifest lists, with a ``shard`` column."""
    return spark.read.parquet(*folders(spark, path)).withColumn("shard", F.col("_metadata.file_name"))  # filters on it prune files


def shard_sizes(rows: DataFrame) -> DataFrame:
    """shard, n: row counts. No column is read, so each task answers from the footers of its files."""
    return rows.groupBy("shard").agg(F.count("*").alias("n"))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """shard, n of a shard folder or manifest, as a manifest with ``sizes`` says, else from footers.

    Sizes that are not as many as the outputs, or not those of the footers, are a ValueError.
    """
    found = shard_sizes(shards(spark, path))
    said = manifest(spark, path).get("sizes") if path.rstrip("/").endswith((".json", ".manifest")) else None
    if said is None:
        return found
    names = [p.rsplit("/", 1)[-1] for p in folders(spark, path)]
    if len(names) != len(said):
        raise ValueError(f"{path} has {len(said)} sizes for {len(names)} outputs")
    told = spark.createDataFrame(list(zip(names, map(int, said), strict=True)), "shard string, n long")
    wrong = told.alias("t").join(found.alias("f"), "shard", "full_outer").where(~F.col("t.n").eqNullSafe(F.col("f.n"))).where("coalesce(t.n, 0) <> coalesce(f.n, 0)")
    if first := wrong.select("shard", F.col("t.n").alias("said"), F.col("f.n").alias("held")).first():
        raise ValueError(f"{path} says {first['said']} rows of {first['shard']}, which holds {first['held']}")
    return told


def in_split(rows: DataFrame, folder: str, part: str) -> DataFrame:
    """The rows of shards that ``sinks.write_split`` put into this part; rows that it doesn't list are in none."""
    listed = rows.sparkSession.read.parquet(folder).where(F.col("split") == part).select("shard", "id", "taxon")
    return rows.join(listed, ["shard", "id", "taxon"], "left_semi")
