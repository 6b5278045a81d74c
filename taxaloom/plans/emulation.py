"""Reads, a taxonomy and scores made from the star-schema tables, by arithmetic that any SQL engine repeats.

orders are reads, their line items in order are runs of k-mers; parts are species of a ragged tree whose levels are
quotients of the part key, some dropped and some named by prefixed ranks. ``DIV`` marks integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import RANKS

BIN = 25
TAXID = "CASE WHEN l_partkey % 11 = 0 THEN 0 WHEN l_partkey % 17 = 0 THEN 9000000 + l_partkey ELSE 1000000 + l_partkey END"
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus")
REPORTED = "1000000 + o_orderkey % 2000 + 1"
HEADER = f"CASE WHEN o_orderkey % 3 = 0 THEN concat('sim|', CAST({REPORTED} AS STRING), '|z') ELSE concat('r', CAST(o_orderkey AS STRING)) END"
#: taxid, parent, rank of each level, and which keys have it.
LEVELS = (
    ("1000000 + p", "CASE WHEN p DIV 4 % 7 = 3 THEN 3000000 + p DIV 16 ELSE 2000000 + p DIV 4 END", "CASE WHEN p % 13 = 5 THEN 'subspecies' ELSE 'species' END", "true"),
    ("2000000 + p DIV 4", "3000000 + p DIV 16", "'genus'", "p DIV 4 % 7 <> 3"),
    ("3000000 + p DIV 16", "CASE WHEN p DIV 64 % 5 = 1 THEN 5000000 + p DIV 256 ELSE 4000000 + p DIV 64 END", "'family'", "true"),
    ("4000000 + p DIV 64", "5000000 + p DIV 256", "CASE WHEN p DIV 64 % 5 = 2 THEN 'suborder' WHEN p DIV 64 % 5 = 3 THEN 'clade' WHEN p DIV 64 % 5 = 4 THEN 'infrakingdom' ELSE 'order' END", "p DIV 64 % 5 <> 1"),
    ("5000000 + p DIV 256", "6000000 + p DIV 1024", "CASE WHEN p DIV 256 % 3 = 1 THEN 'superclass' ELSE 'class' END", "true"),
    ("6000000 + p DIV 1024", "7000000 + p DIV 4096", "CASE WHEN p DIV 1024 % 4 = 1 THEN 'subkingdom' ELSE 'phylum' END", "true"),
    ("7000000 + p DIV 4096", "1", "CASE WHEN p DIV 4096 % 2 = 0 THEN 'domain' ELSE 'kingdom' END", "true"),
)


def _probability(rank: int) -> str:
    scale = "CASE WHEN k % 5 = 0 THEN 50.0 ELSE 20.0 END"
    return f"CASE WHEN (k + taxon + {rank}) % 23 = 0 OR k % 41 = 0 THEN NULL ELSE ((k * 31 + taxon * 17 + {rank} * 7) % 20) / ({scale}) END"


PROBABILITIES = tuple(_probability(k) for k in range(7))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, key, classified, taxonomy, header, length, kmers."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    token = F.concat(F.when(F.col("l_returnflag") == "A", F.lit("A")).otherwise(F.expr(TAXID).cast("string")), F.lit(":"), F.col("l_quantity").cast("bigint").cast("string"))
    # tokens are made behind the exchange, which has all that they are made of
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER).withColumn("ord", number).select("l_orderkey", "ord", token.alias("token"))
    runs = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "token"))), lambda x: x["token"]), " ").alias("kmers"))
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("key"), F.expr("CASE WHEN o_orderstatus = 'P' THEN 'U' ELSE 'C' END").alias("classified"),
        F.expr(f"concat('Taxon (taxid ', CAST({REPORTED} AS STRING), ')')").alias("taxonomy"), F.expr(HEADER).alias("header"), F.expr("CAST(100 + o_orderkey % 900 AS INT)").alias("length"),
    )
    return orders.join(runs, orders["key"] == runs["l_orderkey"], "left").drop("l_orderkey")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxid, parent, rank, name."""
    keys = table(spark, sf_dir, "part").selectExpr("p_partkey AS p")
    out = spark.range(1).selectExpr("CAST(1 AS BIGINT) AS taxid", "CAST(1 AS BIGINT) AS parent", "'no rank' AS rank")
    for taxid, parent, rank, where in LEVELS:
        level = keys.where(where).selectExpr(f"CAST({taxid} AS BIGINT) AS taxid", f"CAST({parent} AS BIGINT) AS parent", f"{rank} AS rank")
        out = out.unionByName(level.distinct())
    return out.withColumn("name", F.concat_ws(" ", "rank", F.col("taxid").cast("string")))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """old, new: replaced taxids."""
    return table(spark, sf_dir, "part").where("p_partkey % 17 = 0").selectExpr("9000000 + p_partkey AS old", "1000000 + p_partkey AS new")


def scored(candidates: DataFrame) -> DataFrame:
    """Candidates (id, taxon, pos) with prob_<rank>."""
    keyed = candidates.withColumn("k", F.expr("CAST(substring(id, 2) AS BIGINT)"))
    return keyed.select("id", "taxon", "pos", *(F.expr(p).cast("double").alias(f"prob_{r}") for r, p in zip(RANKS, PROBABILITIES, strict=True)))
