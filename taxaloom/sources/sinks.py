"""Writers of feature shards, manifests, refined calls, metrics and calibrators."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ranks import RANKS
from ..operators.sampling import split
from ..operators.tensors import resample_channels, to_dtype
from .readers import shard_sizes, shards

# The columns of refined calls in their order.
CALL_COLUMNS = (
    "classified", "sequence_id", "reported_taxonomy", "length", "reported_taxid", "refined_taxid", "refined_taxonomy", "chosen_rank", "chosen_prob_at_rank", *(f"prob_{r}" for r in RANKS),
)


def write_shards(rows: DataFrame, path: str, shard_size: int = 4096, dtype: str = "float32", target_length: int = 0) -> int:
    """Feature rows with 22 channels as Parquet files of at most ``shard_size`` rows; other rows are left out. Returns the rows.

    With a ``target_length`` every channel is resampled to as many bins. Values are rounded to what ``dtype`` holds and
    stored as floats; ``length`` keeps the bins of the read. Rows are counted while they are written.
    """
    good = rows.where(F.forall("bins", lambda b: F.size(b) == 22) & (F.size("bins") > 0)).withColumn("length", F.size("bins"))
    bins = F.transform("bins", lambda b: F.transform(b, lambda x: to_dtype(x, dtype)))
    shaped, seen = good.withColumn("bins", resample_channels(F.col("bins"), target_length)).withColumn("bins", bins), Observation()
    shaped.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").option("maxRecordsPerFile", shard_size).parquet(path)
    return seen.get["rows"]


#: Files that a manifest lists one by one; a larger folder is listed as a whole.
LISTED = 100_000


def write_manifest(spark, path: str, folder: str, rows: int, **settings: object) -> None:
    """The JSON that describes a shard folder, as one text file in the folder ``path``: its files, and the rows that footers say.

    Files come from what the job committed, so a failed attempt of a task leaves no entry.
    """
    files = sorted((r["shard"], r["n"]) for r in shard_sizes(shards(spark, folder)).limit(LISTED + 1).collect()) if rows else []
    listed = {"outputs": [f"{folder.rstrip('/')}/{name}" for name, _ in files], "sizes": [n for _, n in files]} if len(files) <= LISTED else {"outputs": [folder]}
    spec = listed | {"channels": 22, "counts": {"approx_rows": rows, "files": len(files)}, "labels": {"order": ",".join(RANKS)}} | settings
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_split(rows: DataFrame, folder: str, share: float = 0.2, seed: int = 667) -> None:
    """Which part every row of shards is in, train or val: shard, id, taxon, in a folder for each part."""
    split(rows.select("shard", "id", "taxon"), share, seed, "shard", "id", "taxon").write.mode("overwrite").partitionBy("split").parquet(folder)


def formatted_calls(calls: DataFrame) -> DataFrame:
    """The 16 columns of refined calls in their order, numbers with six decimals, sorted by id."""
    out = [F.format_string("%.6f", F.col(c)).alias(c) if c.startswith("prob_") or c == "chosen_prob_at_rank" else F.col(c) for c in CALL_COLUMNS]
    shown = [F.when(F.col(c).isNotNull(), e).alias(c) if c.startswith("prob_") or c == "chosen_prob_at_rank" else e for c, e in zip(CALL_COLUMNS, out, strict=True)]
    return calls.orderBy("sequence_id").select(*shown)


def write_calls(calls: DataFrame, path: str) -> None:
    """Refined calls as tab-separated text with a header; files of the folder are in order of the id."""
    formatted_calls(calls).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_summary(metrics: DataFrame, path: str) -> None:
    """A line of text for each rank in order; ranks without a labelled sample say so.

    ``metrics`` has a row a rank at most: head, n, auroc, aupr, threshold, best_f1, tp, fp, fn, tn.
    """
    ranks = metrics.sparkSession.createDataFrame(list(enumerate(RANKS)), "place int, head string")
    shown = F.format_string("[%s] N=%d | AUROC=%.4f | AUPR=%.4f | best F1 %.4f at %.2f | at 0.50: TP=%d FP=%d FN=%d TN=%d", "head", "n", "auroc", "aupr", "best_f1", "threshold", "tp", "fp", "fn", "tn")
    none = F.format_string("[%s] no valid labelled samples", "head")
    lines = ranks.join(metrics, "head", "left").select("place", F.when(F.col("n").isNull(), none).otherwise(shown).alias("value"))
    lines.coalesce(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def store_taxonomy(nodes: DataFrame, merged: DataFrame, folder: str, update: bool = False) -> None:
    """Write taxonomy tables; without ``update`` tables that are there stay."""
    mode = "overwrite" if update else "ignore"
    nodes.write.mode(mode).parquet(f"{folder}/nodes")
    merged.write.mode(mode).parquet(f"{folder}/merged")


def compact(spark, source: str, target: str, files: int, cleanup: bool = False) -> int:
    """Rewrite a folder of Parquet parts as ``files`` zstd files under the schema of the first part; returns the rows.

    No parts are a FileNotFoundError, a part that can't be read under that schema a TypeError. ``cleanup`` removes the parts.
    """
    try:
        parts = sorted(spark.read.parquet(source).inputFiles())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error):
            raise FileNotFoundError(f"no Parquet parts in {source}") from error
        raise
    if not parts:
        raise FileNotFoundError(f"no Parquet parts in {source}")
    schema = spark.read.parquet(parts[0]).schema
    try:
        spark.read.schema(schema).parquet(*parts).coalesce(files).write.mode("overwrite").option("compression", "zstd").parquet(target)
    except Exception as error:
        if "PARQUET_COLUMN_DATA_TYPE_MISMATCH" in str(error) or "cannot be converted" in str(error) or "SchemaColumnConvertNotSupported" in str(error):
            raise TypeError(f"a part of {source} doesn't fit the schema of {parts[0]}") from error
        raise
    rows = spark.read.parquet(target).count()
    if cleanup:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for part in parts:
            path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(part), False)
    return rows
