"""Versioned checkpoints of arrays in a shared folder: a version counts once its job has been committed."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import file_system

SCHEMA = "name string, kind string, shape array<int>, value binary"
Arrays = dict[str, np.ndarray]


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed versions in ascending order; one that was only half written has no marker and doesn't count."""
    at, files = file_system(spark, f"{folder.rstrip('/')}/version-*/_SUCCESS")
    return sorted(int(x.getPath().getParent().getName().removeprefix("version-")) for x in files.globStatus(at) or ())


def _rows(spark: SparkSession, arrays: Arrays, notes: dict) -> DataFrame:
    rows = [(k, v.dtype.str, list(v.shape), v.tobytes()) for k, v in arrays.items()]
    return spark.createDataFrame([*rows, ("", "notes", [], json.dumps(notes).encode())], SCHEMA).coalesce(1)


def _arrays(table: DataFrame) -> tuple[Arrays, dict]:
    arrays, notes = {}, {}
    for r in table.collect():  # the parameters of one network
        if r["kind"] == "notes":
            notes = json.loads(bytes(r["value"]))
        else:
            arrays[r["name"]] = np.frombuffer(bytes(r["value"]), r["kind"]).reshape(r["shape"]).copy()
    return arrays, notes


def save(spark: SparkSession, folder: str, version: int, arrays: Arrays, notes: dict, keep: int = 2) -> None:
    """Write a version; of the older ones ``keep`` - 1 stay, and what was never committed goes."""
    folder = folder.rstrip("/")
    _rows(spark, arrays, notes).write.mode("overwrite").parquet(f"{folder}/version-{version:012d}")
    stay = {f"version-{v:012d}" for v in versions(spark, folder)[-keep:]}
    at, files = file_system(spark, f"{folder}/version-*")
    for x in files.globStatus(at) or ():
        if x.getPath().getName() not in stay:
            files.delete(x.getPath(), True)


def load(spark: SparkSession, folder: str, version: int | None = None) -> tuple[Arrays, dict] | None:
    """Arrays and notes of a version, the latest by default; None where none is committed."""
    known = versions(spark, folder)
    if not known:
        return None
    return _arrays(spark.read.schema(SCHEMA).parquet(f"{folder.rstrip('/')}/version-{known[-1] if version is None else version:012d}"))


def save_weights(spark: SparkSession, path: str, weights: Arrays, notes: dict) -> None:
    """The weights of one network as a table that replaces what is there."""
    _rows(spark, weights, notes).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> Arrays:
    """Weights that ``save_weights`` wrote, or those of a local npz file."""
    if path.endswith(".npz"):
        return dict(np.load(path.removeprefix("file://")))
    return _arrays(spark.read.schema(SCHEMA).parquet(path))[0]
