"""Intermediate tables that a later run with the same inputs and settings reads in place of making them again.

A table's folder is named by a digest of what it was made from: the files of the inputs with their lengths and times, and
the settings. It counts once its job has been committed, so a half-written one is made anew. Each run leaves a note of the
tables it used under the name of its output; ``sweep`` removes tables that no note names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..session import file_system

#: Raised when the meaning of a stored table changes, so that older ones are not read.
VERSION = 1


def files(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """Name, length and time of every file that the paths hold, in order of the names."""
    out = []
    for path in paths:
        at, own = file_system(spark, path)
        found = own.globStatus(at) or ()
        todo = list(found)
        while todo:
            x = todo.pop()
            if x.isDirectory():
                todo += own.listStatus(x.getPath())
            else:
                out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return sorted(out)


def digest(spark: SparkSession, inputs: list[str], **settings: object) -> str:
    """A name for what these inputs give under these settings."""
    said = json.dumps([VERSION, files(spark, *inputs), settings], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:32]


class Intermediates:
    """The tables of one run, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, inputs: list[str], **settings: object) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.key = digest(spark, inputs, **settings)
        self.used: list[str] = []
        self.made: list[str] = []
        self.counts: dict[str, int] = {}

    def table(self, name: str, make: Callable[[], DataFrame], **counts: Column) -> DataFrame:
        """The table of this name: read if a run before has committed it, else made and written.

        ``counts`` (aggregates over its rows) are taken while it is written, or else from the table, and go to ``counts``.
        """
        path = f"{self.folder}/{name}-{self.key}"
        self.used.append(path.rsplit("/", 1)[-1])
        at, own = file_system(self.spark, f"{path}/_SUCCESS")
        if not own.exists(at):
            self.made.append(name)
            rows, seen = make(), Observation(f"{name}-{self.key}")
            if counts:
                rows = rows.observe(seen, *(c.alias(k) for k, c in counts.items()))
            rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
            self.counts |= seen.get if counts else {}
            return self.spark.read.parquet(path)
        out = self.spark.read.parquet(path)
        if counts:
            self.counts |= out.agg(*(c.alias(k) for k, c in counts.items())).first().asDict()
        return out

    def note(self, output: str) -> None:
        """Say that the run for ``output`` refers to what it used; what an earlier run for it used is no longer referred to."""
        name = hashlib.sha256(output.encode()).hexdigest()[:32]
        rows = self.spark.createDataFrame([(json.dumps({"output": output, "tables": self.used}),)], "value string")
        rows.coalesce(1).write.mode("overwrite").text(f"{self.folder}/notes/{name}")


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Remove the tables of ``folder`` that no note names; returns their names."""
    folder = folder.rstrip("/")
    at, own = file_system(spark, folder)
    if not own.exists(at):
        return []
    notes, _ = file_system(spark, f"{folder}/notes/*/_SUCCESS")
    named = set()
    for x in own.globStatus(notes) or ():
        for row in spark.read.text(x.getPath().getParent().toString()).collect():
            named |= set(json.loads(row["value"])["tables"])
    gone = []
    for x in own.listStatus(at):
        name = x.getPath().getName()
        if x.isDirectory() and name != "notes" and name not in named:
            own.delete(x.getPath(), True)
            gone.append(name)
    return sorted(gone)
