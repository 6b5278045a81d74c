"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str | int = "*", app: str = "taxaloom", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects of a cluster (AQE on, UTC, Arrow on)."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one (only where it is unset and all runs in one process).

    The local folder goes at the end of the process; what is in the shared one is the cluster's to clean.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = getattr(spark, "_taxaloom_dir", None)
        if where is None:
            folder = tempfile.mkdtemp(prefix="taxaloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            where = spark._taxaloom_dir = f"file://{folder}"
    return where.rstrip("/")


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package where it runs from a checkout and not from an installation."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = spark.sparkContext.environment
    paths = own.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        own["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def file_system(spark: SparkSession, path: str) -> tuple:
    """A path and the file system that it lies in, as Spark reaches them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """The tables that ``stored`` wrote since ``scratch`` was entered."""

    def __init__(self) -> None:
        self.paths: dict[str, None] = {}

    def add(self, df: DataFrame) -> DataFrame:
        """The table goes with these, whoever stored it."""
        self.paths[df._taxaloom_path] = None
        return df

    def keep(self, df: DataFrame) -> DataFrame:
        """The table that was stored stays."""
        self.paths.pop(getattr(df, "_taxaloom_path", ""), None)
        return df


_open: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Remove the tables that are stored within, once it is left, however it is; those that are kept stay.

    For what ends in a file, a table or an action: what is returned from within must not read them any more.
    """
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
        for path in own.paths:
            at, files = file_system(spark, path)
            files.delete(at, True)


#: Spark's setting by which the shuffle files of a job are removed at its end; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    What was shuffled on the way is removed once it is written, so a query's disk holds its tables and one job's shuffles.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].paths[path] = None
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._taxaloom_path = path
    return out


def observed(df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict]:
    """``stored``, and the values of these aggregates over the rows, taken while they are written."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = stored(df.observe(seen, *(c.alias(k) for k, c in what.items())), name)
    return out, seen.get
