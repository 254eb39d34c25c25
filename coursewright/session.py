"""Session set-up, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set on every session this package builds; a session handed in keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_SCRATCH: list[str] = []


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "coursewright", **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for lineage cuts; only a local master (tests) may fall back to one of its own."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not named and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "coursewright-checkpoints"))
    return jsc.getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends or by ``drop_scratch``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the tables written so far; for long sessions, once their results are stored elsewhere."""
    jvm = spark.sparkContext._jvm
    while _SCRATCH:
        at = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back: later jobs neither recompute it nor depend on an executor.

    Columns are compressed, later reads take only those they need, and the
    planner sees the table's real size instead of an estimate carried along.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that may grow with the data: never broadcast, neither by estimate nor at run time."""
    return df.hint("merge")


#: Rows up to which ``sized`` broadcasts a narrow table.
SMALL_ROWS = 50_000


def sized(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A narrow side of a join (keys and numbers, no texts): broadcast if it is counted to hold at most ``rows`` rows, else shuffled."""
    return F.broadcast(df) if df.count() <= rows else apart(df)
