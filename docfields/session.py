"""Session defaults and the shared place for intermediate tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docfields")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows that are small but costly to work on by their keys to ``spark.sql.shuffle.partitions`` tasks.

    The count is explicit, so adaptive execution does not merge the tasks by their few bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def large(df: DataFrame) -> DataFrame:
    """A join side that is shuffled and never broadcast.

    Spark knows a side's size from its files and columns only: exploded rows, join keys made in Python and names made from
    numbers are many times larger, and a broadcast of them goes through the driver.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only on one machine (a ``local[...]`` master, as in tests) a temporary folder stands in; a cluster that names none is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder, so that the cut survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder as compressed Parquet and read it back: a cut for many rows, which a checkpoint would leave unpacked."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/docfields-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
