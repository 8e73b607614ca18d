"""Written tables in the shared checkpoint folder.

A written table cuts the lineage, survives the loss of executors, and gives
Catalyst a true size, so that its own check decides whether to broadcast it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_made: list[str] = []  # paths given out since the last clear_tables


def new_path(spark: SparkSession, name: str) -> str:
    """Path in the checkpoint folder that no other table uses."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_tables(spark: SparkSession) -> int:
    """Delete the tables at all paths given out so far; call it when their results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, read back from a Parquet table in the checkpoint folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
