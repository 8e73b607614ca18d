"""Readers for posts, clustered rows, label tables and stopwords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import NA_STRINGS, SPACES
from .csv_ranges import largest_file, read_csv_ranges, well_formed

# Quotes inside fields are doubled, and a field may hold line ends.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

RANGE_BYTES = 128 << 20  # Spark's own default for a task
NULL_MARK = r"\N"  # null in the CSV files of this library, as databases write it


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small input; an input with enough partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def blank_to_null(df: DataFrame, missing: Sequence[str] = NA_STRINGS) -> DataFrame:
    """Strings that stand for a missing value become null."""
    if not missing:
        return df
    fields = df.schema.fields
    return df.select(
        *[
            F.when(~F.col(f"`{f.name}`").isin(*missing), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in fields
        ]
    )


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    drop_missing: str | list[str] | None = None,
    missing: Sequence[str] = NA_STRINGS,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Read a CSV or Parquet table; optionally drop rows where a column is missing.

    Without a schema, the types of a CSV are inferred, which reads it twice.  In a CSV the
    usual strings for a missing value are missing; Parquet has nulls, so its strings stay.
    Tables that this library wrote tell null (``NULL_MARK``) from the empty text: read them
    with ``missing=()`` and every string comes back.

    A CSV field may hold line ends, so Spark gives a file to one task.  With a schema, files larger than
    one task's share (``range_bytes``) are cut into byte ranges; files whose quotes are
    not paired stay whole.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        options = CSV_OPTIONS if missing else CSV_OPTIONS | {"nullValue": NULL_MARK}
        reader = spark.read.options(**options)
        if schema and largest_file(spark, path) > range_bytes and well_formed(spark, path):
            df = read_csv_ranges(spark, path, schema, options)
        else:
            df = reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)
        df = blank_to_null(df, missing)
    if drop_missing:
        df = df.na.drop(subset=[drop_missing] if isinstance(drop_missing, str) else drop_missing)
    return df


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """Table of stopwords from a text file whose words are separated by spaces."""
    return (
        spark.read.text(path)
        .select(F.explode(F.split("value", SPACES)).alias("word"))
        .where(F.col("word") != "")
        .distinct()
    )
