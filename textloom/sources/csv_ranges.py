"""Large CSV files whose fields hold line ends, read by many tasks.

Spark reads the lines of byte ranges in parallel.  Quotes inside fields are doubled, so a line begins a
record when an even number of quotes comes before it in the file.  Each range counts its quotes, sums
over the ranges of a file give the quotes before each range, and the lines of a record are
put together again where a record goes on in the next range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = ["file", "block"]


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file of a path; contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value, quotes): each line with its byte range and its order there."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, block, before, crlf, whole): quotes before each range, the file's line ends, and whether its quotes are even."""
    first = F.min(F.struct("seq", F.col("value").endswith("\r").alias("crlf")))
    sums = lines.groupBy(*RANGE).agg(F.sum("quotes").alias("n"), first.alias("first"))
    # One row for each range of a file.
    in_file = Window.partitionBy("file")
    before = in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *RANGE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.min(F.struct("block", "first.crlf")).over(in_file)["crlf"].alias("crlf"),
        (F.sum("n").over(in_file) % 2 == 0).alias("whole"),
    )


def well_formed(spark: SparkSession, path: str) -> bool:
    """Whether each file has an even number of quotes, without which its records cannot be told in parallel."""
    return not _ranges(_lines(spark, path)).where("not whole").limit(1).count()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the text of each record, and whether it is the first one of its file."""
    lines = _lines(spark, path)
    ranges = _ranges(lines)
    inside = Window.partitionBy(*RANGE).orderBy("seq")
    earlier = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("earlier", earlier).join(ranges, RANGE)
    begins = ((F.col("before") + F.col("earlier")) % 2 == 0).cast("int")
    plain = F.when(F.col("crlf"), F.regexp_replace("value", r"\r$", "")).otherwise(F.col("value"))
    placed = placed.select(*RANGE, "seq", plain.alias("value"), begins.alias("begins"))
    numbered = placed.withColumn("number", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # A range's first lines may belong to the last record of an earlier range.
    counts = placed.groupBy(*RANGE).agg(F.sum("begins").alias("records"))
    last = F.last(F.when(F.col("records") > 0, F.struct("block", "records")), ignorenulls=True)
    open_before = counts.select(
        *RANGE, last.over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("open")
    )
    keyed = numbered.join(open_before, RANGE).select(
        "file", F.when(F.col("number") > 0, F.col("block")).otherwise(F.col("open.block")).alias("start"),
        F.when(F.col("number") > 0, F.col("number")).otherwise(F.col("open.records")).alias("number"),
        F.struct("block", "seq", "value").alias("line"),
    )
    whole = keyed.groupBy("file", "start", "number").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    return whole.select("file", ((F.col("start") == 0) & (F.col("number") == 1)).alias("first"), text.alias("record"))


def read_csv_ranges(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str | bool]) -> DataFrame:
    """The rows of CSV files with a header line each, by the same parser as Spark's reader."""
    parser = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k not in ("header", "multiLine")}
    rows = records(spark, path).where(~F.col("first") & (F.col("record") != ""))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.select(F.from_csv("record", columns, parser).alias("row")).select("row.*")
