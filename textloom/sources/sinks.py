"""Writers.  No writer ever replaces the table it reads from."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_spaces
from .posts import CSV_OPTIONS, NULL_MARK

OPTIONAL_COLUMNS = ("text_no_urls", "extracted_urls", "Drop")


def clustered_columns(df: DataFrame) -> list[str]:
    """Default columns of a clustered table: text, cluster, dimensions, then what exists."""
    dims = sorted(
        (c for c in df.columns if re.fullmatch(r"Dim\d+", c)), key=lambda c: int(c[3:])
    )
    key = [c for c in ("doc_id",) if c in df.columns]
    return key + ["text", "clust_id"] + dims + [c for c in OPTIONAL_COLUMNS if c in df.columns]


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write CSV or, for a path that ends in ``.parquet``, Parquet."""
    writer = df.write.mode(mode)
    if path.rstrip("/").endswith(".parquet"):
        writer.parquet(path)
    else:
        options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
        options |= {"nullValue": NULL_MARK, "emptyValue": '""'}
        writer.options(**options).csv(path)


def write_clustered(df: DataFrame, path: str, cols: list[str] | None = None) -> None:
    """Write clustered rows.  With default columns the text is normalised once more."""
    if cols is None:
        df = df.withColumn("text", normalize_spaces(F.col("text")))
        cols = clustered_columns(df)
    write_table(df.select(*cols), path)
