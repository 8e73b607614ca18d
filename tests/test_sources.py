import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.schemas import POSTS
from textloom.sources import csv_ranges, posts, scratch, sinks
from textloom.sources.scratch import settle


def test_csv_round_trip(spark, tmp_path):
    texts = ['a "quoted", text', "two\nlines", " spaces ", "NA", "", "x,y", "back\\slash", "日本"]
    df = spark.createDataFrame(list(enumerate(texts)), POSTS)
    path = str(tmp_path / "posts.csv")
    sinks.write_table(df, path)
    got = {r.doc_id: r.text for r in posts.read_table(spark, path, POSTS).collect()}
    assert got == {i: (None if t in ("NA", "") else t) for i, t in enumerate(texts)}
    kept = posts.read_table(spark, path, POSTS, drop_missing="text")
    assert kept.count() == len(texts) - 2


@pytest.mark.parametrize("size", [7, 40, 1000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_byte_ranges(spark, tmp_path, size, end):
    rng = random.Random(size)
    parts = ["plain", '""', "\n", "\n\n", ",", "日本", " ", '"",""', "x" * 30]
    for name in ("a", "b"):
        rows = [f"{i},\"{''.join(rng.choices(parts, k=rng.randrange(8)))}\"" for i in range(40)]
        rows += ["40,unquoted text", "", "41,", '42,""', "43,\\N"]
        text = "doc_id,text\n" + "\n".join(rows) + ("\n" if name == "a" else "")
        (tmp_path / f"{name}.csv").write_bytes(text.replace("\n", end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        for missing in (posts.NA_STRINGS, ()):
            want = posts.read_table(spark, str(tmp_path), POSTS, missing=missing, range_bytes=1 << 30)
            got = posts.read_table(spark, str(tmp_path), POSTS, missing=missing, range_bytes=size)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert csv_ranges._lines(spark, str(tmp_path)).select("file", "block").distinct().count() > (2 if size < 1000 else 1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_unpaired_quotes_stay_whole(spark, tmp_path):
    (tmp_path / "x.csv").write_text('doc_id,text\n1,5" pipe\n2,b\n')
    assert not csv_ranges.well_formed(spark, str(tmp_path))
    got = posts.read_table(spark, str(tmp_path), POSTS, range_bytes=1)
    assert [(r.doc_id, r.text) for r in got.orderBy("doc_id").collect()] == [(1, '5" pipe'), (2, "b")]


def test_types_are_inferred_without_a_schema(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    sinks.write_table(spark.createDataFrame([(1, 0.5, "a")], "n int, f double, s string"), path)
    assert [t for _, t in posts.read_table(spark, path).dtypes] == ["int", "double", "string"]


def test_clustered_columns(spark, tmp_path):
    df = spark.range(2).select(
        F.col("id").alias("doc_id"), F.lit(" a  b ").alias("text"), F.lit(0).alias("clust_id"),
        *[F.lit(0.5).alias(f"Dim{i}") for i in (10, 2, 0)], F.lit(True).alias("Drop"), F.lit(1).alias("extra"),
    )
    assert sinks.clustered_columns(df) == ["doc_id", "text", "clust_id", "Dim0", "Dim2", "Dim10", "Drop"]
    sinks.write_clustered(df, str(tmp_path / "a.parquet"))
    assert spark.read.parquet(str(tmp_path / "a.parquet")).first().text == "a b"
    sinks.write_clustered(df, str(tmp_path / "b.parquet"), ["text", "extra"])
    assert spark.read.parquet(str(tmp_path / "b.parquet")).columns == ["text", "extra"]


def test_stopwords(spark, tmp_path):
    (tmp_path / "s.txt").write_text("the of\n and\tthe\n\n")
    words = posts.read_stopwords(spark, str(tmp_path / "s.txt"))
    assert sorted(r.word for r in words.collect()) == ["and", "of", "the"]


def test_settle_uses_the_shared_folder(spark):
    table = settle(spark.range(5), "five")
    assert table.count() == 5
    assert spark.conf.get("spark.checkpoint.dir") in table.inputFiles()[0]


def test_saved_tables_can_be_deleted(spark):
    table = scratch.settle(spark.range(3), "short_lived")
    [path] = table.inputFiles()[0].rsplit("/", 1)[:1]
    assert table.count() == 3
    assert scratch.clear_tables(spark) >= 1
    assert not os.path.exists(path.removeprefix("file://"))
