"""Sampling on a table where one cluster holds a third of the rows and more."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators import rep_text, sample


@pytest.fixture(scope="module")
def skewed(spark):
    cluster = F.when(F.col("id") % 3 == 0, -1).otherwise((F.col("id") % 7).cast("int"))
    return spark.range(0, 5000, numPartitions=6).select(
        F.col("id").alias("doc_id"), cluster.alias("clust_id"),
        F.concat(F.lit("w "), F.repeat(F.lit("x "), (F.col("id") * 7919 % 30).cast("int"))).alias("text"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 3).alias("source"),
    ).withColumn("num_tokens", F.size(F.split("text", " ")) + 1).cache()


def by_cluster(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.clust_id].append(r)
    return groups


def h(i):
    return hashlib.md5(f"8:{i}".encode()).hexdigest()


def test_longest_rows(skewed):
    got = by_cluster(sample.longest_rows(skewed).collect())
    for c, rows in by_cluster(skewed.collect()).items():
        want = sorted(rows, key=lambda r: (-r.num_tokens, r.doc_id))[:40]
        assert [r.doc_id for r in sorted(got[c], key=lambda r: r.rank)] == [r.doc_id for r in want]


def test_shuffle_and_half(skewed):
    full, half = by_cluster(sample.shuffled_rows(skewed).collect()), by_cluster(sample.half_rows(skewed).collect())
    for c, rows in by_cluster(skewed.collect()).items():
        want = sorted((r.doc_id for r in rows), key=h)
        assert [r.doc_id for r in sorted(full[c], key=lambda r: r.rank)] == want
        assert [r.doc_id for r in sorted(half[c], key=lambda r: r.rank)] == want[: round(len(want) / 2)]


def test_stratified(skewed):
    got = by_cluster(sample.stratified_rows(skewed, "source").collect())
    for c, rows in by_cluster(skewed.collect()).items():
        strata = defaultdict(list)
        for r in rows:
            if r.source is not None:
                strata[r.source].append(r.doc_id)
        least = min(map(len, strata.values()))
        want = sorted((i for ids in strata.values() for i in sorted(ids, key=h)[:least]), key=h)
        assert [r.doc_id for r in sorted(got[c], key=lambda r: r.rank)] == want


@pytest.mark.parametrize("how", [{"random": False}, {}, {"sampling_col": "source"}])
def test_rep_text_is_a_prefix_within_budget(skewed, how):
    got = {r.clust_id: r for r in rep_text.rep_text(skewed, 400, 20, **how).collect()}
    for c, rows in by_cluster(skewed.collect()).items():
        if how.get("random", True):
            pool = sorted(rows, key=lambda r: h(r.doc_id))
            if "sampling_col" in how:
                ids = {r.doc_id for r in sample.stratified_rows(skewed, "source").where(f"clust_id = {c}").collect()}
                pool = [r for r in pool if r.doc_id in ids]
        else:
            pool = sorted(rows, key=lambda r: (-r.num_tokens, r.doc_id))[:40]
        total, want = 20, []
        for r in pool:
            if total + r.num_tokens >= 180:
                break
            total += r.num_tokens
            want.append(r.text)
        assert got[c].rep_text == "\n".join(want)
        assert got[c].n_rows == len(rows)


def test_cluster_stays_when_its_first_text_is_over_budget(spark):
    rows = [(1, 0, "long " * 200), (2, 0, "short"), (3, 1, "short"), (4, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, clust_id int, text string")
    got = {r.clust_id: (r.rep_text, r.n_rows) for r in rep_text.rep_text(df, 200, 10, random=False).collect()}
    assert got == {0: ("", 2), 1: ("short", 2)}


def test_one_stratum_means_plain_random(spark):
    rows = [(i, 0, f"t{i}", "a" if i else None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, clust_id int, text string, s string")
    plain = rep_text.rep_text(df, 400, 10).first().rep_text
    assert rep_text.rep_text(df, 400, 10, sampling_col="s").first().rep_text == plain
