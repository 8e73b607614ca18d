"""Views derived from the given tables, in SQL that Spark and DuckDB both take.

The given documents hold no URL, emoji, removed marker or missing text, and the
given vectors hold no clusters, so these views plant them.  All rows stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.posts import spread
from ..sources.scratch import settle

SENT_ROWS = 1 << 20  # rows of two numbers that go to all tasks

# Documents with URLs, emoji and removed markers.
POSTS = """
select d.doc_id, d.lang, d.source, concat(
  case when d.doc_id % 97 = 0 then '[removed]'
       when d.doc_id % 89 = 0 then '[deleted]' else d.text end,
  case when d.doc_id % 5 = 0 and d.doc_id % 97 <> 0 and d.doc_id % 89 <> 0
       then concat(' see ', p.url, ' ok') else '' end,
  case when d.doc_id % 7 = 0 and d.doc_id % 97 <> 0 then ' ☃ 😀' else '' end) as text
from (select doc_id, lang, source, text, doc_id % (select count(*) from {pages}) as page_id
      from {documents}) d
left join {pages} p on p.page_id = d.page_id
"""

# Posts as they may come from a file, with strings that stand for a missing text.
RAW_POSTS = f"""
select doc_id, case when doc_id % 83 = 0 then 'NA' when doc_id % 79 = 0 then 'null'
                    else text end as text
from ({POSTS}) p
"""

# Every document with a cluster; label 0 of the vectors stands for noise.
CLUSTERED = """
select d.doc_id, d.text, d.source, cast(e.label - 1 as int) as clust_id
from (select doc_id, text, source, doc_id % (select count(*) from {embeddings}) as vec_id
      from {documents}) d
join {embeddings} e on e.vec_id = d.vec_id
"""

# Ten planted blobs and scattered points.
PTS = """
select vec_id as id,
  (label % 5) * 10 + case when vec_id % 20 = 0 then 3.0 + vec_id % 7 else 0 end
    + cast(embedding[{a}] as double) * 4 as x,
  cast(floor(label / 5) as int) * 10 + case when vec_id % 20 = 0 then 3.0 + vec_id % 11 else 0 end
    + cast(embedding[{b}] as double) * 4 as y
from {embeddings}
"""

# Vectors with an exact copy of each tenth.
DUP_VECS = """
select vec_id as doc_id, embedding, label from {embeddings}
union all
select vec_id + 1000000 as doc_id, embedding, label from {embeddings} where vec_id % 10 = 0
"""

TABLES = ("documents", "pages", "embeddings", "benchmark", "conversations", "labels")


def for_duckdb(sql: str) -> str:
    return sql.format(a=1, b=2, **{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "embeddings") else df


def in_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("{a}", "0").replace("{b}", "1"), **used)


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLUSTERED.  Up to SENT_ROWS clusters go to the texts, which then are not shuffled."""
    labels = settle(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vector labels")
    few = labels.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return spark.sql(CLUSTERED, documents=table(spark, sf_dir, "documents"), embeddings=F.broadcast(labels) if few else labels)
