"""Queries for neighbours, density clustering, reduction and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, density, knn, reduce, search, space
from ..sources import sinks
from ..sources.scratch import new_path
from . import fixtures as fx
from . import stages
from .registry import query
from .text_queries import CLEAN_POSTS_SQL, detector, posts

PTS = fx.for_duckdb(fx.PTS)
K = 8
EPS = 1.0


def pts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.in_spark(spark, sf, fx.PTS)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return space.distinct_points(pts(spark, sf), "id", ["x", "y"])


def knn_sql(k: int) -> str:
    return f"""select id, rank::int as rank, nbr, d from (
        select a.id, b.id as nbr, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d,
          row_number() over (partition by a.id order by
            sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) as rank
        from ({PTS}) a join ({PTS}) b on a.id <> b.id) where rank <= {k}"""


KNN_SQL = knn_sql(K)
CORE_SQL = f"select id, d as core from ({KNN_SQL}) where rank = {K}"


@query("knn", KNN_SQL)
def nearest(spark, sf):
    return knn.knn(points(spark, sf), K)


@query("core_distance", CORE_SQL)
def core_distance(spark, sf):
    return knn.core_distance(points(spark, sf), K)


@query(
    "mutual_reach",
    f"""select distinct least(n.id, n.nbr) as a, greatest(n.id, n.nbr) as b,
        greatest(n.d, ca.core, cb.core) as weight
        from ({KNN_SQL}) n join ({CORE_SQL}) ca on ca.id = n.id join ({CORE_SQL}) cb on cb.id = n.nbr""",
)
def mutual_reach(spark, sf):
    return knn.mutual_reach(points(spark, sf), K)


@query(
    "density_cut",
    f"""with recursive core as (
          select c.id, p.x, p.y from ({CORE_SQL}) c join ({PTS}) p using (id) where c.core <= {EPS}),
        edge as (select a.id as a, b.id as b from core a join core b
          on sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {EPS}),
        reach(id, origin) as (
          select id, id from core union select e.b, r.origin from reach r join edge e on e.a = r.id)
        select id, min(origin) as component from reach group by id""",
)
def density_cut(spark, sf):
    return density.density_cut(points(spark, sf), K, EPS)


CUTS = (0.6, 1.0, 1.5, 2.5, 4.0)


@query(
    "tree_cuts",
    f"""with recursive cut as (select unnest([{', '.join(f'{c}::double' for c in CUTS)}]) as cut),
        core as (select cut, c.id, p.x, p.y from ({CORE_SQL}) c join ({PTS}) p using (id) join cut on c.core <= cut),
        edge as (select a.cut, a.id as a, b.id as b from core a join core b on a.cut = b.cut
          and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= a.cut),
        reach(cut, id, origin) as (
          select cut, id, id from core union select r.cut, e.b, r.origin from reach r join edge e on e.a = r.id and e.cut = r.cut)
        select cut, id, min(origin) as component from reach group by cut, id""",
)
def tree_cuts(spark, sf):
    # Small leaves, so that the tree spans many.
    return density.tree_cuts(points(spark, sf), K, CUTS, leaf_rows=64)


@query("hdbscan")
def hdbscan(spark, sf):
    return density.hdbscan(pts(spark, sf), ["x", "y"], 15, key="id")


def blobs(spark: SparkSession, sf: str, clustered: DataFrame) -> DataFrame:
    """For each planted blob: whether one cluster holds most of it, and whether that cluster is its own."""
    label = fx.table(spark, sf, "embeddings").where("vec_id % 20 <> 0").select(F.col("vec_id").alias("id"), "label")
    parts = clustered.select("id", "clust_id").join(label, "id").groupBy("label", "clust_id").agg(F.count("*").alias("n"))
    main = parts.groupBy("label").agg(F.max(F.struct("n", "clust_id")).alias("m"), F.sum("n").alias("rows"))
    owners = main.groupBy("m.clust_id").agg(F.count("*").alias("owners"))
    return main.join(owners, main["m.clust_id"] == owners["clust_id"]).select(
        "label", (F.col("m.n") > 0.75 * F.col("rows")).alias("most"), (F.col("owners") == 1).alias("alone")
    )


BLOBS_SQL = "select label, true as most, true as alone from embeddings where vec_id % 20 <> 0 group by label"


@query("hdbscan_blobs", BLOBS_SQL)
def hdbscan_blobs(spark, sf):
    return blobs(spark, sf, density.hdbscan(pts(spark, sf), ["x", "y"], 15, key="id"))


@query("cluster_search_blobs", BLOBS_SQL)
def cluster_search_blobs(spark, sf):
    return blobs(spark, sf, search.cluster_search(pts(spark, sf), ["x", "y"], key="id").rows)


TRIALS = """select row_number() over (order by k) - 1 as trial, k as min_cluster_size, k as min_samples,
    count(*) filter (n >= k) as n_clusters,
    (coalesce(sum(n) filter (n < k), 0))::bigint as n_outliers,
    coalesce(sum(n) filter (n < k), 0) / sum(n) * 100 as pct_outliers
    from (select label, count(*) as n from embeddings group by 1), unnest([5, 30, 45, 50, 55, 60]) t(k)
    group by k"""


@query(
    "choose_trial",
    f"""select trial::int as trial, min_cluster_size::int as min_cluster_size,
        min_samples::int as min_samples, n_clusters, n_outliers, pct_outliers from ({TRIALS})
        order by case when pct_outliers > 0 and pct_outliers <= 25 then 0 when n_clusters > 10 then 1 else 2 end,
          case when pct_outliers > 0 and pct_outliers <= 25 then -n_clusters else pct_outliers end, trial
        limit 1""",
)
def choose_trial(spark, sf):
    sizes = spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").agg(F.count("*").alias("n"))
    ks = F.array(*[F.lit(k) for k in (5, 30, 45, 50, 55, 60)])
    small = F.coalesce(F.sum(F.when(F.col("n") < F.col("k"), F.col("n"))), F.lit(0))
    trials = (
        sizes.select("n", F.posexplode(ks).alias("trial", "k"))
        .groupBy("trial", "k")
        .agg(
            F.count_if(F.col("n") >= F.col("k")).alias("n_clusters"),
            small.alias("n_outliers"),
            (small / F.sum("n") * 100).alias("pct_outliers"),
        )
        .select("trial", F.col("k").alias("min_cluster_size"), F.col("k").alias("min_samples"),
                "n_clusters", "n_outliers", "pct_outliers")
    )
    return search.choose_trial(trials, lower=10)


BOUNDS_SQL = """select name, n, case when n <= 100 then 5 when n <= 1000 then 10 when n <= 10000 then 20
    else 50 end as lower, case when n <= 100 then 10 when n <= 1000 then 50 when n <= 10000 then 80
    else 120 end as upper from (
    select 'documents' as name, count(*) as n from documents union all
    select 'embeddings', count(*) from embeddings union all
    select 'pages', count(*) from pages)"""


@query("search_bounds", BOUNDS_SQL)
def search_bounds(spark, sf):
    rows = []
    for name in ("documents", "embeddings", "pages"):
        n = spark.read.parquet(f"{sf}/{name}.parquet").count()
        rows.append((name, n, *search.search_bounds(n)))
    return spark.createDataFrame(rows, "name string, n bigint, lower int, upper int")


@query("cluster_search")
def cluster_search(spark, sf):
    return search.cluster_search(pts(spark, sf), ["x", "y"], key="id").rows


# Reduction.


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.table(spark, sf, "embeddings")
    return table.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("embeddings"), "label")


@query(
    "attach_dims",
    f"""select d.doc_id, d.lang, p.x as "Dim0", p.y as "Dim1"
        from documents d join ({PTS}) p on p.id = d.doc_id % (select count(*) from embeddings)""",
)
def attach_dims(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang")
    # Every document has a point: the points repeat where there are fewer.
    points_of = fx.in_spark(
        spark, sf, "select doc_id, doc_id % (select count(*) from {embeddings}) as id from {documents}"
    )
    dims = points_of.join(pts(spark, sf), "id").select("doc_id", F.col("x").alias("Dim0"), F.col("y").alias("Dim1"))
    return reduce.attach_dims(docs, dims)


@query("reduce_pca")
def reduce_pca(spark, sf):
    return reduce.reduce_pca(vectors(spark, sf), 3).drop("embeddings")


NEAR = 15


@query(
    "fuzzy_graph",
    f"""with recursive near as (select * from ({knn_sql(NEAR)})),
      p as (select id, list(d order by rank) as ds, min(d) as rho from near group by id),
      search(id, i, lo, hi, mid) as (
        select id, 0, 0.0::double, 'infinity'::double, 1.0::double from p
        union all
        select id, i + 1, new_lo, new_hi,
          case when new_hi = 'infinity'::double then mid * 2 else (new_lo + new_hi) / 2 end
        from (select s.id, s.i, s.mid,
                case when t.high then s.lo else s.mid end as new_lo,
                case when t.high then s.mid else s.hi end as new_hi
              from search s join p on p.id = s.id, lateral (
                select list_sum(list_transform(p.ds, lambda d: exp(-greatest(0.0, d - p.rho) / s.mid)))
                  > log2({NEAR}) as high) t
              where s.i < {reduce.SIGMA_STEPS})),
      sigma as (select id, mid as sigma from search where i = {reduce.SIGMA_STEPS}),
      arrows as (
        select least(n.id, n.nbr) as a, greatest(n.id, n.nbr) as b,
          exp(-greatest(0.0, n.d - p.rho) / s.sigma) as w
        from near n join p on p.id = n.id join sigma s on s.id = n.id)
      select a, b, round(sum(w) - case when count(*) = 2 then min(w) * max(w) else 0 end, 6) as weight
      from arrows group by a, b""",
)
def fuzzy_graph(spark, sf):
    lists = knn.neighbour_lists(space.into_leaves(points(spark, sf)), NEAR)
    return reduce.fuzzy_graph(lists, NEAR).withColumn("weight", F.round("weight", 6))


@query(
    "vector_neighbours",
    f"""select id, rank::int as rank, nbr, d from (
          select a.vec_id as id, b.vec_id as nbr, round(list_distance(a.v, b.v), 6) as d,
            row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as rank
          from (select vec_id, embedding::double[] as v from embeddings) a
          join (select vec_id, embedding::double[] as v from embeddings) b on a.vec_id <> b.vec_id)
        where rank <= {NEAR}""",
)
def vector_neighbours(spark, sf):
    lists = reduce.vector_neighbours(vectors(spark, sf), NEAR)
    near = lists.select("id", F.posexplode("nbrs").alias("pos", "n"))
    return near.select("id", (F.col("pos") + 1).alias("rank"), F.col("n.id").alias("nbr"), F.round("n.d", 6).alias("d"))


@query("reduce_umap")
def reduce_umap(spark, sf):
    return reduce.reduce_umap(vectors(spark, sf), 2).drop("embeddings")


# Near-duplicates.

CENTROID_SQL = """
with parts as (
  select vec_id, label, i as pos, embedding[i]::double as x
  from embeddings, unnest(range(1, len(embedding) + 1)) t(i)),
means as (select label, pos, avg(x) as m from parts group by all)
select p.vec_id as doc_id, p.label, sum(p.x * m.m) / (sqrt(sum(p.x * p.x)) * sqrt(sum(m.m * m.m))) as cosine_sim
from parts p join means m on m.label = p.label and m.pos = p.pos group by all
"""
SIMILAR = 0.2


@query(
    "centroid_similarity",
    f"select doc_id, label, round(cosine_sim, 6) as cosine_sim from ({CENTROID_SQL})",
)
def centroid_similarity(spark, sf):
    rows = dedup.centroid_similarity(vectors(spark, sf), "label")
    return rows.select("doc_id", "label", F.round("cosine_sim", 6).alias("cosine_sim"))


@query(
    "semdup_flag",
    f"""select doc_id, cosine_sim > {SIMILAR} as similar, cosine_sim > {SIMILAR} as "Drop" from ({CENTROID_SQL})""",
)
def semdup_flag(spark, sf):
    rows = dedup.flag_similar(dedup.centroid_similarity(vectors(spark, sf), "label"), SIMILAR)
    return rows.select("doc_id", "similar", "Drop")


@query(
    "semantic_dedup",
    f"""with v as ({fx.for_duckdb(fx.DUP_VECS)})
        select doc_id, label from v a where not exists (
          select 1 from v b where b.label = a.label and b.doc_id < a.doc_id
            and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) > {dedup.THRESHOLD})""",
)
def semantic_dedup(spark, sf):
    rows = fx.in_spark(spark, sf, fx.DUP_VECS)
    return dedup.semantic_dedup(rows, "label", vector_col="embedding").select("doc_id", "label")


@query("kmeans_assign")
def kmeans_assign(spark, sf):
    return dedup.kmeans_groups(vectors(spark, sf)).select("doc_id", "klabel")


@query("sdedup")
def sdedup(spark, sf):
    rows = dedup.sdedup(vectors(spark, sf))
    return rows.select("doc_id", "klabel", "cosine_sim", "similar", "Drop")


@query("stage_one")
def stage_one(spark, sf):
    found = stages.stage_one(posts(spark, sf), detector(spark, sf))
    path = new_path(spark, "clustered") + ".parquet"
    sinks.write_clustered(found.rows, path)
    return spark.read.parquet(path)


@query(
    "stage_one_texts",
    f"select doc_id, text, true as clustered, true as placed from ({CLEAN_POSTS_SQL})",
)
def stage_one_texts(spark, sf):
    return stage_one(spark, sf).select(
        "doc_id", "text", (F.col("clust_id") >= -1).alias("clustered"),
        (F.col("Dim0").isNotNull() & F.col("Dim1").isNotNull()).alias("placed"),
    )
