"""Search for the cluster size that gives a wanted number of clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .aggregate import cluster_stats
from .condense import GROUP_ROWS
from .density import cluster_points, label_rows
from .knn import core_table
from .space import LEAF_ROWS, distinct_points, into_leaves

# Fixed values of the search.
BOUNDS = ((100, 5, 10), (1000, 10, 50), (10000, 20, 80))
BOUNDS_ABOVE = (50, 120)
SMALLEST, LARGEST = 5, 1023
MAX_NOISE = 25.0
AHEAD = 5  # steps that small tables fit together
SEARCH_LEAF_ROWS = 1 << 16  # points of a leaf, whose tree costs little more than in small leaves; many leaves cost rounds
LEAVES = 16  # leaves that share out the work of a table, as far as they have LEAF_ROWS


def search_bounds(size: int) -> tuple[int, int]:
    """Wanted lowest and highest number of clusters for a table of this many rows."""
    for most, lower, upper in BOUNDS:
        if size <= most:
            return lower, upper
    return BOUNDS_ABOVE


def choose_trial(trials: DataFrame, lower: int, prefer: str = "most") -> DataFrame:
    """The trial to keep, as a table of one row.

    Among trials with some noise but at most 25 per cent, the one with the most
    clusters (``prefer='fewest'``: the fewest).  Without any, the least noise
    among those with over ``lower`` clusters, and without these among all.  The
    first trial wins a tie.
    """
    noise, clusters = F.col("pct_outliers"), F.col("n_clusters")
    tier = (
        F.when((noise > 0) & (noise <= MAX_NOISE), 0).when(clusters > lower, 1).otherwise(2)
    )
    by_clusters = clusters if prefer == "fewest" else -clusters
    value = F.when(tier == 0, by_clusters.cast("double")).otherwise(noise)
    whole = F.struct(tier.alias("tier"), value.alias("value"), "trial", F.struct(*trials.columns).alias("row"))
    return trials.agg(F.min(whole).alias("best")).where("best is not null").select("best.row.*")


def falling(low: int, high: int, steps: int) -> list[int]:
    """The sizes that the next steps try when each one finds too few clusters."""
    sizes = []
    while low <= high and len(sizes) < steps:
        sizes.append(low + (high - low) // 2)
        high = sizes[-1] - 1
    return sizes


@dataclass
class Search:
    """All trials, the chosen one, and the rows with its clusters."""

    trials: DataFrame
    chosen: DataFrame
    rows: DataFrame


def cluster_search(
    df: DataFrame,
    dims: list[str],
    key: str = "doc_id",
    prefer: str = "most",
    leaf_rows: int | None = None,
    group_rows: int = GROUP_ROWS,
) -> Search:
    """Bisect min_cluster_size until the number of clusters is within the bounds.

    Each of the at most ten steps fits two trials together, with min_samples equal
    to the cluster size and to half of it; the second one steers.  The points and the
    cells are made once, the core distances once and again where the search goes up, only those
    that it needs until it next does; only the statistics of the trials come to the driver.
    On tables of up to ``group_rows`` places a step costs Spark more in jobs than in work, so the
    sizes that follow when the search goes down are fitted in the same jobs; only trials that the
    search comes to count.
    """
    spark = df.sparkSession
    points = settle(distinct_points(df, key, dims), "points")
    size = points.agg(F.sum("w")).first()[0] or 0
    if not size:
        raise ValueError("the table to cluster has no rows")
    lower, upper = search_bounds(size)
    places = points.count()
    if leaf_rows is None:
        leaf_rows = min(max(LEAF_ROWS, places // LEAVES), SEARCH_LEAF_ROWS)
    leaves = into_leaves(points, max(leaf_rows, 4 * min(LARGEST, places)))
    steps = AHEAD if places <= group_rows else 1
    low, high = SMALLEST, LARGEST
    trials: list[tuple] = []
    labels: list[DataFrame] = []
    held, cores = [], None  # sample sizes in the core table
    fitted: dict[int, list[DataFrame]] = {}
    while low <= high:
        middle = low + (high - low) // 2
        samples = [middle, middle // 2]
        if not set(samples) <= set(held):
            # Those that the search needs until it goes up.
            held = sorted({ms for size in falling(low, high, LARGEST) for ms in (size, size // 2)})
            cores = settle(core_table(leaves, held[-1], held), "core table")
        first = len(trials)
        if middle not in fitted:
            sizes = falling(low, high, steps)
            settings = [(size, ms, 0.0) for size in sizes for ms in (size, size // 2)]
            found = settle(cluster_points(leaves, settings, group_rows, cores, held), "trial")
            fitted |= {s: [found.where(F.col("trial") == 2 * i + j) for j in range(2)] for i, s in enumerate(sizes)}
        labels += fitted[middle]
        for i, ms in enumerate(samples):
            stats = cluster_stats(labels[first + i], weight=F.col("w")).first()
            trials.append(
                (first + i, middle, ms, stats.n_clusters, stats.n_outliers, stats.pct_outliers)
            )
        n = trials[-1][3]
        if n > upper:
            low = middle + 1
        elif n < lower:
            high = middle - 1
        else:
            break
    table = spark.createDataFrame(
        trials,
        "trial int, min_cluster_size int, min_samples int, n_clusters bigint, "
        "n_outliers bigint, pct_outliers double",
    )
    chosen = choose_trial(table, lower, prefer)
    best = labels[chosen.first().trial].select("id", "clust_id")
    return Search(table, chosen, label_rows(df, dims, points, best))
