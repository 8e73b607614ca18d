"""Exact nearest neighbours of points in few dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .buckets import BUCKET, Buckets, bucket_order
from .space import LEAF_ROWS, Leaves, dealt, into_leaves, visits

NEIGHBOUR = "struct<d: double, id: bigint, w: bigint>"
CHUNK = 256


def distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of every q to every p, summed dimension by dimension."""
    total = np.zeros((len(q), len(p)))
    for i in range(p.shape[1]):
        step = q[:, i, None] - p[None, :, i]
        total += step * step
    return np.sqrt(total)


def coordinates(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["p"].to_numpy()) if len(pdf) else np.zeros((0, 1))


def _nearest(d: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int, within: float = np.inf) -> list[tuple]:
    """The k nearest of one row of distances, by distance and then id."""
    if k < len(d):
        within = min(within, np.partition(d, k - 1)[k - 1])
    near = np.flatnonzero((d <= within) & (d < np.inf))
    near = near[np.lexsort((ids[near], d[near]))][:k]
    return list(zip(d[near].tolist(), ids[near].tolist(), w[near].tolist()))


def _as_column(lists: list[list[tuple]]) -> pd.Series:
    return pd.Series([[{"d": d, "id": i, "w": c} for d, i, c in one] for one in lists], dtype=object)


def _leaf_neighbours(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        p, ids, w = coordinates(pdf), pdf["id"].to_numpy(), pdf["w"].to_numpy()
        lists = []
        for start in range(0, len(p), CHUNK):
            d = distances(p[start : start + CHUNK], p)
            d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
            lists += [_nearest(row, ids, w, k) for row in d]
        return pd.DataFrame(
            {"id": ids, "p": pdf["p"], "w": w, "level": pdf["level"], "cell": pdf["cell"],
             "nbrs": _as_column(lists)}
        )

    return run


def _visitor_neighbours(k: int):
    def run(leaf: pd.DataFrame, callers: pd.DataFrame) -> pd.DataFrame:
        p, ids, w = coordinates(leaf), leaf["id"].to_numpy(), leaf["w"].to_numpy()
        q, r = coordinates(callers), callers["r"].to_numpy()
        lists = []
        for start in range(0, len(q) if len(p) else 0, CHUNK):
            d = distances(q[start : start + CHUNK], p)
            lists += [_nearest(row, ids, w, k, at) for row, at in zip(d, r[start:])]
        return pd.DataFrame(
            {"id": callers["id"].to_numpy()[: len(lists)],
             "nbrs": _as_column(lists)}
        )

    return run


def _calls(inner: DataFrame, last: Column, leaves: Leaves, k: int) -> DataFrame:
    """Visits (id, p, r, level, cell) to other leaves of points whose ball sticks out of their own.

    ``last`` is the distance that the own leaf gives for the k-th neighbour, null when it has fewer.
    """
    # The cell above holds more than k points, so its diagonal bounds the radius.
    diagonal = 2 * (leaves.dim**0.5) * leaves.width(F.col("level"))
    width = leaves.width(F.col("level"))
    room = F.least(
        *[
            side
            for i, lo in enumerate(leaves.low)
            for side in (
                F.col("p")[i] - (F.lit(lo) + F.col("cell")[i] * width),
                F.lit(lo) + (F.col("cell")[i] + 1) * width - F.col("p")[i],
            )
        ]
    )
    sticking = (
        inner.withColumn("r", F.least(last, diagonal))  # least() leaves nulls out
        .where(F.col("r") > room * (1 - 1e-9))
        .select("id", "p", "r", F.col("level").alias("own_level"), F.col("cell").alias("own_cell"))
    )
    calls = visits(sticking, leaves, enough=k + 1).where(
        (F.col("level") != F.col("own_level"))
        | (F.to_json("cell") != F.to_json("own_cell"))
    )
    return calls.select("id", "p", "r", "level", "cell")


def neighbour_lists(leaves: Leaves, k: int) -> DataFrame:
    """Adds ``nbrs``: the k nearest other points, by distance and then id.

    Each leaf finds neighbours inside itself.  Points whose ball sticks out of
    their leaf then visit the other leaves it touches, and the lists are merged.
    """
    schema = f"id bigint, p array<double>, w bigint, level int, cell array<int>, nbrs array<{NEIGHBOUR}>"
    inner = leaves.points.groupBy("level", "cell").applyInPandas(_leaf_neighbours(k), schema)
    if leaves.single:
        return inner
    inner = settle(inner, "inner")
    last = F.when(F.size("nbrs") >= k, F.col("nbrs")[k - 1]["d"])
    calls = _calls(inner, last, leaves, k)
    outer = (
        leaves.points.groupBy("level", "cell")
        .cogroup(calls.groupBy("level", "cell"))
        .applyInPandas(_visitor_neighbours(k), f"id bigint, nbrs array<{NEIGHBOUR}>")
        .groupBy("id")
        .agg(F.flatten(F.collect_list("nbrs")).alias("outer"))
    )
    both = F.array_sort(F.concat("nbrs", F.coalesce("outer", F.array().cast(f"array<{NEIGHBOUR}>"))))
    return settle(
        inner.join(outer, "id", "left").withColumn("nbrs", F.slice(both, 1, k)).drop("outer"), "neighbours"
    )


def knn(points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows (id, rank, nbr, d) of the k nearest other points of every point."""
    leaf_rows = max(leaf_rows, 4 * k)
    lists = neighbour_lists(into_leaves(points, leaf_rows), k)
    return lists.select("id", F.posexplode("nbrs").alias("pos", "n")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("n.id").alias("nbr"), F.col("n.d").alias("d")
    )


def core_from_list(min_samples: int) -> Column:
    """Distance at which a point has ``min_samples`` other rows around it.

    A row does not count itself, but its copies count.  Infinite when the table
    has too few rows.
    """
    start = F.struct((F.col("w") - 1).alias("rows"), F.lit(0.0).alias("d"))
    reached = F.aggregate(
        "nbrs",
        start,
        lambda acc, n: F.when(acc["rows"] >= min_samples, acc).otherwise(
            F.struct((acc["rows"] + n["w"]).alias("rows"), n["d"].alias("d"))
        ),
    )
    return F.when(reached["rows"] >= min_samples, reached["d"]).otherwise(F.lit(float("inf")))


def _cores(q: np.ndarray, own: np.ndarray, p: np.ndarray, w: np.ndarray, samples: Sequence[int]) -> np.ndarray:
    """Core distances of the points at the positions ``own`` of the table (p, w)."""
    cores = np.full((len(q), len(samples)), np.inf)
    plain = bool((w == 1).all())
    for start in range(0, len(q), CHUNK):
        d = distances(q[start : start + CHUNK], p)
        rows, at = np.arange(len(d)), own[start : start + CHUNK]
        d[rows, at] = np.inf
        if plain:
            wanted = [ms for ms in samples if ms < len(p)]
            if wanted:
                d.partition([ms - 1 for ms in wanted], axis=1)
            for j, ms in enumerate(samples):
                if ms < len(p):
                    cores[start + rows, j] = d[:, ms - 1]
            continue
        order = np.argsort(d, axis=1)
        seen = np.cumsum(w[order], axis=1) - w[at, None] * (order == at[:, None]).cumsum(axis=1)
        seen += w[at, None] - 1
        for j, ms in enumerate(samples):
            place = np.minimum((seen < ms).sum(axis=1), len(p) - 1)
            cores[start + rows, j] = np.where(w[at] > ms, 0.0, d[rows, order[rows, place]])
    return cores


def core_distances(leaves: Leaves, samples: Sequence[int], lists: DataFrame | None = None) -> DataFrame:
    """Points with ``cores``: one core distance for each sample size.

    A table of one leaf is small by definition; all tasks get it whole and share
    out its points.
    """
    if not leaves.single:
        lists = lists if lists is not None else neighbour_lists(leaves, max(samples))
        return lists.withColumn("cores", F.array(*[core_from_list(ms) for ms in samples])).drop("nbrs")
    schema = "id bigint, p array<double>, w bigint, level int, cell array<int>, cores array<double>"
    return _with_whole_table(leaves, schema, lambda q, own, p, w: _cores(q, own, p, w, samples))


def _with_whole_table(leaves: Leaves, schema: str, cores: Callable[..., np.ndarray]) -> DataFrame:
    """The points of a single leaf with ``cores``, from all of its points."""
    spark = leaves.points.sparkSession
    table = leaves.points.select("id", "p", "w").toPandas().sort_values("id")  # at most leaf_rows rows
    shared = spark.sparkContext.broadcast(
        (table["id"].to_numpy(), coordinates(table), table["w"].to_numpy())
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, p, w = shared.value
        for pdf in batches:
            out = pdf.copy()
            own = np.searchsorted(ids, pdf["id"].to_numpy())
            out["cores"] = list(cores(coordinates(pdf), own, p, w))
            yield out

    columns = ["id", "p", "w", "level", "cell"]
    return leaves.points.select(*columns).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, schema)


def _all_cores(q: np.ndarray, own: np.ndarray, p: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Core distances for 1 to k samples of the points at the positions ``own`` of the table (p, w)."""
    cores = np.full((len(q), k), np.inf)
    plain, most, wanted = bool((w == 1).all()), min(k, len(p) - 1), np.arange(1, k + 1)
    for start in range(0, len(q), CHUNK):
        d = distances(q[start : start + CHUNK], p)
        rows, at = np.arange(len(d)), own[start : start + CHUNK]
        d[rows, at] = np.inf
        if plain:
            if 0 < most < len(p):
                d.partition(most - 1, axis=1)
            cores[start + rows, :most] = np.sort(d[:, :most], axis=1)
            continue
        order = np.argsort(d, axis=1)[:, :-1]
        for i in rows.tolist():
            seen = np.cumsum(w[order[i]]) + (w[at[i]] - 1)
            place = np.searchsorted(seen, wanted)
            there = place < len(seen)
            cores[start + i, there] = d[i, order[i, place[there]]]
            cores[start + i, : w[at[i]] - 1] = 0.0
    return cores


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().to_numpy(zero_copy_only=False)


def _places(table: pa.Table) -> np.ndarray:
    """The coordinates of a group."""
    if not table.num_rows:
        return np.zeros((0, 1))
    values = table.column("p").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, -1)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of doubles as one column, without a Python object for each number."""
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))))
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float64()))


def _row_distances(d: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """The k least of one row of distances, each as often as rows share the place."""
    at = np.argpartition(d, k - 1)[:k] if k < len(d) else np.arange(len(d))
    at = at[d[at] < np.inf]
    at = at[np.argsort(d[at])]
    return np.repeat(d[at], np.minimum(w[at], k))[:k]


def _near_rows(d: np.ndarray, w: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of distances its k least, each as often as rows share the place."""
    if not (w <= 1).all():
        return [_row_distances(row, w, k) for row in d]
    if k < d.shape[1]:
        d.partition(k - 1, axis=1)
    near = np.sort(d[:, :k], axis=1)
    return [row[:n] for row, n in zip(near, (near < np.inf).sum(axis=1).tolist())]


def _room(p: np.ndarray, level: int, cell: np.ndarray, low: np.ndarray, extent: float) -> np.ndarray:
    """How far points of a cell surely are from its border."""
    width = extent / 2.0**level
    left = low + cell * width
    return np.minimum(p - left, left + width - p).min(axis=1) - 1e-9 * width


def _leaf_cores(k: int, samples: Sequence[int] = (), low: Sequence[float] = (), extent: float = np.inf):
    """Adds ``ds``: the distances of the k nearest other rows in the leaf, as far as it has them.

    With ``samples``, a point whose k nearest all lie nearer than the leaf's border has only the distances for these, and
    ``open`` is false.
    """
    wanted = np.array(samples, np.int64) - 1

    def run(table: pa.Table) -> pa.Table:
        b, columns = Buckets(_places(table)), []
        if len(wanted):
            cell = np.array(table.column("cell")[0].as_py())
            room = _room(b.p[: b.n], table.column("level")[0].as_py(), cell, np.array(low), extent)
        closed = np.zeros(b.n, bool)
        w = b.padded(_flat(table, "w"), 0).reshape(b.count, b.size)
        held = np.minimum(b.n - b.size * np.arange(b.count), b.size)
        for i in range(b.count):
            start = i * b.size
            q = b.p[start : min(start + b.size, b.n)]
            box = q.min(axis=0), q.max(axis=0)
            # Within this lie more than k points.
            far = b.far(*box)
            order = np.argsort(far)
            enough = int(np.searchsorted(np.cumsum(held[order]), k + 1))
            taken = np.flatnonzero(b.near(*box) <= (far[order[enough]] if enough < b.count else np.inf))
            d = b.distances(q, taken)
            rows = np.arange(len(q))
            d[rows, np.searchsorted(taken, i) * b.size + rows] = np.inf
            own = np.minimum(w[i, : len(q)] - 1, k).tolist()
            near = _near_rows(d, w[taken].ravel(), k)
            if max(own):
                near = [np.concatenate((np.zeros(n), row))[:k] for n, row in zip(own, near)]
            if len(wanted):
                closed[start + rows] = [len(row) == k and row[-1] <= at for row, at in zip(near, room[start + rows].tolist())]
                near = [row[wanted] if done else row for row, done in zip(near, closed[start + rows].tolist())]
            columns.append(_lists(near))
        table = table.take(pa.array(b.order))
        out = table.select(["id", "p", "w", "level", "cell"]).append_column("ds", pa.chunked_array(columns, pa.list_(pa.float64())))
        return out.append_column("open", pa.array(~closed)) if len(wanted) else out

    return run


def _visitor_cores(k: int):
    """Rows (id, ds): the distances of a caller's nearest rows in a leaf that lie within its radius."""

    def run(leaf: pa.Table, callers: pa.Table) -> pa.Table:
        met = leaf.num_rows > 0 and callers.num_rows > 0
        columns = []
        callers = callers.take(pa.array(bucket_order(_places(callers)))) if met else callers.slice(0, 0)
        if met:
            b, q, r = Buckets(_places(leaf)), _places(callers), _flat(callers, "r")
            w = b.padded(_flat(leaf, "w"), 0).reshape(b.count, b.size)
            for start in range(0, len(q), BUCKET):
                some, within = q[start : start + BUCKET], r[start : start + BUCKET]
                taken = np.flatnonzero(b.near(some.min(axis=0), some.max(axis=0)) <= within.max())
                d = b.distances(some, taken)
                d[d > within[:, None]] = np.inf
                columns.append(_lists(_near_rows(d, w[taken].ravel(), k)))
        return pa.table({"id": callers.column("id"), "ds": pa.chunked_array(columns, pa.list_(pa.float64()))})

    return run


def core_table(leaves: Leaves, k: int, samples: Sequence[int] | None = None) -> DataFrame:
    """Points with ``cores``: the core distances for 1, 2, ... k samples, or for ``samples`` of at most k only.

    Leaves give distances only, as flat arrays: a task holds those of one leaf.
    """
    wanted = list(samples) if samples is not None else list(range(1, k + 1))
    schema = "id bigint, p array<double>, w bigint, level int, cell array<int>, cores array<double>"
    if leaves.single:
        return _with_whole_table(leaves, schema, lambda q, own, p, w: _all_cores(q, own, p, w, k)[:, np.array(wanted) - 1])
    homes = dealt(leaves.points.select("id", "p", "w", "level", "cell"), "level", "cell")
    leaf_cores = _leaf_cores(k) if samples is None else _leaf_cores(k, wanted, leaves.low, leaves.extent)
    found = homes.groupBy("level", "cell").applyInArrow(leaf_cores, schema.replace("cores", "ds") + ", open boolean" * (samples is not None))
    inner = settle(found, "inner")
    sticking = inner if samples is None else inner.where("open")
    calls = _calls(sticking, F.when(F.size("ds") >= k, F.col("ds")[k - 1]), leaves, k)
    outer = (
        homes.groupBy("level", "cell")
        .cogroup(dealt(calls, "level", "cell").groupBy("level", "cell"))
        .applyInArrow(_visitor_cores(k), "id bigint, ds array<double>")
        .groupBy("id")
        .agg(F.flatten(F.collect_list("ds")).alias("outer"))
    )
    merged = F.when(F.col("outer").isNull(), F.col("ds")).otherwise(F.slice(F.sort_array(F.concat("ds", "outer")), 1, k))
    whole = inner.join(outer, "id", "left")
    if samples is None:
        cores = F.slice(F.concat(merged, F.array_repeat(F.lit(float("inf")), k)), 1, k)
    else:
        last = F.array(*[F.coalesce(F.get("near", F.lit(ms - 1)), F.lit(float("inf"))) for ms in wanted])
        whole = whole.withColumn("near", merged)
        cores = F.when(F.col("open"), last).otherwise(F.col("ds"))
    return whole.select("id", "p", "w", "level", "cell", cores.alias("cores"))


def core_distance(points: DataFrame, min_samples: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows (id, core)."""
    leaves = into_leaves(points, max(leaf_rows, 4 * min_samples))
    return core_distances(leaves, [min_samples]).select("id", F.col("cores")[0].alias("core"))


def mutual_reach(points: DataFrame, min_samples: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Edges (a, b, weight) between neighbours: distance, but not below either core distance."""
    leaves = into_leaves(points, max(leaf_rows, 4 * min_samples))
    lists = settle(neighbour_lists(leaves, min_samples), "neighbours")
    cores = settle(lists.select("id", core_from_list(min_samples).alias("core")), "cores")
    edges = lists.select("id", F.explode("nbrs").alias("n")).select(
        F.least("id", "n.id").alias("a"), F.greatest("id", "n.id").alias("b"), F.col("n.d").alias("d")
    ).distinct()
    return (
        edges.join(cores.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a")
        .join(cores.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
        .select("a", "b", F.greatest("core_a", "core_b", "d").alias("weight"))
    )
