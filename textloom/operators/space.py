"""Points cut into bounded cells of space.

A point table has the columns ``id``, ``p`` (array of doubles) and ``w`` (how many
rows share the coordinates).  Cells halve in every dimension until each holds at
most ``leaf_rows`` points, so a task that works on one cell has bounded work
however uneven the points lie.  Copies of one point are one point with a weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle

LEAF_ROWS = 16_384
SPARE_LEVELS = 4  # levels below an even spread that are looked at in one go
MAX_LEVEL = 28
SENT_ROWS = 1 << 18  # rows about the leaves that go to all tasks


def distinct_points(df: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """One row for each place: smallest key, coordinates, number of rows."""
    return (
        df.groupBy(*dims)
        .agg(F.min(key).alias("id"), F.count("*").alias("w"))
        .select("id", F.array(*[F.col(d).cast("double") for d in dims]).alias("p"), "w")
    )


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys whose groups cost far more than their bytes tell, so that Spark does not put them into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@dataclass
class Leaves:
    """Points with their cell (``level``, ``cell``), and the geometry of the cells."""

    points: DataFrame
    low: list[float]
    extent: float
    single: bool
    _sizes: DataFrame | None = None
    _levels: list[int] | None = None
    _lineage_rows: int = 0

    @property
    def sizes(self) -> DataFrame:
        """Written table (level, cell, n) of the leaves and how many points they hold."""
        if self._sizes is None:
            self._sizes = settle(self.points.groupBy("level", "cell").agg(F.count("*").alias("n")), "sizes")
        return self._sizes

    @property
    def levels(self) -> list[int]:
        """Levels that have leaves; at most MAX_LEVEL + 1."""
        self._count()
        return self._levels

    @property
    def lineage_rows(self) -> int:
        """How many cells the leaves have above them, themselves included twice."""
        self._count()
        return self._lineage_rows

    def _count(self) -> None:
        if self._levels is None:
            rows = self.sizes.groupBy("level").agg(F.count("*").alias("n")).collect()  # one row for each level
            self._levels = sorted(r["level"] for r in rows)
            self._lineage_rows = sum((r["level"] + 2) * r["n"] for r in rows)

    @property
    def dim(self) -> int:
        return len(self.low)

    def width(self, level: Column) -> Column:
        return F.lit(self.extent) / F.pow(F.lit(2.0), level)

    def cell_of(self, p: Column, level: Column | int) -> Column:
        """Cell of a place at a level, also for places outside the table."""
        width = self.width(F.lit(level) if isinstance(level, int) else level)
        return F.array(
            *[F.floor((p[i] - F.lit(lo)) / width).cast("int") for i, lo in enumerate(self.low)]
        )

    def gap(self, p: Column, level: Column, cell: Column, farthest: bool = False) -> Column:
        """Distance from a place to the nearest (or farthest) spot of a cell."""
        total = F.lit(0.0)
        width = self.width(level)
        for i, lo in enumerate(self.low):
            left = F.lit(lo) + cell[i] * width
            right = left + width
            side = (
                F.greatest(F.abs(p[i] - left), F.abs(p[i] - right))
                if farthest
                else F.greatest(left - p[i], p[i] - right, F.lit(0.0))
            )
            total = total + side * side
        return F.sqrt(total)


def parent(cell: Column, steps: Column | int) -> Column:
    """The cell that holds this one a number of levels up."""
    scale = F.pow(F.lit(2.0), F.lit(steps) if isinstance(steps, int) else steps)
    return F.transform(cell, lambda c: F.floor(c / scale).cast("int"))


def into_leaves(points: DataFrame, leaf_rows: int = LEAF_ROWS) -> Leaves:
    """Cut the points into cells of at most ``leaf_rows`` points.

    Fine cells are counted once and their counts rolled up, so the points are
    shuffled by cell and never once for each level.
    """
    dim = points.select(F.size("p")).first()[0]
    stats = points.agg(
        F.count("*").alias("n"),
        *[F.min(F.col("p")[i]).alias(f"lo{i}") for i in range(dim)],
        *[F.max(F.col("p")[i]).alias(f"hi{i}") for i in range(dim)],
    ).first()
    low = [stats[f"lo{i}"] for i in range(dim)]
    extent = max(max(stats[f"hi{i}"] - low[i] for i in range(dim)), 1e-300) * (1 + 1e-9)
    single = stats["n"] <= leaf_rows
    root = F.array(*[F.lit(0)] * dim)
    if single:
        whole = points.withColumn("level", F.lit(0)).withColumn("cell", root)
        return Leaves(whole, low, extent, True)

    shape = Leaves(points, low, extent, False)
    depth = min(MAX_LEVEL, math.ceil(math.log2(stats["n"] / leaf_rows) / dim) + SPARE_LEVELS)
    while True:
        fine = points.withColumn("fine", shape.cell_of(F.col("p"), depth))
        counts = settle(fine.groupBy("fine").agg(F.count("*").alias("n")), "cells")
        lineage = counts.select(
            "fine", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
        ).withColumn("cell", parent(F.col("fine"), F.lit(depth) - F.col("level")))
        heavy = settle(
            lineage.groupBy("level", "cell")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") > leaf_rows)
            .select("level", "cell"),
            "heavy",
        )
        deepest = heavy.agg(F.max("level")).first()[0]
        if deepest is None or deepest < depth or depth == MAX_LEVEL:
            break
        depth = min(MAX_LEVEL, depth + SPARE_LEVELS)
    levels = (
        lineage.join(heavy, ["level", "cell"])
        .groupBy("fine")
        .agg(F.least(F.max("level") + 1, F.lit(depth)).alias("level"))
    )
    leaves = (
        fine.join(levels, "fine")
        .withColumn("cell", parent(F.col("fine"), F.lit(depth) - F.col("level")))
        .drop("fine")
    )
    return Leaves(settle(leaves, "leaves"), low, extent, False)


def visits(queries: DataFrame, leaves: Leaves, enough: int | None = None) -> DataFrame:
    """Pairs of a query and a leaf that its ball (``p``, ``r``) touches.

    A ball is looked up at the level whose cells are wider than the ball, where it
    touches at most two cells in each dimension; these lead to finer leaves below
    or to one coarser leaf above.  With ``enough`` the radius first shrinks to
    what surely holds that many points, so a lone query beside a dense area does
    not visit all of it.
    """
    sizes = leaves.sizes
    lineage = sizes.select(
        "level", "cell", "n", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("at")
    ).withColumn("key", parent(F.col("cell"), F.col("level") - F.col("at")))
    below = lineage.select("at", "key", "level", "cell", "n", F.lit("down").alias("way"))
    above = sizes.select(
        F.col("level").alias("at"), F.col("cell").alias("key"), "level", "cell", "n",
        F.lit("up").alias("way"),
    )
    fit = F.floor(F.log2(F.lit(leaves.extent) / (2 * F.col("r"))))
    level = F.when(F.col("r") > 0, F.greatest(F.lit(0), F.least(fit, F.lit(MAX_LEVEL)))).otherwise(MAX_LEVEL)
    # The cells at the ball's own level lead down, those above it that are leaves are coarser leaves: each once.
    looked = queries.withColumn("_own", level.cast("int")).withColumn(
        "at", F.explode(F.concat(F.array("_own"), F.filter(F.array(*[F.lit(x) for x in leaves.levels]), lambda x: x < F.col("_own"))))
    )
    steps = F.pow(F.lit(2.0), F.col("_own") - F.col("at"))
    width = leaves.width(F.col("_own"))
    for i in range(leaves.dim):
        first, last = (
            F.floor(F.floor((F.col("p")[i] + sign * F.col("r") - F.lit(leaves.low[i])) / width).cast("int") / steps).cast("int")
            for sign in (-1, 1)
        )
        looked = looked.withColumn(f"_c{i}", F.explode(F.sequence(first, last)))
    cells = [f"_c{i}" for i in range(leaves.dim)]
    keys = looked.withColumn("key", F.array(*cells)).withColumn("way", F.when(F.col("at") == F.col("_own"), "down").otherwise("up"))
    around = below.unionByName(above)
    if leaves.lineage_rows <= SENT_ROWS:
        # Few keys of high levels hold all queries; without a shuffle they do not meet in one task.
        around = F.broadcast(around)
    found = keys.drop("_own", *cells).join(around, ["at", "key", "way"]).drop("at", "key", "way")
    # A little slack keeps leaves at exactly the radius in spite of rounding.
    found = found.where(leaves.gap(F.col("p"), F.col("level"), F.col("cell")) <= F.col("r") * (1 + 1e-9))
    place = (F.col("p"), F.col("level"), F.col("cell"))
    if enough is not None:
        by_reach = Window.partitionBy("id").orderBy("_far", "level", "cell")
        sure = F.when(
            F.sum("n").over(by_reach.rowsBetween(Window.unboundedPreceding, 0)) >= enough, F.col("_far")
        )
        found = (
            found.withColumn("_far", leaves.gap(*place, farthest=True))
            .withColumn("_sure", sure)
            .withColumn("_best", F.min("_sure").over(Window.partitionBy("id")))
            .withColumn("r", F.least(F.col("r"), F.col("_best") * (1 + 1e-9)))
            .drop("_far", "_sure", "_best")
        )
        found = found.where(leaves.gap(*place) <= F.col("r") * (1 + 1e-9))
    return found.drop("n")
