"""Embedding near-duplicates by spherical-cap filters in random product codes.

A filter is a direction; a vector passes it when their inner product exceeds a threshold, that
is, when the vector lies in a cap around it. The directions are structured: the rotated space
is cut into blocks, each block has a small book of random unit vectors, and every choice of
one word per block is a direction. So the passing directions of a vector are found by list
decoding, without trying all of them: block products are sorted, and partial sums that cannot
reach the threshold are cut.

Vectors with a common label that pass a common filter meet and are verified in double
precision. Each pair counts only at its first common filter, so counts add up and no pair
is emitted: a bucket gives each vector's number of links, and a spanning forest of its
links. Large buckets are cut into tiles of bounded size; all pairs of tiles meet.

A larger table gets smaller caps and so many more directions that a vector still passes as
many on average, so a bucket keeps its size. Directions of a product code are uneven, so a vector
that passes few takes its ``fewest`` nearest ones too. That number comes from the table's own code
and cap: it is the least with which, of PAIRS random pairs at the least similarity, the share
RECALL has a direction in common. Where MOST are not enough, caps grow. So the recall predicted
for the hardest pairs is RECALL at every size; closer pairs are found with more certainty. A cap
is never narrower than the angle of a pair at the least similarity, which matters for short vectors. Copies of a vector under one label are one point with a
weight, so they are all linked and never compared.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without
label link with nothing: 0 links, own component. A null vec_id keeps its row. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.graph import components
from textloom.sources.scratch import settle

LEAST = 0.93
CHANCE = 0.006  # of a random vector to pass a filter, in small tables
PASSED = 24  # filters that a vector passes on average
BUCKET = 64  # points of the largest label in a bucket, in large tables
TILE = 1024
RECALL = 0.998  # of pairs at the least similarity, as predicted from random ones
PAIRS = 1000
MOST = 192  # nearest filters that a vector takes when it passes fewer
SEED = 20240229


def cap(dimension: int, chance: float, least: float) -> tuple[float, int]:
    """(threshold, bits): the inner product that a filter asks for, and the bits of a filter's number."""
    if dimension == 1:
        return 0.5, 6
    angles = np.linspace(0, np.pi, 100_001)
    mass = np.cumsum(np.sin(angles) ** (dimension - 2))
    mass /= mass[-1]
    angle = max(angles[np.searchsorted(mass, chance)], np.arccos(least))
    return float(np.cos(angle)), int(np.ceil(np.log2(PASSED / np.interp(angle, angles, mass))))


class Code:
    """Random product code for vectors of one dimension."""

    def __init__(self, dimension: int, bits: int):
        random = np.random.default_rng([SEED, dimension])
        self.rotation = np.linalg.qr(random.standard_normal((dimension, dimension)))[0]
        self.blocks = np.array_split(np.arange(dimension), max(1, min(dimension, -(-bits // 7))))
        words = 1 << -(-bits // len(self.blocks))
        self.books = []
        for b in self.blocks:
            book = random.standard_normal((words, len(b)))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * np.sqrt(len(b) / dimension))
        self.words = words

    def passing(self, vectors: np.ndarray, threshold: float, fewest: int = 0) -> list[np.ndarray]:
        """Per vector all directions whose product exceeds the threshold, and the ``fewest`` nearest, ascending."""
        return [np.sort(codes[(sums > threshold) | (np.arange(len(codes)) < fewest)]) for codes, sums in self.nearest(vectors, threshold, fewest)]

    def nearest(self, vectors: np.ndarray, threshold: float, fewest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per vector (directions, products) from the nearest on: those above the threshold, ``fewest`` at least if there are as many."""
        turned = vectors @ self.rotation
        products = [turned[:, b] @ book.T for b, book in zip(self.blocks, self.books)]
        rest = np.cumsum([p.max(1) for p in products[::-1]], axis=0)[::-1]
        fewest = min(fewest, self.words ** len(self.books))
        for i in range(len(vectors)):
            bound = threshold
            while True:
                codes, sums = np.zeros(1, np.int64), np.zeros(1)
                for k, p in enumerate(products):
                    total = sums[:, None] + p[i][None, :]
                    later = rest[k + 1][i] if k + 1 < len(products) else 0.0
                    a, w = np.nonzero(total + later > bound)
                    codes, sums = codes[a] * self.words + w, total[a, w]
                if len(codes) >= fewest:
                    break
                bound = min(bound, rest[0][i]) - 0.05
            order = np.lexsort((codes, -sums))
            yield codes[order], sums[order]


def pairs_at(least: float, dimension: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random pairs of unit vectors with that inner product."""
    random = np.random.default_rng([SEED, dimension, seed])
    x, y = random.standard_normal((2, n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dimension == 1:
        return x, x
    y -= (x * y).sum(1, keepdims=True) * x
    return x, least * x + np.sqrt(1 - least * least) * y / np.linalg.norm(y, axis=1, keepdims=True)


def filters(dimension: int, chance: float, least: float) -> tuple[float, int, int]:
    """(threshold, bits, fewest) with which the share RECALL of random pairs at the least similarity meets."""
    x, y = pairs_at(least, dimension, PAIRS, 0)
    while True:
        threshold, bits = cap(dimension, chance, least)
        code, needed = Code(dimension, bits), []
        for (a, s), (b, t) in zip(code.nearest(x, threshold, MOST), code.nearest(y, threshold, MOST)):
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            rank = np.maximum(np.where(s[i] > threshold, 0, i + 1), np.where(t[j] > threshold, 0, j + 1))
            needed.append(rank.min(initial=MOST + 1))
        fewest = int(np.sort(needed)[int(np.ceil(RECALL * PAIRS)) - 1])
        if fewest <= MOST:
            return threshold, bits, fewest
        if chance >= 0.5:
            return -2.0, bits, 0  # every vector passes every filter
        chance = min(0.5, chance * 4)


def _points(vectors: DataFrame) -> DataFrame:
    """(vec_id, point, label, embedding): point is a key of label and vector; null where a row cannot link."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(values, lambda x: x != 0)
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite & some, F.lit(False))
    clean = F.transform(values, lambda x: x + 0.0)  # minus zero is zero
    rows = vectors.select("vec_id", "label", F.when(good, clean).alias("embedding"))
    return rows.withColumn("point", F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")))


def _filtered(points: DataFrame, chance: float, least: float) -> DataFrame:
    """(label, dim, code, point, weight, vector, codes) for each passing direction."""
    sizes = [r[0] for r in points.select(F.size("embedding")).distinct().collect()]
    chosen = {n: filters(n, chance, least) for n in sizes}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, Code] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                raw = part.column("embedding").to_pylist()
                by_size: dict[int, list[int]] = {}
                for i, v in enumerate(raw):
                    by_size.setdefault(len(v), []).append(i)
                for size, at in by_size.items():
                    x = np.array([raw[i] for i in at], np.float64)
                    x /= np.abs(x).max(1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    threshold, bits, fewest = chosen[size]
                    if size not in books:
                        books[size] = Code(size, bits)
                    lists = books[size].passing(x, threshold, fewest)
                    counts = np.array([len(c) for c in lists])
                    rows = np.repeat(np.arange(len(at)), counts)
                    if not len(rows):
                        continue
                    take = pa.array(np.array(at)[rows])
                    vectors, codes = pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in lists], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("label").take(take),
                            pa.array(np.full(len(rows), size, np.int32)),
                            pa.array(np.concatenate(lists)),
                            part.column("point").take(take),
                            part.column("weight").take(take),
                            vectors.take(pa.array(rows)),
                            codes.take(pa.array(rows)),
                        ],
                        ["label", "dim", "code", "point", "weight", "vector", "codes"],
                    )

    kind = points.schema["label"].dataType.simpleString()
    return points.select("label", "point", "weight", "embedding").mapInArrow(
        spread, f"label {kind}, dim int, code long, point long, weight long, vector binary, codes binary"
    )


class _Earlier:
    """Codes below a bucket's code, per vector, to tell whether a pair met in an earlier bucket."""

    def __init__(self, code: int, codes: list[bytes]):
        own = [np.frombuffer(c, np.int64) for c in codes]
        own = [c[: np.searchsorted(c, code)] for c in own]
        self.counts = np.array([len(c) for c in own])
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.codes = np.concatenate(own)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``rows``, code) of all their earlier codes."""
        counts = self.counts[rows]
        at = np.repeat(self.starts[rows] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        return np.repeat(np.arange(len(rows)), counts), self.codes[at]

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Matrix of whether a pair has an earlier code in common."""
        i, a = self.of(left)
        j, b = self.of(right)
        known = np.unique(a)
        if not len(known) or not len(b):
            return np.zeros((len(left), len(right)), bool)
        at = np.minimum(np.searchsorted(known, b), len(known) - 1)
        hit = known[at] == b
        x, y = np.zeros((len(left), len(known)), np.float32), np.zeros((len(right), len(known)), np.float32)
        x[i, np.searchsorted(known, a)] = 1
        y[j[hit], at[hit]] = 1
        return x @ y.T > 0


def _meet(code: int, least: float, side: np.ndarray, point: np.ndarray, weight: np.ndarray, vector: list[bytes], codes: list[bytes]) -> list[tuple]:
    """(point, links, root) of the links between two tiles of a bucket, or inside one."""
    rows = np.frombuffer(b"".join(vector), np.float64).reshape(len(vector), -1)
    same = side[0] == 2
    ax, ay = (np.arange(len(side)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, roots = np.zeros(len(side), np.int64), {}

    def root(p: int) -> int:
        while roots.get(p, p) != p:
            p = roots[p]
        return p

    earlier = _Earlier(code, codes)
    for low in range(0, len(ax), 128):
        own = ax[low : low + 128]
        close = rows[own] @ rows[ay].T >= least
        if same:
            close &= np.arange(low, low + len(close))[:, None] < np.arange(len(ay))[None, :]
        if not close.any():
            continue
        close &= ~earlier.shared(own, ay)
        links[own] += close @ weight[ay]
        links[ay] += weight[own] @ close
        i, j = np.nonzero(close)
        for p, q in zip(point[own[i]].tolist(), point[ay[j]].tolist()):
            r, s = root(p), root(q)
            if r != s:
                roots[max(r, s)] = min(r, s)
    at = np.flatnonzero(links)
    return [(p, n, root(p)) for p, n in zip(point[at].tolist(), links[at].tolist())]


def _tile_links(least: float):
    """Tiles stream through in order of their key; one pair of tiles at most is held."""
    keys = ("label_key", "dim", "code", "low", "high")
    names = ("side", "point", "weight", "vector", "codes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple] = []

        def close() -> None:
            rows = pa.Table.from_batches(held)
            if rows.num_rows > 1:
                numbers = [rows.column(c).to_numpy() for c in names[:3]]
                out.extend(_meet(rows.column("code")[0].as_py(), least, *numbers, *(rows.column(c).to_pylist() for c in names[3:])))
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["point", "links", "root"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:]):
                now = tuple(key[:, a].tolist())
                if held and now != last:
                    close()
                held.append(batch.slice(a, b - a))
                last = now
            if out:
                yield flush()
        if held:
            close()
        if out:
            yield flush()

    return meet


def link_vectors(vectors: DataFrame, least: float = LEAST, chance: float = CHANCE, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = settle(_points(vectors), "points")
    grouped = rows.where("point is not null").groupBy("point", "label")
    points = settle(grouped.agg(F.first("embedding").alias("embedding"), F.count("*").alias("weight")), "distinct")
    largest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    passed = settle(_filtered(points, min(chance, bucket / largest), least), "passed")

    key = ["label", "dim", "code"]
    sizes = passed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    met = passed.join(sizes.withColumn("tiles", tiles), key)
    met = met.withColumn("tile", F.pmod(F.xxhash64("point"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    met = met.select("*", other).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    side = F.when(F.col("low") == F.col("high"), 2).when(F.col("tile") == F.col("low"), 0).otherwise(1)
    met = met.select(*key, "low", "high", side.alias("side"), "point", "weight", "vector", "codes")
    met = met.withColumn("label_key", F.xxhash64("label")).drop("label")
    tile = ["label_key", "dim", "code", "low", "high"]
    met = met.repartition(*tile).sortWithinPartitions(*tile)
    linked = met.mapInArrow(_tile_links(least), "point long, links long, root long")
    linked = settle(linked, "linked")

    counts = linked.groupBy("point").agg(F.sum("links").alias("links"))
    whole = components(linked.select(F.col("point").alias("a"), F.col("root").alias("b"))).toDF("point", "component")
    known = points.select("point", "weight").join(counts, "point", "left").join(whole, "point", "left")
    known = known.select(
        "point", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "point").alias("component")
    )
    out = settle(rows.drop("embedding", "label").join(known, "point", "left"), "rows")
    lowest = out.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("lowest"))
    out = out.join(lowest, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("point").isNull(), F.col("vec_id")).otherwise(F.col("lowest")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
