"""Embedding whitening over the distinct vectors of a table, by a weighted centred product of matrices.

1. Each entry c becomes the whole number floor(64 * c) + 1000000 in a narrow stage. Spark groups
   identical vectors with partial counts, so copies shrink before the shuffle.
2. The fit list is every distinct vector once; its fit weight is one or its number of copies.
   Tasks sum weights and entries as whole numbers, then centre their vectors with the exact
   means and multiply; Spark adds the products entry by entry.
3. One task takes the eigenvectors of a matrix, whose size is the vectors' width squared.
4. Each distinct vector is whitened once, and the rows join it by their vector. Spark splits
   that join where one vector has very many rows.

Vectors of different width are whitened apart, each width by its own fit. Rows go whose vector is
null, or holds null, NaN, an infinity or an entry of 2^55 or more (no 64-bit whole number). An empty
vector has no components and so no rows. Repeated rows and rows without id stay, each with all
components; columns other than the id and the vector are ignored. A component whose variance is zero
beside the largest one (one distinct vector, constant or dependent dimensions) has a null ``whitened``
and counts neither in ``identity_error``, which is 0 where no component counts, nor otherwise;
``explained`` is null where the whole variance is zero. ``deviation`` is null where the exact sum has no place in 64 bits.
Eigenvectors of equal eigenvalues may be any basis of their space, the same one for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.scratch import settle

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = 2.0**55
BLOCK = 1 << 22  # entries that are worked on at once
NOTHING = 1e-12  # variance beside the largest one that counts as none

SENT = 1 << 20  # entries of all widths' matrices up to which fits are sent to tasks whole

MODEL = "width int, n long, total array<decimal(38,0)>, values array<double>, axes array<double>, trace double"


def whole_numbers(c: Column) -> Column:
    return F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT)


def usable(c: Column) -> Column:
    """Whether all entries are numbers that have a place in 64 bits."""
    return c.isNotNull() & F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < LARGEST)), F.lit(False))


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(width, rows, their lists as a matrix of bounded size), one width at a time."""
    width = batch.column("width").to_numpy()
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        step = max(1, BLOCK // w)
        for k in range(0, len(at), step):
            part = batch.take(pa.array(at[k : k + step]))
            yield w, part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def beside(rows: DataFrame, fit: DataFrame, entries: int) -> tuple[DataFrame, Callable[[int, pa.RecordBatch], dict]]:
    """Rows with their width's fit in reach: sent to all tasks where the written fits are known to be small, else joined."""
    if (fit.agg(F.sum(F.col("width").cast("long") * F.col("width"))).first()[0] or 0) <= entries:
        held = rows.sparkSession.sparkContext.broadcast({r["width"]: r.asDict() for r in fit.collect()})
        return rows, lambda width, part: held.value[width]
    names = [c for c in fit.columns if c != "width"]
    return rows.join(fit, "width"), lambda width, part: {c: part.column(c)[0].as_py() for c in names}


def fits(n: int, x: np.ndarray, total: np.ndarray) -> bool:
    """Whether n * x - total stays within 64 bits."""
    return n * max(abs(int(x.max())), abs(int(x.min()))) + int(np.abs(total).max()) < 1 << 62


def centred(n: int, x: np.ndarray, total: list) -> np.ndarray:
    """n * x - total, exactly: 64-bit numbers, or Python's where these are too short."""
    whole = np.array([int(t) for t in total], object)
    if fits(n, x, whole):
        return x * np.int64(n) - whole.astype(np.int64)
    return x.astype(object) * n - whole


def totals(vectors: DataFrame) -> DataFrame:
    """(width, n, total): sums over the vectors of the weights, and of the weighted entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, part, x in matrices(batch, "x"):
                weight = part.column("weight").to_numpy()
                largest = int(weight.sum()) * max(abs(int(x.max())), abs(int(x.min())))
                add = weight @ x if largest < 1 << 62 else weight.astype(object) @ x.astype(object)
                n[w] = n.get(w, 0) + int(weight.sum())
                total[w] = total.get(w, 0) + add.astype(object)
        rows = [(w, i, n[w], int(t)) for w in n for i, t in enumerate(total[w])]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["width", "i", "n", "total"])

    parts = vectors.mapInArrow(run, "width int, i int, n long, total decimal(38,0)")
    sums = parts.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "total")))
    return sums.groupBy("width").agg(F.max("n").alias("n"), F.transform(ordered, lambda r: r["total"]).alias("total"))


def products(rows: DataFrame, column: str, centre: Callable[[int, pa.RecordBatch, np.ndarray], np.ndarray]) -> DataFrame:
    """(width, i, j, v), i <= j: weighted product of the centred lists with themselves, one matrix a task and width, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, part, x in matrices(batch, column):
                y = centre(w, part, x)
                total[w] = total.get(w, 0) + (y * part.column("weight").to_numpy()[:, None]).T @ y
        for w, product in total.items():
            i, j = np.triu_indices(len(product))
            columns = [np.full(len(i), w, np.int32), i.astype(np.int32), j.astype(np.int32), product[i, j]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["width", "i", "j", "v"])

    return rows.mapInArrow(run, "width int, i int, j int, v double").groupBy("width", "i", "j").agg(F.sum("v").alias("v"))


def square(pdf: pd.DataFrame) -> np.ndarray:
    size = int(pdf["j"].max()) + 1
    out = np.zeros((size, size))
    out[pdf["i"], pdf["j"]] = pdf["v"]
    out[pdf["j"], pdf["i"]] = pdf["v"]
    return out


def fit_whitening(vectors: DataFrame, most: int = COMPONENTS, entries: int = SENT) -> DataFrame:
    """The fit of each width, from a written table of (width, x, weight)."""
    fit = settle(totals(vectors), "totals")
    rows, of = beside(vectors, fit, entries)

    def centre(width: int, part: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        own = of(width, part)
        return (centred(own["n"], x, own["total"]) / own["n"]).astype(np.float64)

    def axes(own: pd.DataFrame, product: pd.DataFrame) -> pd.DataFrame:
        covariance = square(product) / int(own["n"].iloc[0])
        values, vectors = np.linalg.eigh(covariance)
        keep = np.argsort(values, kind="stable")[::-1][:most]
        own["values"] = [np.maximum(values[keep], 0.0)]
        own["axes"] = [vectors[:, keep].T.ravel()]
        own["trace"] = np.trace(covariance)
        return own

    found = fit.groupBy("width").cogroup(products(rows, "x", centre).groupBy("width"))
    return settle(found.applyInPandas(axes, MODEL), "whitening")


def whiten(vectors: DataFrame, model: DataFrame, entries: int = SENT) -> DataFrame:
    """Adds ``deviation`` and ``whitened``, one number a component, to each distinct vector."""
    rows, of = beside(vectors, model, entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part, x in matrices(batch, "x"):
                own = of(width, part)
                n, values = own["n"], np.array(own["values"])
                y = centred(n, x, own["total"])
                largest = int(np.abs(y).max())
                if width * largest * largest < 1 << 62:
                    deviation = np.sum(y * y, axis=1).tolist()
                else:
                    deviation = [v if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(axis=1)]
                along = (y / n).astype(np.float64) @ np.array(own["axes"]).reshape(len(values), -1).T
                counts = values > values[0] * NOTHING
                white = along / np.sqrt(np.where(counts, values, 1.0))
                flat = pa.array(white.ravel(), mask=np.tile(~counts, len(white)))
                lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * len(values), flat)
                columns = [part.column("width"), part.column("x"), part.column("weight"), pa.array(deviation, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["width", "x", "weight", "deviation", "whitened"])

    return rows.mapInArrow(run, "width int, x array<bigint>, weight bigint, deviation bigint, whitened array<double>")


def identity_errors(white: DataFrame, model: DataFrame, entries: int = SENT) -> DataFrame:
    """(width, identity_error): largest entry of the whitened vectors' covariance minus the identity, measured on them."""
    entry = white.select("width", "weight", F.posexplode("whitened").alias("k", "v"))
    means = entry.groupBy("width", "k").agg((F.sum(F.coalesce("v", F.lit(0.0)) * F.col("weight")) / F.sum("weight")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda r: r["m"])
    rows, of = beside(white, settle(means.groupBy("width").agg(ordered.alias("m")), "means"), entries)

    def centre(width: int, part: pa.RecordBatch, y: np.ndarray) -> np.ndarray:
        return np.nan_to_num(y.astype(np.float64)) - np.array(of(width, part)["m"])

    def measure(own: pd.DataFrame, product: pd.DataFrame) -> pd.DataFrame:
        values = np.asarray(own["values"].iloc[0])
        counts = np.diag((values > values[0] * NOTHING).astype(float))
        error = np.abs(square(product) / int(own["n"].iloc[0]) - counts).max()
        return pd.DataFrame({"width": own["width"], "identity_error": error})

    pairs = model.groupBy("width").cogroup(products(rows, "whitened", centre).groupBy("width"))
    return pairs.applyInPandas(measure, "width int, identity_error double")


def whitened_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", weights: str = "one", most: int = COMPONENTS, entries: int = SENT
) -> DataFrame:
    """One row for each usable vector and component: (key, component, n, deviation, whitened, explained, identity_error).

    ``weights``: 'one' fits every distinct vector once, 'copies' as often as it occurs.
    """
    if weights not in ("one", "copies"):
        raise ValueError("weights are 'one' or 'copies'")
    rows = table.select(key, F.col(vector).alias("_v")).where(usable(F.col("_v"))).where(F.size("_v") > 0)
    rows = rows.select(key, whole_numbers(F.col("_v")).alias("x"))
    weight = F.count("*") if weights == "copies" else F.lit(1).cast("long")
    groups = rows.groupBy("x").agg(weight.alias("weight"))
    vectors = settle(groups.select(F.size("x").alias("width"), "x", "weight"), "vectors")
    model = fit_whitening(vectors, most, entries)
    white = settle(whiten(vectors, model, entries), "whitened")
    share = F.transform("values", lambda v: F.when(F.col("trace") > 0, v / F.col("trace")))
    facts = model.select("width", "n", share.alias("share")).join(settle(identity_errors(white, model, entries), "errors"), "width")
    each = rows.join(white.drop("weight"), "x").drop("x").join(facts, "width")
    parts = each.select(key, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "share")).alias("k", "c"))
    return parts.select(
        key, (F.col("k") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.share").alias("explained"), "identity_error",
    )
