"""Whitening against a plain restatement with Python's whole numbers and a dense decomposition."""

import math

import numpy as np
import pytest

from textloom.llm.whitening import whitened_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, width string, whitened double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "n", "w", 1.0) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, most=16, copies=False):
    """{(id, component): (n, deviation, |whitened|, explained)} of vectors of one width."""
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows]
    fit = [x for _, x in xs] if copies else sorted({x for _, x in xs})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * a - s) / n for a, s in zip(x, total)] for x in fit])
    v = y.T @ y / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    out = []
    for i, x in xs:
        d = [n * a - s for a, s in zip(x, total)]
        w = np.array([t / n for t in d]) @ axes
        for k in range(len(e)):
            none = e[k] <= e[0] * 1e-12
            out.append((i, k + 1, n, sum(t * t for t in d), None if none else abs(w[k]) / math.sqrt(e[k]), e[k] / np.trace(v) if np.trace(v) else None))
    return sorted(out, key=str)


def got(df):
    return sorted(
        ((r.vec_id, r.component, r.n, r.deviation, None if r.whitened is None else abs(r.whitened), r.explained) for r in df.collect()), key=str
    )


def same(a, b):
    assert [x[:4] for x in a] == [x[:4] for x in b]
    for x, y in zip(a, b):
        for p, q in zip(x[4:], y[4:]):
            assert (p is None) == (q is None) and (p is None or p == pytest.approx(q, rel=1e-6, abs=1e-7))


def noise(seed, n, width):
    scale = np.linspace(1, 2, width)
    return [(i, [float(c) for c in v]) for i, v in enumerate(np.random.default_rng(seed).standard_normal((n, width)) * scale)]


@pytest.mark.parametrize("entries", [1 << 20, 0])
@pytest.mark.parametrize("weights", ["one", "copies"])
def test_same_as_plain(spark, weights, entries):
    rows = noise(1, 200, 20)
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(5, rows[3][1]), (None, rows[7][1]), (None, rows[7][1])]
    awkward = [(9001, None), (9002, [1.0, None] * 10), (9003, [math.nan] * 20), (9004, [math.inf] * 20), (9005, []), (9006, [1e30] * 20)]
    df = whitened_vectors(vectors(spark, rows + awkward), weights=weights, entries=entries)
    found = df.collect()
    same(got(df), plain(rows, copies=weights == "copies"))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_widths_apart_and_dependent_dimensions(spark):
    wide, thin = noise(2, 60, 18), [(100 + i, v) for i, v in noise(3, 40, 3)]
    flat = [(i, v[:2] + [0.25] + v[3:]) for i, v in wide]  # a constant dimension
    twin = [(i, v + [v[0]]) for i, v in noise(4, 30, 4)]
    same(got(whitened_vectors(vectors(spark, flat + thin))), sorted(plain(flat) + plain(thin), key=str))
    found = whitened_vectors(vectors(spark, twin)).collect()
    assert sum(r.whitened is None for r in found) == 30 and max(r.identity_error for r in found) < 1e-9


def test_one_vector_empty_table_and_large_numbers(spark):
    one = whitened_vectors(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, 0.0)] * 4
    assert whitened_vectors(vectors(spark, [])).collect() == []
    assert whitened_vectors(vectors(spark, [(1, None), (2, [])])).collect() == []
    big = [(i, [float(np.float32(c)) for c in v]) for i, v in noise(5, 12, 3)]
    big = [(i, [c * 2.0**40 for c in v]) for i, v in big]
    want = [(a, b, n, d if d < 1 << 63 else None, w, e) for a, b, n, d, w, e in plain(big)]
    same(got(whitened_vectors(vectors(spark, big))), sorted(want, key=str))
    with pytest.raises(ValueError):
        whitened_vectors(vectors(spark, []), weights="all")
