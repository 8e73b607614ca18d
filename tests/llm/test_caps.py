import numpy as np
import pytest

from textloom.llm.caps import Code, filters, link_vectors, pairs_at


def table(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(60):
        base = rng.standard_normal(32)
        for c in range(4):
            rows.append((len(rows), (base + rng.standard_normal(32) * 0.03 * (1 + c)).astype(float).tolist(), k % 3))
    rows += [(1000 + k, rows[0][1], 0) for k in range(30)] + [(1100, rows[0][1], 1)]
    rows += [(1200, None, 0), (1201, [], 0), (1202, [0.0] * 32, 0), (1203, [float("nan")] * 32, 0), (1204, [None, 1.0], 0), (1205, [float("inf")] * 32, 0)]
    rows += [(1206, rows[0][1], None), (None, rows[8][1], rows[8][2]), (1300, [1.0, 0.0], 0), (1301, [2.0, 0.1], 0), (1302, [1e-200] * 32, 2), (1303, [1e200] * 32, 2)]
    return rows


def plain_links(rows, least=0.93):
    n, good = len(rows), []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / max(abs(a) for a in v) if ok else None
        good.append(x / np.linalg.norm(x) if ok else None)
    links = [[] for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a != b and good[a] is not None and good[b] is not None and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                if good[a] @ good[b] >= least:
                    links[a].append(b)
    return links


def test_links_against_all_pairs(spark):
    rows = table(spark)
    links = plain_links(rows)
    made = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, point string").repartition(3)
    got = {r["vec_id"]: r for r in link_vectors(made).collect()}
    assert len(got) == len(rows)
    assert all(got[rows[k][0]]["n_links"] <= len(links[k]) for k in range(len(rows)))
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(map(len, links))
    for k in (1200, 1201, 1202, 1203, 1204, 1205, 1206):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert got[1000]["component_id"] == 0 and not got[1000]["kept"] and got[1100]["component_id"] == 1100
    assert got[1301]["component_id"] == 1300 and got[1303]["component_id"] == 1302
    assert got[None]["n_links"] >= 1 and got[None]["component_id"] == got[8]["component_id"]
    assert link_vectors(made.where("false")).count() == 0


def test_list_decoding_finds_every_passing_direction():
    code, rng = Code(24, 9), np.random.default_rng(2)
    x = rng.standard_normal((20, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    full = np.array([np.concatenate([b[w] for b, w in zip(code.books, np.unravel_index(c, [code.words] * len(code.books)))]) for c in range(code.words ** len(code.books))])
    products = (x @ code.rotation)[:, np.concatenate(code.blocks)] @ full.T
    for i, codes in enumerate(code.passing(x, 0.3)):
        assert codes.tolist() == np.flatnonzero(products[i] > 0.3).tolist()


@pytest.mark.parametrize("dimension", [1, 2, 16, 64, 256])
@pytest.mark.parametrize("chance", [0.006, 6.4e-5, 6.4e-6])
def test_recall_of_borderline_pairs_at_any_size(dimension, chance):
    threshold, bits, fewest = filters(dimension, chance, 0.93)
    code = Code(dimension, bits)
    both = [code.passing(x, threshold, fewest) for x in pairs_at(0.93, dimension, 500, 1)]
    assert min(len(codes) for side in both for codes in side) >= fewest
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(*both)]) >= 0.99


def test_borderline_links_at_small_chance(spark):
    x, y = pairs_at(0.9301, 32, 300, 2)
    rows = [(2 * i + j, v.tolist(), 0) for i, pair in enumerate(zip(x, y)) for j, v in enumerate(pair)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert link_vectors(made, chance=6.4e-6).where("n_links > 0").count() >= 0.99 * len(rows)
