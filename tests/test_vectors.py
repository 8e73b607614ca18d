"""Language, embeddings, reduction and near-duplicates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.models import letter_encoder
from textloom.operators import dedup, embed, language, reduce, spectral

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def detect(spark):
    return language.language_detector(language.language_profile(spark.read.parquet(f"{SF}/documents.parquet")))


def test_language_on_rows_it_did_not_learn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    detect = language.language_detector(language.language_profile(docs.where("doc_id % 2 = 0")))
    unseen = docs.where("doc_id % 2 = 1").withColumn("got", detect(F.col("text")))
    r = unseen.agg(F.avg((F.col("got") == F.col("lang")).cast("int"))).first()
    assert r[0] > 0.98


def test_scripts_and_failures(spark, detect):
    texts = ["これは日本語です", "한국어 문장입니다", "这是中文句子", "это русский текст", "12345 !?", "", None, "ωψχ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.g for r in df.withColumn("g", detect(F.col("t"))).orderBy("i").collect()]
    assert got == ["ja", "ko", "zh", "ru", "error", "error", "error", "error"]


def test_margin_gives_unknown(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sure = language.language_detector(language.language_profile(docs), margin=10**9)
    assert docs.limit(5).select(sure(F.col("text")).alias("l")).distinct().first().l == "unknown"


def test_trigrams_of_any_alphabet_count_as_themselves(spark):
    rng = np.random.default_rng(1)
    alphabets = {"aa": range(0x100, 0x180), "bb": range(0x13A0, 0x13F0), "cc": range(0x10A0, 0x1100)}
    texts = [(k, "".join(map(chr, rng.choice(list(a), 12)))) for k, a in alphabets.items() for _ in range(60)]
    texts += [(k, f"shared words {k} {t[:3]}") for k, t in texts[::10]]
    train = spark.createDataFrame(texts, "lang string, text string")
    profile = language.language_profile(train)
    counts, total = {}, {}
    for lang, t in texts:
        letters = "".join(c.lower() if c.isalpha() else " " for c in t)
        letters = f" {' '.join(letters.split())} "
        for i in range(len(letters) - 2):
            counts[lang, letters[i : i + 3]] = counts.get((lang, letters[i : i + 3]), 0) + 1
            total[lang] = total.get(lang, 0) + 1
    vocabulary = len({g for _, g in counts})
    assert profile.select("gram").distinct().count() == vocabulary
    want = {(k, (ord(g[0]) << 42) + (ord(g[1]) << 21) + ord(g[2])): round(np.log((n + 1) / (total[k] + vocabulary)) * 10_000) for (k, g), n in counts.items()}
    got = {(r.lang, r.gram): r.weight for r in profile.collect()}
    assert len(got) == 3 * vocabulary and all(abs(got[x] - w) <= 1 for x, w in want.items())
    df = train.select("text").union(spark.createDataFrame([(None,), ("",), ("zzz qqq",), ("shared words",)], "text string"))
    detect = language.language_detector(profile)
    whole = sorted(map(str, df.select("text", detect(F.col("text")).alias("lang")).collect()))
    for most in (0, 37, 1 << 20):
        assert sorted(map(str, language.detect_languages(df, profile, most=most).collect())) == whole
    unsure = language.language_detector(profile, margin=4000)
    want = sorted(map(str, df.select("text", unsure(F.col("text")).alias("lang")).collect()))
    assert sorted(map(str, language.detect_languages(df, profile, margin=4000, most=37).collect())) == want


def test_index_of_trigrams():
    known = np.random.default_rng(3).choice(10**6, 5000, replace=False) * 20_001
    index = language._Index(known)
    assert len(index.others) and (index.find(known) == np.arange(5000)).all()
    assert (index.find(known + 1) == -1).all() and (language._Index(known[:0]).find(known) == -1).all()


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "red green"), (2, "Green RED"), (3, "blue"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r.doc_id: np.array(r.embeddings) for r in embed.embed_hashed(df).collect()}
    assert got[1].shape == (256,) and np.allclose(got[1], got[2]) and np.isclose(np.linalg.norm(got[1]), 1)
    assert not got[4].any() and not got[5].any()
    wide = embed.embed_hashed(df, hash_digits=3).first().embeddings
    assert len(wide) == 4096


def test_plugged_in_encoder(spark):
    df = spark.createDataFrame([(1, "aab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.embeddings for r in embed.embed_with(df, letter_encoder).collect()}
    assert np.allclose(got[1][:3], [2 / 3, 1 / 3, 0]) and not any(got[2])


def blobs(spark, n=40, width=8, k=3, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 5, (k, width))
    v = np.concatenate([c + rng.normal(0, 0.3, (n, width)) for c in centres])
    rows = [(i, [float(x) for x in r], i // n) for i, r in enumerate(v)]
    return v, spark.createDataFrame(rows, "doc_id long, embeddings array<double>, blob int")


def test_pca_keeps_the_most_variance(spark):
    v, df = blobs(spark)
    got = np.array([[r.Dim0, r.Dim1] for r in reduce.reduce_pca(df, 2).orderBy("doc_id").collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(v.T)))[::-1]
    assert np.allclose(np.cov(got.T), np.diag(values[:2]), atol=1e-6)


def test_vector_neighbours(spark):
    v, df = blobs(spark, n=200)
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = [set(np.argsort(row)[:5].tolist()) for row in d]

    def found(**options):
        got = reduce.vector_neighbours(df, 5, **options).collect()
        assert len(got) == len(v)
        return np.mean([len({n.id for n in r.nbrs} & want[r.id]) / 5 for r in got])

    assert found() == 1.0
    assert found(block_rows=128, projections=6) > 0.8


def test_vector_neighbours_do_not_depend_on_partitions(spark):
    _, df = blobs(spark, n=300)
    got = []
    for parts in ("3", "17"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = reduce.vector_neighbours(df.repartition(int(parts)), 5, block_rows=64).collect()
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
        got.append({r.id: [n.id for n in r.nbrs] for r in rows})
    assert got[0] == got[1]


def test_neighbours_of_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (30, 32))
    v = centres[rng.integers(0, 30, 6000)] + rng.normal(0, 0.5, (6000, 32))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "doc_id long, embeddings array<double>")
    asked = rng.choice(6000, 150, replace=False)
    want = {}
    for i in asked.tolist():
        d = np.linalg.norm(v - v[i], axis=1)
        d[i] = np.inf
        want[i] = set(np.argsort(d)[:10].tolist())
    got = {r.id: [n.id for n in r.nbrs] for r in reduce.vector_neighbours(df, 10, projections=2, block_rows=256).collect()}
    assert len(got) == 6000 and all(len(set(x)) == 10 for x in got.values())
    assert np.mean([len(want[i] & set(got[i])) / 10 for i in want]) > 0.9


def test_semantic_dedup_of_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, 16) + rng.normal(0, 1e-4, (6000, 16))
    rows = [(i, 0, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "doc_id long, klabel int, embeddings array<double>")
    assert [r.doc_id for r in dedup.semantic_dedup(df).collect()] == [0]


def test_semantic_dedup_of_a_ring(spark):
    # Rows of one cell, few of which are close to the earliest one.
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    ring = np.concatenate([np.stack([np.cos(turn), np.sin(turn)], 1) * 0.3, np.ones((400, 1))], axis=1)
    v = ring[np.random.default_rng(2).permutation(400)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, 0, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "doc_id long, klabel int, embeddings array<double>")
    want = {i for i in range(400) if not any(u[i] @ u[j] > 0.9 for j in range(i))}
    exact = {i for i in range(400) if not any(u[i] @ u[j] > 0.9999 for j in range(i))}
    for tile_rows in (16, 1024):
        assert {r.doc_id for r in dedup.semantic_dedup(df, threshold=0.9, tile_rows=tile_rows).collect()} == want
        assert {r.doc_id for r in dedup.semantic_dedup(df, threshold=0.9999, tile_rows=tile_rows).collect()} == exact


def test_layout_keeps_blobs_apart(spark):
    v, df = blobs(spark)
    got = reduce.reduce_dimensions(df, 2, "umap", n_neighbors=8, epochs=6).orderBy("doc_id").collect()
    p = np.array([[r.Dim0, r.Dim1] for r in got])
    assert np.isfinite(p).all() and len(p) == len(v)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    blob = np.array([r.blob for r in got])
    assert np.mean(blob[d.argmin(axis=1)] == blob) > 0.9


def test_spectral_start_is_that_of_dense_matrices(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(0, 1, (70, 2)) * [3, 1]
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    w = np.where(d < 0.45, np.exp(-d), 0.0)
    np.fill_diagonal(w, 0)
    root = np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(np.eye(70) - w / root[:, None] / root[None])
    a, b = np.nonzero(np.triu(w))
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(a, b)], "a long, b long, weight double")
    ids = spark.createDataFrame([(i,) for i in range(71)], "id long")  # the last one has no edge
    rows, found = spectral.spectral_start(edges, ids, 2, change=1e-8)
    got = np.array([[r.Dim0, r.Dim1] for r in rows.orderBy("id").collect()])
    assert values[0] < 1e-9 < values[1] and np.allclose(found, values[1:3], atol=1e-4)
    assert np.allclose(np.abs((vectors[:, 1:3] * got[:70]).sum(0)), 1, atol=1e-2) and not got[70].any()


def test_layout_from_the_spectral_start(spark):
    v, df = blobs(spark)
    got = reduce.reduce_umap(df, 2, n_neighbors=8, epochs=4, start="spectral").orderBy("doc_id").collect()
    p = np.array([[r.Dim0, r.Dim1] for r in got])
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    blob = np.array([r.blob for r in got])
    assert np.isfinite(p).all() and np.mean(blob[d.argmin(axis=1)] == blob) > 0.9


def test_curve_is_the_published_one():
    a, b = reduce.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01


def test_semantic_dedup_finds_every_close_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (60, 16))
    v = np.concatenate([base, base[:30] + rng.normal(0, 0.01, (30, 16)), np.repeat(base[:1], 40, axis=0)])
    group = [int(i % 2) for i in range(len(v))]
    rows = [(i, g, [float(x) for x in r]) for i, (g, r) in enumerate(zip(group, v))]
    df = spark.createDataFrame(rows, "doc_id long, klabel int, embeddings array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for threshold in (0.9999, 0.999, 0.9):
        kept = {r.doc_id for r in dedup.semantic_dedup(df, threshold=threshold).collect()}
        want = {
            i for i in range(len(v))
            if not any(group[j] == group[i] and u[i] @ u[j] > threshold for j in range(i))
        }
        assert kept == want


def test_flags_have_both_polarities(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, None)], "doc_id long, cosine_sim double")
    plain = {r.doc_id: (r.similar, r.Drop) for r in dedup.flag_similar(df).collect()}
    literal = {r.doc_id: r.Drop for r in dedup.flag_similar(df, literal=True).collect()}
    assert plain == {1: (True, True), 2: (False, False), 3: (False, False)}
    assert literal == {1: False, 2: True, 3: True}


def test_sdedup_groups_blobs(spark):
    _, df = blobs(spark)
    got = dedup.sdedup(df, k=3, threshold=0.5)
    assert got.count() == 120 and {"klabel", "cosine_sim", "similar", "Drop"} <= set(got.columns)
    assert got.groupBy("blob").agg(F.count_distinct("klabel").alias("n")).agg(F.max("n")).first()[0] <= 2


def test_block_entries_are_plain_numbers():
    """No Python object for each neighbour: a table of three number columns, the k nearest of each row."""
    from textloom.operators.reduce import _block_neighbours

    v = np.random.default_rng(8).normal(0, 1, (300, 4))
    got = _block_neighbours(np.arange(300) * 10, v, 5)
    assert [str(t) for t in got.dtypes] == ["int64", "int64", "float64"] and len(got) == 1500
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {i * 10: sorted((np.argsort(row)[:5] * 10).tolist()) for i, row in enumerate(d)}
    assert {i: sorted(g["to"].tolist()) for i, g in got.groupby("id")} == want
    assert len(_block_neighbours(np.array([7]), v[:1], 5)) == 0
