import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import LOWER, SCHEMA, awkward, documents, prose

from textloom.llm.ppm import Model, score_texts
from textloom.llm.quality import quality
from textloom.llm.toxicity import drop_toxic, toxicity


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def plain_base(rows):
    fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i, _ in rows]
    counts = Counter()
    for f, (_, t) in zip(fold, rows):
        if f:
            counts.update([*plain_words(t), None])
    n, v, out = sum(counts.values()), len(counts), []
    for f, (i, t) in zip(fold, rows):
        tokens = [*plain_words(t), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        out.append((i, f == 0, len(tokens), sum(x in counts for x in tokens), n, base))
    return out


def plain_ppm(training, text, order):
    """log10 probability by the definition, one symbol at a time."""
    counts = {}
    for t in training:
        data = b"\0" * order + t.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) + b"\0"
        for k in range(order, len(data)):
            for d in range(order + 1):
                counts.setdefault(data[k - d : k], Counter())[data[k]] += 1
    data, total = b"\0" * order + text.lower() + b"\0", 0.0
    for k in range(order, len(data)):
        depth = max((d for d in range(order + 1) if data[k - d : k] in counts), default=-1)
        excluded, p, weights = set(), 1.0, None
        for d in range(depth, -1, -1):
            here = {s: n for s, n in counts[data[k - d : k]].items() if s not in excluded}
            if not here:
                continue
            whole = sum(here.values()) + len(here)
            if data[k] in here:
                weights = p * here[data[k]] / whole
                break
            p *= len(here) / whole
            excluded |= set(here)
        total += math.log10(weights if weights is not None else p / (256 - len(excluded)))
    return total


def test_model_is_ppm_with_exclusion():
    training = [b"abracadabra", b"abra cab", b"", b"bar \xc3\xa9"]
    order = 3
    counts = Counter()
    for t in training:
        data = b"\0" * order + t + b"\0"
        for k in range(order, len(data)):
            for d in range(order + 1):
                counts[d, int.from_bytes(data[k - d : k], "big"), data[k]] += 1
    rows = pa.table({n: [k[i] for k in counts] for i, n in enumerate(("depth", "context", "symbol"))} | {"n": list(counts.values())})
    model = Model(rows, order)
    texts = [b"abra", b"", b"zebra", b"\xc3\xa9a", b"cadabra bar"]
    assert model.score(texts) == pytest.approx([plain_ppm(training, t, order) for t in texts], rel=1e-4)
    assert np.allclose((10.0**model.log10).sum(1), 1, atol=1e-4)


def test_base_scores_and_rare_words(spark):
    rows = awkward() + [(50 + k, prose(k, 80, 50)) for k in range(40)]
    key = lambda r: tuple((x is None, x or 0) for x in r[:4])
    expected = sorted(plain_base(rows), key=key)
    for hot in (16, 1 << 19):
        got = sorted((tuple(r) for r in score_texts(documents(spark, rows), hot_words=hot, contexts=500).collect()), key=key)
        assert [g[:5] for g in got] == [e[:5] for e in expected]
        assert [g[5] for g in got] == pytest.approx([e[5] for e in expected])
        assert all(g[6] < 0 for g in got)
    empty = [r for r in got if r[0] == 2][0]
    assert empty[2] == 1
    assert score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_contexts_score_too(spark):
    rows = [(k, prose(k, 30, 50) + " é"[: k % 3]) for k in range(25)] + [(90, None), (91, "zzq zzq zzq \u00fc")]
    training = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    expected = {i: plain_ppm(training, (t or "").encode(), 4) for i, t in rows}
    for contexts in (0, 60, 1 << 15):
        got = {r["doc_id"]: r["score"] for r in score_texts(documents(spark, rows), contexts=contexts).collect()}
        assert got == pytest.approx(expected, rel=1e-4)


def labelled_table(spark):
    rows, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        text = prose(k, 40 + k % 50)
        rows.append((k, text.replace(" ", " vile ", 2) + " !!! !!!" if bad else text))
        labels.append((k, int(not bad), int(bad)))
    labels += [(1, None, None), (2, 7, 7), (None, 1, 1), (9999, 0, 1)]
    docs = documents(spark, [(i + 1000 if i in (1, 2, 3) else i, t) for i, t in awkward() if i not in (5, 6, 7, 8)] + awkward()[4:6] + rows[4:])
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def rate(rows, labels):
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled_table(spark)
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) for r in rows)
    assert rate([r for r in rows if (r["doc_id"] or 0) > 8], {k: int(k % 4 == 0) for k in range(9, 240)}) > 0.95
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["predicted"] for r in rows)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = labelled_table(spark)
    held = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    flipped = labels.selectExpr("doc_id", "quality", f"case when {held} then 1 - toxic else toxic end as toxic")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    assert sorted(toxicity(docs, labels).collect(), key=key) == sorted(toxicity(docs, flipped).collect(), key=key)


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled_table(spark)
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rate([r for r in rows if (r["doc_id"] or 0) > 8], {k: int(k % 4 != 0) for k in range(9, 240)}) > 0.9


def test_no_labels_and_no_documents(spark):
    docs, labels = labelled_table(spark)
    none = labels.where("false")
    assert {r["score"] for r in toxicity(docs, none).collect()} == {0.5}
    assert {r["score"] for r in quality(docs, none).collect()} == {0.5}
    assert toxicity(docs.where("false"), labels).count() == 0 == quality(docs.where("false"), labels).count()


def test_toxicity_training_never_holds_all_features():
    """Most features are rare; those of all texts together are more than training needs."""
    import tracemalloc

    from textloom.llm import toxicity as T
    from textloom.llm.arrays import Hasher

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(20_000)]
    blocks = [[" ".join(rng.choice(words, 100)).encode() for _ in range(100)] for _ in range(20)]
    sets = [x for rows in blocks for x in T.distinct_features(rows, Hasher())]
    want = T.without_rare(sets)
    whole = sum(x.nbytes for x in sets)
    del sets
    tracemalloc.start()
    got = T.frequent_features(blocks)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert not blocks and all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))
    assert held < 0.6 * whole
