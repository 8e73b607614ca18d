"""Memory of Python workers: what a step holds, and what it leaves behind."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from textloom.llm import arrays, packing
from textloom.llm import toxicity as T


def random_sets() -> list[np.ndarray]:
    """Sets of which few features are shared."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    return [np.unique(np.append(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2), rng.choice(common, 50))) for _ in range(200)]


def test_shared_keys_are_those_of_enough_texts():
    sets = [*random_sets(), np.empty(0, np.uint64), np.array([0, 2**64 - 1], np.uint64)] + [np.array([2**64 - 1], np.uint64)] * 2
    keys, n = np.unique(np.concatenate(sets), return_counts=True)
    got = T.shared_keys(sets)
    assert got.dtype == np.uint64 and np.array_equal(got, keys[n >= T.LEAST_TEXTS]) and got[-1] == 2**64 - 1
    assert not len(T.shared_keys([np.empty(0, np.uint64)] * 3))


def test_training_never_puts_all_features_together():
    sets = random_sets()
    whole = sum(s.nbytes for s in sets)
    tracemalloc.start()
    T.ftrl(sets, np.arange(len(sets)) % 2 * 1.0, epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.4 * whole


def test_known_runs_take_little_memory_and_give_the_same_ids():
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(30_000)]
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for k in range(0, len(words), 3000):
        tokens.texts([" ".join(words[k : k + 3000]).encode()])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(tokens.runs) == len(words) and held < 100 * len(words)
    # Known, new, repeated and other words in one text.
    for text in (f"{words[7]} newword {words[3]}'s NEWWORD 12 \u0416\u0443\u043a {words[7]}", "", "\u0416\u0443\u043a", "a <|endoftext|> b"):
        got = np.frombuffer(tokens.texts([text.encode(), b"x"])[0], "<u4").tolist()
        assert got == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_blocks_give_free_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(arrays, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * arrays.BLOCK_BYTES] * 9)], ["text"])
    assert sum(len(rows) for _, rows in arrays.text_blocks(iter([batch] * 4))) == 36
    assert len(calls) == 3  # after each 16 MB, and at the end
    arrays.text_blocks(iter([])).close()


def test_pipeline_sends_texts_in_small_batches(spark):
    docs = spark.createDataFrame([(i, "x" * 10_000) for i in range(3000)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    session = spark.newSession()
    corpus_pipeline.secret_stage(session, docs, "")
    frame = session.range(3000).selectExpr("id", "repeat('x', 10000) as text").coalesce(1)
    assert max(r["n"] for r in frame.mapInArrow(sizes, "n long").collect()) < 2 * arrays.BATCH_BYTES
    own = spark.newSession()
    own.conf.set(arrays.BATCH_LIMIT, 1 << 20)
    arrays.small_batches(own)
    assert int(own.conf.get(arrays.BATCH_LIMIT).rstrip("b")) == 1 << 20
