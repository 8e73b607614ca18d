import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import SCHEMA, awkward, documents, prose

from textloom.llm.packing import Plan, WordTokens, dominant_set, pack, plan_packing
from textloom.llm.queries import tokenizer_path


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_pieces_are_whole_and_sequences_gapless(spark):
    rows = awkward() + [(40 + k, prose(k, 10 + 37 * k)) for k in range(25)]
    got = pack(documents(spark, rows), tokenizer_path()).collect()
    expected = []
    for i, t in rows:
        ids = np.array([*plain_ids(t), 0], "<u4")
        expected += [(i, k, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(e[3] for e in expected)
    assert len(used) <= -(-total // 2048) + 1
    assert pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["don't <|startoftext|>x Ünï 12ab", "á b c İ ΑΣ Σ", "!!!  ...\x1c!\x0bq", "<|endoftext|>", ""])
def test_words_give_the_tokens_of_the_text(text):
    assert np.frombuffer(WordTokens(tokenizer_path()).texts([text.encode()])[0], "<u4").tolist() == plain_ids(text)


def fewest(items, room):
    """Fewest sequences by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            place(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, room - items[k]])

    place(0, [])
    return best[0]


def test_fixed_sets_keep_the_optimum():
    rng = random.Random(3)
    for _ in range(60):
        items = [rng.randrange(8, 60) for _ in range(9)]
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        w = max(items)
        group = dominant_set(w, 100, dict(counts))
        if group:
            rest = list(items)
            for x in group:
                rest.remove(x)
            assert 1 + fewest(rest, 100) == fewest(items, 100), (items, group)


def test_plan_covers_each_piece_once():
    rng = random.Random(4)
    for _ in range(30):
        counts = {rng.randrange(1, 65): rng.randrange(1, 300) for _ in range(12)}
        plan = plan_packing(counts, 64)
        ranks, fill = defaultdict(int), defaultdict(int)
        for w, low, high, sequence, offset in plan.ranges:
            assert low == ranks[w]
            ranks[w] = high
            for s in range(sequence, sequence + high - low):
                assert fill[s] == offset or offset + w <= 64
                fill[s] = max(fill[s], offset + w)
        assert ranks == counts and not plan.left
        assert sum(fill.values()) == sum(w * n for w, n in counts.items()) and max(fill.values()) <= 64
    assert Plan(64, {}).left == {}
