"""Token alignment against whole-text encodings and plain counting."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import awkward, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import alignment as al

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
BOTH = al.Tokenizers(A_PATH, B_PATH)


def plain_tokens(text):
    """The ids of both tokenizers, or none."""
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    whole = (" " + text).encode()
    for ids, names in ((a, BOTH.bytes[0]), (b, BOTH.bytes[1])):
        if b"".join(names[i] for i in ids) != whole:
            return [], []
    return a, b


def plain_groups(text):
    a, b = plain_tokens(text)
    ends = [np.cumsum([len(n[i]) for i in ids]).tolist() for ids, n in ((a, BOTH.bytes[0]), (b, BOTH.bytes[1]))]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return groups


def digest(groups):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def plain_table(rows):
    groups = [plain_groups(t or "") for _, t in rows]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (i, _), g in zip(rows, groups):
        links = [(a[-1], b[-1]) for a, b in g]
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), best, sum(counts[x] for x in links), digest(g)))
    return sorted(out, key=str)


ODD = st.text(st.sampled_from("aAbé漢字Σo \t\n 　 'sdt!?.<|>0123½́😀\x1c\x00▁   "), max_size=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=40)), max_size=6), st.integers(1, 40))
def test_any_text(texts, work):
    block = al.Aligned(BOTH, [t.encode() for t in texts], work)
    assert block.digests(BOTH) == [digest(plain_groups(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 30))
def test_merge_path(a, b, work):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    rows, columns = al.diagonals(a, b, work)
    assert (np.diff(rows + columns)[:-1] == work).all() and rows[-1] == len(a) and columns[-1] == len(b)
    i, j = al.common_ends(a, b, work)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@pytest.mark.parametrize(
    "text", ["x<|endoftext|>y <s> a </s><unk>", "<0x41>  \n b", " ", "  ", "a ", "a▁b", "don't  we'll", "a\n b\n\n  c", "é" * 3000, "a" * 9000]
)
def test_known_cases(text):
    assert al.Aligned(BOTH, [text.encode()]).digests(BOTH) == [digest(plain_groups(text))]


def test_small_caches(monkeypatch):
    texts = [prose(i, 100) + " «naïve» 漢字 " for i in range(4)]
    monkeypatch.setattr(al, "CACHE_PARTS", 10)
    both = al.Tokenizers(A_PATH, B_PATH)
    assert [al.Aligned(both, [t.encode()]).digests(both)[0] for t in texts] == [digest(plain_groups(t)) for t in texts]


@pytest.mark.parametrize("hot", [1 << 19, 40, 0])
def test_table(spark, hot):
    rows = awkward() + [(20 + i, prose(i, 80)) for i in range(12)] + [(50, "a▁b stays out"), (51, "Ends  with spaces  ")]
    found = al.alignment_digest(documents(spark, rows), A_PATH, B_PATH, hot)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_table(rows)


def test_empty_table_and_arrays(spark):
    assert al.alignment_digest(documents(spark, []), A_PATH, B_PATH).collect() == []
    rows = [(1, "Hello wörld"), (2, None), (3, "a▁b")]
    found = {r.doc_id: r for r in al.alignments(documents(spark, rows), A_PATH, B_PATH).collect()}
    a, b = plain_tokens("Hello wörld")
    groups = plain_groups("Hello wörld")
    assert (found[1].a_ids, found[1].b_ids) == (a, b)
    assert found[1].a_last == (np.cumsum([len(g[0]) for g in groups]) - 1).tolist()
    assert found[1].b_last == (np.cumsum([len(g[1]) for g in groups]) - 1).tolist()
    assert found[2].a_ids == found[3].a_ids == found[3].b_last == []
