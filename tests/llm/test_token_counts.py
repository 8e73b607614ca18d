"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest
from cases import awkward, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tc.Counter(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def counted(texts, counter=COUNTER):
    return counter.texts([t.encode() for t in texts]).tolist()


ODD = st.text(st.sampled_from("aAbsdtrevmlé漢Σσςİß×÷ÿŸ \t\n 　'’.,!?<|>0123½ﬁ́😀\x1c\x00가ÅΩẞ_-"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=40)), max_size=6))
def test_any_text(texts):
    assert counted(texts) == library(texts)


@pytest.mark.parametrize(
    "text",
    [
        "don't I'LL we've 's's ''s 'x they'RE' 'd", "x<|startoftext|>y <|endoftext|><|endoftext|>", "<|EndOfText|> <|startoftext|", "",
        " \n ", "a" * 5000, "ab" * 3000 + " " + "漢" * 3000, "aaa aaaa aaaaa", "éé é", "1234 12a34",
        "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=20_000)),
    ],
)
def test_known_cases(text):
    assert counted([text]) == library([text])


def test_queue_and_rounds_agree(monkeypatch):
    texts = ["".join(random.Random(i).choices("abcdeé ", k=300)) for i in range(30)]
    monkeypatch.setattr(tc, "LONG", 3)
    assert counted(texts, tc.Counter(PATH)) == library(texts)


def test_small_caches_and_library_words(monkeypatch):
    monkeypatch.setattr(tc, "CACHE_WORDS", 5)
    texts = [prose(i, 200) + " naïve Ünï 漢字 <x>" for i in range(5)]
    counter = tc.Counter(PATH)
    assert [counted([t], counter)[0] for t in texts] == library(texts)
    counter.plain = False
    assert counted(texts, counter) == library(texts)


def test_table(spark):
    rows = awkward()
    found = tc.token_counts(documents(spark, rows), PATH, 20)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 20) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert tc.token_counts(documents(spark, []), PATH).collect() == []
