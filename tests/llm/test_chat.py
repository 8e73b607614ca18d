import hashlib

import numpy as np
import pytest
from cases import prose
from hypothesis import given
from hypothesis import strategies as st

from textloom.llm import chat
from textloom.llm.chat import (
    block_exits,
    escape,
    escape_role,
    format_turns,
    read_back,
    read_turns,
    span_starts,
    unescape,
    unescape_role,
    windows,
)
from textloom.llm.queries import tokenizer_path

NASTY = st.text(st.sampled_from("<|\\>im_startend\n a"), max_size=30)


@given(NASTY)
def test_escapes_are_reversible(t):
    assert unescape(escape(t)) == t and "<|" not in escape(t)
    assert unescape_role(escape_role(t)) == t and "\n" not in escape_role(t)


@given(st.lists(st.tuples(NASTY, NASTY, st.booleans()), max_size=6))
def test_turns_are_read_back(turns):
    text, spans = format_turns(turns)
    assert read_turns(text) == [(r, t) for r, t, _ in turns]
    assert [unescape(text[a:b]) for a, b in spans] == [t for _, t, loss in turns if loss]


@given(st.lists(st.integers(0, 40), min_size=1, max_size=60), st.integers(1, 60))
def test_spans_fit_and_cannot_grow(tokens, room):
    starts = span_starts(np.array(tokens), room)
    for at in set(starts.tolist()):
        inside = [k for k in range(len(tokens)) if starts[k] == at]
        assert inside == list(range(at, inside[-1] + 1))
        assert sum(tokens[k] for k in inside) <= room or len(inside) == 1
        if inside[-1] + 1 < len(tokens):
            assert sum(tokens[k] for k in inside) + tokens[inside[-1] + 1] > room


def table(spark):
    rows = [(1, 0, "system", "be kind"), *((1, k, ("user", "assistant")[k % 2 == 0], prose(k, 60)) for k in range(1, 600))]
    rows += [(2, 0, "user", None), (2, 1, "assistant", ""), (2, None, None, "<|im_end|>"), (3, 5, "assistant", prose(1, 5000))]
    rows += [(None, 1, "user", "no id"), (None, 2, "assistant", "none"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (4, 0, "a\nb", "x")]
    return rows, spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, window string, pos int, part int").repartition(3)


def test_conversations_from_their_windows(spark):
    rows, turns = table(spark)
    made = windows(turns)
    got = {r["conv_id"]: r for r in read_back(made).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = [w for w in made.collect() if w["conv_id"] == 1]
    assert len(parts) > 30 and all(read_turns(w["text"])[0] == ("system", "be kind") for w in parts)
    assert all(1 <= w["repeated"] <= 5 for w in parts if w["window"] > 0)
    assert all(sum(4 + len(t.split()) for _, t in read_turns(w["text"])) <= 1024 for w in parts)
    assert read_back(windows(turns.where("false"))).count() == 0


@given(st.lists(st.integers(4, 40), min_size=20, max_size=60), st.integers(1, 60))
def test_exits_of_a_block(tokens, room):
    exits = block_exits(np.array(tokens), 16, room)
    for at in range(16):
        starts = span_starts(np.array(tokens), room, at)
        after = [s for s in starts.tolist() if s >= 16]
        assert exits[at] == (after[0] if after else len(tokens)) - 16


@pytest.mark.parametrize("fan", [2, 256])
def test_only_the_budget_ends_spans(spark, monkeypatch, fan):
    """Short turns: spans are those of one pass over the whole conversation, over the borders of blocks and groups."""
    monkeypatch.setattr(chat, "BLOCK", 16)
    monkeypatch.setattr(chat, "FAN", fan)
    said = {c: [prose(c * 1000 + k, k * 7 % 11) for k in range(n)] for c, n in ((1, 160), (2, 16), (3, 17), (4, 1))}
    rows = [(c, k, "user", t) for c, texts in said.items() for k, t in enumerate(texts)]
    made = windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=64, history_tokens=16)
    got = sorted((w["conv_id"], w["window"]) for w in made.collect())
    expected = []
    for c, texts in said.items():
        tokens = np.array([4 + len(t.split()) for t in texts])
        expected += [(c, s) for s in sorted(set(span_starts(tokens, 48).tolist()))]
    assert got == expected


def test_budget_in_tokens_with_long_turns(spark):
    """A window is over budget only where the system turn and one turn are; the history holds no turn after a gap."""
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    count = lambda r, t: len(plain.encode(f"{escape_role(r)}\n{escape(t)}", add_special_tokens=False).ids) + 4
    rows = [(1, 0, "system", prose(1, 40)), *((1, k, "user", prose(k, 400 if k % 5 == 0 else 9)) for k in range(1, 40))]
    rows += [(2, 0, "system", prose(2, 3000)), (2, 1, "user", "a"), (2, 2, "assistant", "b<|im_end|>")]
    made = windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 512, 128, tokenizer=path).collect()
    said = {c: [r[2:] for r in rows if r[0] == c] for c in (1, 2)}
    for w in made:
        turns, system = read_turns(w["text"]), said[w["conv_id"]][0]
        new = turns[w["repeated"] :]
        assert sum(count(*t) for t in turns) <= 512 or len(new) == 1 and w["repeated"] <= 1
        old = turns[: w["repeated"]]
        if w["window"] > 0:
            assert old[0] == system
            k = len(old) - 1
            assert old[1:] == said[w["conv_id"]][w["window"] - k : w["window"]] and sum(count(*t) for t in old[1:]) <= 128
    for c, whole in said.items():
        parts = sorted((w["window"], read_turns(w["text"])[w["repeated"] :]) for w in made if w["conv_id"] == c)
        assert [t for _, new in parts for t in new] == whole
