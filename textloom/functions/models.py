"""Pluggable model functions, and offline stand-ins that need no model files.

A labeller maps a list of dialogues (and keyword options) to a list of answers.  An
encoder maps a list of texts to one vector each, a tokenizer to one token count each.
All are made by a factory that runs once on each worker, so weights load there and
not on the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import regex

Dialog = Sequence[dict]
Labeller = Callable[..., list[str]]
LabellerFactory = Callable[[], Labeller]
Encoder = Callable[[list[str]], np.ndarray]
EncoderFactory = Callable[[], Encoder]
TokenizerFactory = Callable[[], Callable[[list[str]], list[int]]]

STUB_WORDS = 5
STUB_MIN_LETTERS = 4


def top_words_labeller(prompt: str, suffix: str) -> LabellerFactory:
    """A stand-in whose answer quotes the most frequent longer words of the texts.

    It looks only at the first user turn, between the prompt and its suffix.
    """

    def factory() -> Labeller:
        word = regex.compile(rf"\p{{L}}{{{STUB_MIN_LETTERS},}}")

        def answer(dialog: Dialog) -> str:
            text = next(t["content"] for t in dialog if t["role"] == "user")
            counts = Counter(word.findall(text.removeprefix(prompt).removesuffix(suffix).lower()))
            best = sorted(counts, key=lambda w: (-counts[w], w))[:STUB_WORDS]
            return f'Label: "{" ".join(best)}"'

        return lambda dialogs: [answer(d) for d in dialogs]

    return factory


def letter_pair_tokenizer() -> Callable[[list[str]], list[int]]:
    """A stand-in tokenizer: two characters make a token."""
    return lambda texts: [(len(t) + 1) // 2 for t in texts]


def length_critic() -> Labeller:
    """A stand-in critic that reports the sizes of the text and of the label."""
    return lambda dialogs: [
        f"text {len(d[0]['content'])}, label {len(d[1]['content'])}" for d in dialogs
    ]


def letter_encoder() -> Encoder:
    """A small stand-in encoder: shares of the letters a to z."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 26), np.float32)
        for row, text in zip(out, texts):
            codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
            letters = codes[(codes >= 97) & (codes <= 122)] - 97
            if len(letters):
                row += np.bincount(letters, minlength=26) / len(letters)
        return out

    return encode
