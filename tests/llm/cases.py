"""Small tables with awkward rows, shared by the tests of the subpackage."""

import random

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = "score double, vertex string, found int, spans string, n int, row string, part int, held_out string, text_a string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
NOTHING = (None,) * 9


def documents(spark, rows):
    """A table of (doc_id, text) with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *NOTHING) for i, t in rows], SCHEMA).repartition(3)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(words))


def edited(text, seed, changes):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def awkward():
    """Null and empty texts, no words, a null id, repeated rows, letters outside ASCII, a very long text."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (None, "a row without id and with some words in it"),
        (5, "repeated row of nine words that comes two times"),
        (5, "repeated row of nine words that comes two times"),
        (6, "Größe é ñ 漢字 mit Wörtern ÄÖ x <|endoftext|> y"),
        (7, prose(7, 60_000)),
        (8, "short one"),
    ]
