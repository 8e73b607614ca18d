"""Secret scans: fixed forms, and values in a credential context that are costly to guess.

Fixed forms are found by patterns (leftmost, without overlap, per kind). Other values that
stand in a credential context are cut into the cheapest chain of words, dates, repeats,
keyboard walks and brute-force spans by dynamic programming. The cost is the log10 of the
guesses an attacker needs; a value that costs ``least_cost`` or more is a secret of kind
``guess``. A dictionary word as a value is cheap and stays.

The keys of the fixed form ``assign`` are credential contexts too, so a value that this form
misses, or of which it takes only the beginning, is scored. A value of letters only is prose,
whatever its cost, if each of its words (cut before capitals) can be spoken: it has a vowel and
no run of more than four consonant sounds, or is a short acronym. The same holds for such
words joined by signs when they follow an ``assign`` key after a mere space ("token time-out").
Other values of letters are scored.

Null texts are empty. Every row gives one row, also with repeated doc_ids; other columns are
ignored. Spans are code points of the original text, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrays import LOWER, text_blocks

KINDS = ("assign", "access", "hex", "guess")
LEAST_COST = 10.0
MARK = "[secret]"

# Forms of the contract.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

HEX_FLAGS = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
CONTEXT = re.compile(
    rb"(?:passphrase|credentials?|authorization|bearer|signature|private_?key|access_?key|session_?key|auth|pwd|pass|pin"
    rb"|(?P<main>password|passwd|secret|token|api[_-]?key))"
    rb"[\"']?(?:\x20*[:=]\x20*|\x20+is\x20+|(?P<space>\x20+))[\"']?(?P<value>[!-&(-~]{6,})"
    rb"|://[^\s:/@]+:(?P<url>[^\s@]{6,})@",
    re.I,
)
CONTEXT_WORDS = (b"pass", b"credential", b"auth", b"bearer", b"signature", b"key", b"pwd", b"pin", b"secret", b"token", b"://")
KEY_BYTES = 64  # a value up to this size may be the key of the next value
RUNS_ON = b"!#$%^*~@|\\"  # signs with which a value goes on where the fixed form ends

# Words that can be spoken: consonants that make one sound count once.
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SOUND = re.compile("sch|[cgpst]h|ck|ng|st")
UNSPOKEN = re.compile("[^aeiouy]{5}")

# Common words and names in passwords, most common first; the rank is the cost.
COMMON = (
    "password love admin welcome hello monkey dragon master login princess qwerty letmein sunshine shadow "
    "football baseball superman batman trust secret summer winter spring autumn flower cookie banana orange "
    "purple silver golden tiger eagle mustang harley hunter killer soccer hockey ranger buster daniel thomas "
    "michael jordan robert andrew charlie jessica ashley nicole amanda jennifer computer internet server "
    "google test guest user root default changeme access system money house happy lucky angel star moon sun "
    "black white green blue red dog cat fish bird king queen prince magic power freedom peace forever family "
    "friend music guitar school teacher doctor london paris berlin example sample token key pass word the and "
    "you for one two three four five six seven eight nine ten please none null true false"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LONGEST = max(map(len, COMMON))
LEET = str.maketrans("4@31!0$57", "aaeiiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {r[i : i + 2] for r in ROWS for i in range(len(r) - 1)}
NEXT |= {p[::-1] for p in NEXT}
DATE = re.compile(
    r"(?:19|20)\d\d[-/._ ]?(?:0[1-9]|1[0-2])[-/._ ]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._ ]?(?:0[1-9]|1[0-2])[-/._ ]?(?:19|20)?\d\d|(?:19|20)\d\d"
)
REPEAT = re.compile(r"(.{1,4}?)\1{1,}", re.S)


def _per_character(value: str) -> float:
    """log10 of the alphabet that a brute-force search must try."""
    size = sum(
        n
        for n, has in (
            (10, any(c.isdigit() for c in value)),
            (26, any(c.islower() for c in value)),
            (26, any(c.isupper() for c in value)),
            (33, any(not c.isalnum() for c in value)),
        )
        if has
    )
    return log10(max(size, 10))


def pieces(value: str) -> list[tuple[int, int, float, str]]:
    """(start, end, cost, kind) of all parts that are cheaper than brute force."""
    out, n, folded = [], len(value), value.lower()
    plain = folded.translate(LEET) if len(folded.translate(LEET)) == n else folded
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = RANK.get(folded[i:j]) or RANK.get(plain[i:j])
            if rank:
                odd = 2 if value[i:j] != folded[i:j] else 1
                leet = 2 if folded[i:j] not in RANK else 1
                out.append((i, j, log10(rank * odd * leet + 1), "word"))
    i = 0
    while i < n - 2:
        j = i + 1
        while j < n and folded[j - 1 : j + 1] in NEXT:
            j += 1
        if j - i >= 3:
            out.append((i, j, log10(50 * (j - i)), "walk"))
        i = max(j - 1, i + 1)
    for m in DATE.finditer(value):
        out.append((m.start(), m.end(), log10(120 * (366 if m.end() - m.start() > 4 else 1)), "date"))
    for m in REPEAT.finditer(value):
        if m.end() - m.start() >= 3:
            unit = len(m[1])
            out.append((m.start(), m.end(), unit * _per_character(m[1]) + log10((m.end() - m.start()) / unit), "repeat"))
    return out


def guess_cost(value: str) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses of the cheapest chain of parts, and the chain.

    Parts multiply; each further part also multiplies by ten, as its place must be guessed.
    A brute-force span pays for its beginning once and then for each character.
    """
    n, each = len(value), _per_character(value)
    ending: list[list] = [[] for _ in range(n + 1)]
    for p in pieces(value):
        ending[p[1]].append(p)
    best = [0.0] + [float("inf")] * n  # cheapest cost up to here
    back: list = [None] * (n + 1)
    brute, begun = [float("inf")] * (n + 1), [0] * (n + 1)  # cheapest with a brute-force span that ends here
    for j in range(1, n + 1):
        new = best[j - 1] + (1.0 if j > 1 else 0.0) + each
        on = brute[j - 1] + each
        brute[j], begun[j] = (on, begun[j - 1]) if on <= new else (new, j - 1)
        best[j], back[j] = brute[j], (begun[j], "brute")
        for i, _, cost, kind in ending[j]:
            total = best[i] + cost + (1.0 if i else 0.0)
            if total < best[j]:
                best[j], back[j] = total, (i, kind)
    chain, j = [], n
    while j:
        i, kind = back[j]
        chain.append((i, j, kind))
        j = i
    return best[n], chain[::-1]


def _spoken(value: str) -> bool:
    """Whether all words of the value can be spoken, or are short acronyms."""
    words = WORD.findall(value)
    sounds = ((w, SOUND.sub("t", w.lower())) for w in words)
    return all((w.isupper() and 1 < len(w) <= 5) or (re.search("[aeiouy]", s) and not UNSPOKEN.search(s)) for w, s in sounds)


def _prose(value: str, joined: bool) -> bool:
    if value.isalpha():
        return _spoken(value)
    return joined and all(w.isalpha() and _spoken(w) for w in re.split(r"[-/.,;:_&()]+", value) if w)


def _guessed(text: bytes, found: list[tuple[int, int, str]], least_cost: float) -> Iterator[tuple[int, int, str]]:
    """Values in a credential context that are costly to guess, where they are not in ``found``."""
    # Spans in order, and the furthest end up to each.
    taken = sorted((a, b) for a, b, _ in found)
    starts, furthest = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    at = 0
    while m := CONTEXT.search(text, at):
        name = "url" if m["url"] is not None else "value"
        a, b = m.span(name)
        at = a if name == "value" and b - a <= KEY_BYTES else b
        quote = text[a - 1 : a]
        if name == "value" and quote in (b'"', b"'") and (end := text.find(quote, a, b)) >= 0:
            b = end
        while b > a and text[b - 1 : b] in b".,;:!?)\"'":
            b -= 1
        if b - a < 6:
            continue
        value = text[a:b].decode("latin-1")
        over = bisect_left(starts, b)
        if over and furthest[over - 1] > a:
            a = furthest[over - 1]
            if a >= b or text[a] not in RUNS_ON:
                continue
        if guess_cost(value)[0] >= least_cost and not _prose(value, bool(m["main"] and m["space"])):
            yield a, b, "guess"
            at = max(at, b)


def find_secrets(text: bytes, least_cost: float = LEAST_COST) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of all secrets of a text."""
    found, low = [], text.translate(LOWER)
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    flags = text.translate(HEX_FLAGS)
    at = flags.find(b"1" * LEAST["hex"])
    while at >= 0:
        end = flags.find(b"0", at)
        end = len(text) if end < 0 else end
        found.append((at, end, "hex"))
        at = flags.find(b"1" * LEAST["hex"], end)
    if any(w in low for w in CONTEXT_WORDS):
        found += list(_guessed(text, found, least_cost))
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def in_code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not spans or text.isascii():
        return spans
    # Bytes before each place that only go on with a code point.
    more = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) == 0x80, dtype=np.int32)))
    return [(a - int(more[a]), b - int(more[b]), k) for a, b, k in spans]


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """(doc_id, spans): all secrets of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in text_blocks(batches):
            spans = [
                [{"start": a, "end": b, "kind": k} for a, b, k in in_code_points(t, find_secrets(t, least_cost))] for t in rows
            ]
            shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, shape)], ["doc_id", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<start:long,end:long,kind:string>>")


def secret_digest(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """Counts per kind, a digest of the fixed forms, and the list of all spans."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return secret_spans(docs, least_cost).select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(text: bytes, least_cost: float = LEAST_COST, mark: str = MARK) -> bytes:
    """The text with each run of secrets replaced by a mark."""
    out, at = [], 0
    for a, b, _ in find_secrets(text, least_cost):
        if a >= at:
            out += [text[at:a], mark.encode()]
        at = max(at, b)
    return b"".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """``docs`` with secrets replaced in text, and n_chars renewed where a text changed."""
    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in text_blocks(batches):
            at = batch.schema.names.index("text")
            texts = [redact(t, least_cost) if known else None for t, known in zip(rows, batch.column(at).is_valid().to_pylist())]
            columns = batch.columns
            columns[at] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    binary = docs.withColumn("text", F.col("text").cast("binary"))
    out = binary.mapInArrow(rewrite, binary.schema).withColumn("text", F.col("text").cast("string"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(names)
