"""Chat formatting: budgeted windows of whole turns with limited history and a loss mask.

1. Turns get a place in their conversation from sums per slice of turn numbers, so that a long
   conversation is not ordered in one task. Repeated turn numbers go by role and text.
2. Prefix sums of turn tokens cut spans of whole turns that fit the budget beside the system turn
   and the history; only the budget ends a span. Where a span ends depends on where the one before
   it ended, so each block of turns first says, for each place at which a span may begin, where the
   first span of the next block then begins. Such maps are joined in bounded groups, level by level,
   and give each block the place of its first span; all blocks cut their spans at once.
3. Each span becomes a window: the conversation's system turn, a few turns before the span
   within the history budget, and the span. Assistant texts of the span are in the loss;
   repeated turns are masked. Turns too long for the history are left out before texts are joined.

Tokens are those of a vocabulary file, or words and signs where none is given, and TURN_TOKENS for
each turn. A window is over budget only where the system turn and one turn are; history gives way
first. A system turn above the budget is repeated all the same, before each turn.

The template is ``<|im_start|>role LF text <|im_end|> LF``. In texts and roles, ``<`` and any
backslashes before ``|`` get one more backslash, so no text can look like a mark, and reading
takes it away again. Line feeds in roles are written as ``\\n``.

Null texts and roles are empty; null conv_ids are one conversation, null turns come first.
Every row is formatted, repeated rows too; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from textloom.llm.arrays import text_blocks
from textloom.llm.token_counts import Counter
from textloom.sources.scratch import settle

BUDGET = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 4
BLOCK = 256  # at least as many turns as a span can have
FAN = 256  # maps of blocks that are joined in one group
SLICE = 64
BEGIN, END = "<|im_start|>", "<|im_end|>"
TURN_TOKENS = 4  # two marks and two line feeds

READ = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text, in loss) turns, and the code point spans in the loss."""
    out, spans, at = [], [], 0
    for role, text, counts in turns:
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        if counts:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_turns(text: str) -> list[tuple[str, str]]:
    return [(unescape_role(r), unescape(t)) for r, t in READ.findall(text)]


def span_ends(tokens: np.ndarray, room: int) -> np.ndarray:
    """For each turn the turn after the span that begins there; a span holds ``room`` tokens or one turn."""
    sums = np.concatenate(([0], np.cumsum(tokens)))
    return np.maximum(np.searchsorted(sums, sums[:-1] + room, "right") - 1, np.arange(1, len(sums)))


def span_starts(tokens: np.ndarray, room: int, at: int = 0, size: int | None = None) -> np.ndarray:
    """For each turn from ``at`` on the first turn of its span, for the spans that begin before ``size``."""
    ends = span_ends(tokens, room)
    first, size, out = at, len(tokens) if size is None else size, []
    while at < size:
        out.append(np.full(ends[at] - at, at, np.int64))
        at = int(ends[at])
    return np.concatenate(out) if out else np.empty(at - first, np.int64)[:0]


def block_exits(tokens: np.ndarray, size: int, room: int) -> np.ndarray:
    """For each place of a block the place in the next block where its first span begins, if a span begins here.

    ``tokens``: the block's ``size`` turns, then those of the next block.
    """
    ends, out = span_ends(tokens, room), np.zeros(size, np.int32)
    for j in range(size - 1, -1, -1):
        out[j] = ends[j] - size if ends[j] >= size else out[ends[j]]
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def joined_exits(maps: pd.Series) -> pd.Series:
    """The map of several blocks in a row."""

    def join(exits):
        at = exits[0]
        for e in exits[1:]:
            at = e[at]
        return at

    return maps.map(join)


@F.pandas_udf(ArrayType(IntegerType()))
def entered(maps: pd.Series, first: pd.Series) -> pd.Series:
    """Where each next block is entered, for blocks in a row of which the first is entered at ``first``."""

    def walk(exits, at):
        out = []
        for e in exits:
            at = e[at]
            out.append(at)
        return out

    return pd.Series([walk(m, f) for m, f in zip(maps, first)])


def block_entries(maps: DataFrame, fan: int) -> DataFrame:
    """(c, b, entry): where the first span begins in each block but a conversation's first, from (conv_id, block, exits)."""
    exits = F.array_sort(F.collect_list(F.struct("block", "exits")))["exits"]  # fan of them at most
    groups = maps.groupBy("conv_id", F.floor(F.col("block") / fan).alias("group")).agg(exits.alias("maps"))
    first = F.lit(0)
    if (maps.agg(F.max("block")).first()[0] or 0) >= fan:
        upper = settle(groups.select("conv_id", F.col("group").alias("block"), joined_exits("maps").alias("exits")), "exits")
        above = block_entries(upper, fan)
        groups = groups.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("group") == F.col("b")), "left")
        first = F.coalesce("entry", first)
    walked = groups.select("conv_id", "group", F.posexplode(entered("maps", first)).alias("at", "place"))
    return walked.select(F.col("conv_id").alias("c"), (F.col("group") * fan + F.col("at") + 1).alias("b"), F.col("place").alias("entry"))


def with_tokens(rows: DataFrame, tokenizer: str | None) -> DataFrame:
    """The rows with the tokens of their role and text, as they are written."""
    if tokenizer is None:
        return rows.withColumn("tokens", F.regexp_count("text", F.lit(r"\w+|[^\w\s]")).cast("long") + TURN_TOKENS)
    process = rows.sparkSession.sparkContext.broadcast({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "counter" not in process.value:
            process.value["counter"] = Counter(tokenizer)
        for batch, texts in text_blocks(batches):
            roles = batch.column("role").to_pylist()
            counts = process.value["counter"].texts([f"{escape_role(r)}\n{escape(t or '')}".encode() for r, t in zip(roles, texts)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts + TURN_TOKENS)], [*batch.schema.names, "tokens"])

    return rows.mapInArrow(count, StructType([*rows.schema, StructField("tokens", LongType())]))


def placed_turns(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, role, text, tokens, pos): each turn with its place from 0."""
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))).alias("slice"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    slices = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    rows = with_tokens(rows, tokenizer)
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("conv_id", "slice").orderBy("turn", "role", "text")
    rows = rows.withColumn("rank", F.row_number().over(own) - 1)
    rows = rows.join(slices, rows["conv_id"].eqNullSafe(slices["c"]) & (rows["slice"] == slices["s"]))
    return settle(rows.select("conv_id", "role", "text", "tokens", (F.col("before") + F.col("rank")).alias("pos")), "turns")


def placed_spans(rows: DataFrame, system: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """(conv_id, pos, window): each turn with the first turn of its span."""
    size = max(BLOCK, (budget - history_tokens) // TURN_TOKENS + 1)
    turn = F.struct("pos", "tokens")
    # Each block also sees the turns of the next one, into which its last span may reach.
    place = F.floor(F.col("pos") / size)
    seen = rows.select("conv_id", "pos", "tokens", F.explode(F.array(place, place - 1)).alias("block")).where("block >= 0")
    blocks = seen.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn))["tokens"].alias("tokens"))
    blocks = blocks.join(system.select("c", "system_tokens"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    room = F.greatest(F.lit(budget - history_tokens) - F.coalesce("system_tokens", F.lit(0)), F.lit(0))
    blocks = settle(blocks.select("conv_id", "block", "tokens", room.cast("long").alias("room")), "blocks")

    @F.pandas_udf("array<int>")
    def exits(tokens: pd.Series, room: pd.Series) -> pd.Series:
        return pd.Series([block_exits(np.asarray(t), size, int(r)) for t, r in zip(tokens, room)])

    @F.pandas_udf("array<long>")
    def cut(tokens: pd.Series, room: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([span_starts(np.asarray(t), int(r), int(e), min(size, len(t))) for t, r, e in zip(tokens, room, entry)])

    # Blocks that are not the last of their conversation; most conversations have none.
    maps = settle(blocks.where(F.size("tokens") > size).select("conv_id", "block", exits("tokens", "room").alias("exits")), "exits")
    known = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    blocks = blocks.join(block_entries(maps, FAN), known, "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    spans = blocks.select("conv_id", "block", "entry", F.posexplode(cut("tokens", "room", "entry")).alias("at", "start"))
    first = F.col("block") * size
    return spans.select("conv_id", (first + F.col("entry") + F.col("at")).alias("pos"), (first + F.col("start")).alias("window"))


def windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    tokenizer: str | None = None,
) -> DataFrame:
    """(conv_id, window, repeated, text, loss): formatted windows of (conv_id, turn, role, text).

    ``window`` is the place of the first new turn, ``repeated`` the number of turns before it
    in the text, ``loss`` the code point spans of assistant texts that count. ``tokenizer``: path
    of a byte-level vocabulary file.
    """
    rows = placed_turns(turns, tokenizer)
    key = F.col("conv_id").alias("c")
    system = rows.where("pos = 0 and role = 'system'").select(key, "role", "text", F.col("tokens").alias("system_tokens"))
    spans = settle(placed_spans(rows, system, budget, history_tokens), "spans")

    def matched(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, left["conv_id"].eqNullSafe(right["c"]) & (left["pos"] == right["p"]))

    fresh = matched(rows, spans.select(key, F.col("pos").alias("p"), "window")).select(
        "conv_id", "window", "pos", "role", "text", "tokens", F.lit(2).alias("part")
    )
    starts = spans.where("pos = window and window > 0").select("conv_id", "window")
    back = F.explode(F.sequence(F.lit(1), F.lit(history_turns)))
    earlier = starts.select(key, "window", back.alias("d")).select("c", "window", (F.col("window") - F.col("d")).alias("p")).where("p >= 0")
    history = matched(rows.where(F.col("tokens") <= history_tokens), earlier).select("conv_id", "window", "pos", "role", "text", "tokens", F.lit(1).alias("part"))
    heads = starts.join(system, starts["conv_id"].eqNullSafe(F.col("c"))).select(
        "conv_id", "window", F.lit(0).cast("long").alias("pos"), "role", "text", F.col("system_tokens").alias("tokens"), F.lit(0).alias("part")
    )
    turn = F.struct("part", "pos", "role", "text", "tokens")
    gathered = fresh.unionByName(history).unionByName(heads).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, losses, repeats = [], [], []
            for parts in batch.column("turns").to_pylist():
                new = [t for t in parts if t["part"] == 2]
                head = [t for t in parts if t["part"] == 0]
                old, left = [], min(history_tokens, budget - sum(t["tokens"] for t in head + new))
                for k, t in enumerate(reversed([t for t in parts if t["part"] == 1 and not (head and t["pos"] == 0)]), 1):
                    left -= t["tokens"]
                    # A turn that is missing here was too long.
                    if left < 0 or t["pos"] != new[0]["pos"] - k:
                        break
                    old.append(t)
                repeated = head + old[::-1]
                text, spans = format_turns(
                    [(t["role"], t["text"], False) for t in repeated] + [(t["role"], t["text"], t["role"] == "assistant") for t in new]
                )
                texts.append(text)
                repeats.append(len(repeated))
                losses.append([{"start": a, "end": b} for a, b in spans])
            shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("window"), pa.array(repeats, pa.int32()), pa.array(texts, pa.string()), pa.array(losses, shape)],
                ["conv_id", "window", "repeated", "text", "loss"],
            )

    kind = turns.schema["conv_id"].dataType.simpleString()
    return gathered.mapInArrow(lay, f"conv_id {kind}, window long, repeated int, text string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows only: turns, digests, and sizes.

    Windows stream through in order; a digest needs its conversation in one order, so only the
    running digest is held, never the conversation.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state = None, None

        def row() -> tuple:
            turns, loss, n, chars, size = state
            return open_id[0], n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            done = []
            for conv, repeated, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "repeated", "text", "loss"))):
                if open_id != (conv,):
                    if state:
                        done.append(row())
                    open_id, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, said in read_turns(text)[repeated:]:
                    state[0].update(f"{role}\n{said}\n".encode())
                    state[2] += 1
                for s in spans:
                    target = unescape(text[s["start"] : s["end"]])
                    state[1].update(target.encode())
                    state[3] += len(target)
                state[4] += len(text)
            if done:
                yield _digests(batch, done)
        if state:
            yield _digests(batch, [row()])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "repeated", "text", "loss").mapInArrow(
        digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digests(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
