"""Labelling clusters with a model: dialogues, model calls, label tables, critique."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.models import LabellerFactory
from ..schemas import DIALOG
from ..sources.scratch import settle


def build_dialogs(
    clusters: DataFrame, system_prompt: str, user_prompt: str, suffix: str, text_col: str = "rep_text"
) -> DataFrame:
    """Adds the opening dialogue of each cluster: a system turn and a user turn."""
    content = F.concat(F.lit(user_prompt), F.col(text_col), F.lit(suffix))
    return clusters.withColumn("dialog", F.array(X.turn("system", system_prompt), X.turn("user", content)))


def _as_dicts(dialog: Sequence) -> list[dict]:
    return [{"role": t["role"], "content": t["content"]} for t in dialog]


def answer_dialogs(
    df: DataFrame,
    labeller: LabellerFactory,
    questions: Sequence[str] = (),
    dialog_col: str = "dialog",
    answer_col: str = "answer",
    batch_size: int = 32,
    options: dict | None = None,
) -> DataFrame:
    """Adds the model's last answer, and every answer to the dialogue.

    Each question is asked after the answer before it.  One call covers at most
    ``batch_size`` dialogues and passes ``options`` (such as a length limit or a
    temperature) on to the model; a failing call fails the task.  Dialogues are spread
    over all cores first, because after an aggregate they sit in few partitions.
    """
    options = dict(options or {})
    questions = list(questions)
    others = [c for c in df.columns if c != dialog_col]
    schema = T.StructType(
        [df.schema[c] for c in others]
        + [T.StructField(dialog_col, DIALOG), T.StructField(answer_col, T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = labeller()
        for batch in batches:
            dialogs = [_as_dicts(d) for d in batch[dialog_col]]
            answers: list[str] = []
            for question in [None, *questions]:
                if question is not None:
                    for d in dialogs:
                        d.append({"role": "user", "content": question})
                parts = [dialogs[i : i + batch_size] for i in range(0, len(dialogs), batch_size)]
                answers = [a for part in parts for a in model(part, **options)]
                for d, a in zip(dialogs, answers, strict=True):
                    d.append({"role": "assistant", "content": a})
            out = batch[others].copy()
            out[dialog_col] = pd.Series(dialogs, index=batch.index, dtype=object)
            out[answer_col] = pd.Series(answers, index=batch.index, dtype=object)
            yield out

    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores).mapInPandas(run, schema)


def answer_saved(
    df: DataFrame,
    labeller: LabellerFactory,
    questions: Sequence[str],
    folder: str,
    dialog_col: str = "dialog",
    answer_col: str = "answer",
    batch_size: int = 32,
    options: dict | None = None,
    waves: int = 1,
) -> DataFrame:
    """The same as ``answer_dialogs``, with a written table of answers for each question.

    An answer is kept under a digest of the dialogue so far and of the options, so a run that was lost asks only
    what has no answer yet, and equal dialogues are asked once.  A question is asked in ``waves``; each one's answers are
    kept when it ends.  Use one folder for each model, in storage that all executors share.
    """
    spark, options = df.sparkSession, dict(options or {})
    schema = "digest string, answer string"
    cores = spark.sparkContext.defaultParallelism

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = labeller()
        for batch in batches:
            for low in range(0, len(batch), batch_size):
                part = batch.iloc[low : low + batch_size]
                answers = model([_as_dicts(d) for d in part["dialog"]], **options)
                yield pd.DataFrame({"digest": part["digest"].to_numpy(), "answer": pd.Series(answers, dtype=object)})

    marks = F.lit(json.dumps(options, sort_keys=True, default=str))
    others = [c for c in df.columns if c != dialog_col]
    now = df.select(*others, F.col(dialog_col).cast(DIALOG).alias("_dialog"), F.lit(None).cast("string").alias("_answer"))
    for number, question in enumerate([None, *questions]):
        if question is not None:
            now = now.withColumn("_dialog", F.concat("_dialog", F.array(X.turn("user", question))))
        now = settle(now.withColumn("_digest", F.sha2(F.concat_ws("\n", marks, F.to_json("_dialog")), 256)), "asked")
        path = f"{folder.rstrip('/')}/answers-{number}"
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
        each = now.select(F.col("_digest").alias("digest"), F.col("_dialog").alias("dialog")).dropDuplicates(["digest"])
        for wave in range(waves):
            known = spark.read.schema(schema).parquet(path).select("digest")
            left = each.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave).join(known, "digest", "left_anti")
            left.repartition(cores).mapInPandas(ask, schema).write.mode("append").parquet(path)
        answers = spark.read.schema(schema).parquet(path).groupBy("digest").agg(F.min("answer").alias("_said"))
        now = now.join(answers, now["_digest"] == answers["digest"]).select(
            *others, F.concat("_dialog", F.array(X.turn("assistant", F.col("_said")))).alias("_dialog"), F.col("_said").alias("_answer")
        )
    return now.select(*others, F.col("_dialog").alias(dialog_col), F.col("_answer").alias(answer_col))


def label_table(
    answered: DataFrame, label_col: str, cluster: str = "clust_id", fallback: bool = False
) -> DataFrame:
    """Label table (Cluster, Text, label, Cluster Count) from answered dialogues."""
    return answered.select(
        F.col(cluster).cast("int").alias("Cluster"),
        X.strip_spaces(F.col("rep_text")).alias("Text"),
        X.extract_label(F.col("answer"), fallback).alias(label_col),
        F.col("n_rows").alias("Cluster Count"),
    )


def attach_labels(
    df: DataFrame, labels: DataFrame, label_col: str, cluster: str = "clust_id"
) -> DataFrame:
    """Adds the label of its cluster to every row; rows of an unknown cluster get null.

    One row for each cluster is written first.  Catalyst broadcasts that table
    when it is small and shuffles otherwise, with its skew handling for noise.
    """
    lookup = settle(labels.select(F.col("Cluster").alias(cluster), label_col), "labels")
    return df.join(lookup, cluster, "left")


def add_format_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("format_text", X.html_wrap(F.col(text_col)))


def lookup_prompts(prompts: DataFrame, wanted: Sequence[tuple[str, int]]) -> list[list[str]]:
    """The steps, in order, of entries (kind, id) of the prompt table; read once for all."""
    match = F.lit(False)
    for kind, prompt_id in wanted:
        match |= (F.col("kind") == kind) & (F.col("id") == prompt_id)
    found: dict[tuple[str, int], list[tuple[int, str]]] = {}
    for r in prompts.where(match).select("kind", "id", "step", "content").collect():  # a handful of catalogue rows
        found.setdefault((r.kind, r.id), []).append((r.step, r.content))
    for kind, prompt_id in wanted:
        if (kind, prompt_id) not in found:
            raise ValueError(f"the prompt table has no {kind} prompt {prompt_id}")
    return [[content for _, content in sorted(found[w])] for w in wanted]


def critique_dialogs(
    labels: DataFrame, label_col: str, criteria: str, text_col: str = "Text"
) -> DataFrame:
    """Dialogue for the critique of each label: text, label, then the criteria."""

    def quoted(lead: str, col: Column) -> Column:
        return F.concat(F.lit(f'{lead} "'), F.coalesce(col, F.lit("nan")), F.lit('"'))

    turns = [
        X.turn("user", quoted("This text was used to label a cluster:", F.col(text_col))),
        X.turn("assistant", quoted("Label:", F.col(label_col))),
        X.turn("user", criteria),
    ]
    return labels.select("Cluster", F.array(*turns).alias("dialog"))


def examine_labels(
    labels: DataFrame,
    label_col: str,
    critic: LabellerFactory,
    criteria: str,
    text_col: str = "Text",
    batch_size: int = 32,
    options: dict | None = None,
) -> DataFrame:
    """Critique table (Cluster, dialog, critique)."""
    dialogs = critique_dialogs(labels, label_col, criteria, text_col)
    return answer_dialogs(dialogs, critic, answer_col="critique", batch_size=batch_size, options=options)
