"""The two stages end to end: posts to clusters, clusters to labels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.models import LabellerFactory, TokenizerFactory
from ..functions.patterns import TOKEN
from ..operators import label as L
from ..operators.clean import clean_posts
from ..operators.embed import embed_hashed
from ..operators.language import LanguageDetector
from ..operators.rep_text import add_token_counts, rep_text
from ..operators.reduce import reduce_dimensions
from ..operators.search import Search, cluster_search
from ..sources.scratch import settle


def count_tokens(text: str) -> int:
    """Tokens of one prompt, counted as the token column counts them."""
    return len(regex.findall(TOKEN, text)) + 2


def stage_one(
    posts: DataFrame,
    language: Callable[[Column], Column] | LanguageDetector,
    embed: Callable[[DataFrame], DataFrame] = embed_hashed,
    n_components: int = 2,
    method: str = "pca",
    text_col: str = "text",
    key: str = "doc_id",
    prefer: str = "most",
    reduction: dict | None = None,
) -> Search:
    """Clean, embed, reduce and cluster posts, with a search for the cluster size.

    ``language`` is a function of a text column, or a detector of a profile of any size.  ``embed`` adds an ``embeddings`` column; ``stored_vectors`` reads one that the posts
    have as text.  ``reduction`` goes to the reduction (n_neighbors, min_dist, ...).  The cleaned texts and the vectors
    are each written once; later steps read only the columns they need.
    """
    cleaned = settle(clean_posts(posts, language, text_col, key), "clean")
    embedded = settle(embed(cleaned), "embedded")
    reduced = reduce_dimensions(embedded, n_components, method, key=key, **(reduction or {}))
    dims = [f"Dim{i}" for i in range(n_components)]
    return cluster_search(reduced, dims, key, prefer)


@dataclass
class Labelled:
    """Label table and rows of stage two."""

    labels: DataFrame
    rows: DataFrame


def stage_two(
    clustered: DataFrame,
    labeller: LabellerFactory,
    max_seq_len: int = 512,
    sys_id: int = 0,
    user_id: int = 0,
    cove_id: int | None = None,
    label_col: str = "Label",
    text_col: str = "text",
    random: bool = False,
    sampling_col: str | None = None,
    sdedup: bool = False,
    prompt_table: DataFrame | None = None,
    key: str = "doc_id",
    tokenizer: TokenizerFactory | None = None,
    batch_size: int = 32,
    options: dict | None = None,
    saved_in: str | None = None,
) -> Labelled:
    """Label each cluster and bring the labels to the rows.

    With ``cove_id`` the model goes through that chain of questions, otherwise it
    is asked once.  The label table is written once, so the model runs once.
    ``tokenizer`` counts the tokens of rows and prompts; ``batch_size`` and ``options``
    shape the model's calls.  In the folder ``saved_in`` answers are kept for each question, so a run
    that was lost goes on where it ended.
    """
    spark = clustered.sparkSession
    table = prompt_table if prompt_table is not None else prompts.prompt_table(spark)
    wanted = [("system", sys_id), ("user", user_id), ("suffix", 0)] + [("question", cove_id)] * (cove_id is not None)
    [system], [user], [suffix], *chains = L.lookup_prompts(table, wanted)
    questions = chains[0] if chains else []
    count = (lambda t: tokenizer()([t])[0]) if tokenizer else count_tokens
    content_len = count(user + suffix) + count(system)

    rows = add_token_counts(clustered.na.drop(subset=[text_col]), text_col, tokenizer)
    texts = rep_text(
        rows, max_seq_len, content_len, random=random, sampling_col=sampling_col,
        sdedup=sdedup, key=key, text_col=text_col,
    )
    opening = L.build_dialogs(texts, system, user, suffix)
    if saved_in:
        answered = L.answer_saved(opening, labeller, questions, saved_in, batch_size=batch_size, options=options)
    else:
        answered = L.answer_dialogs(opening, labeller, questions, batch_size=batch_size, options=options)
    labels = settle(L.label_table(answered, label_col), "labels")
    labelled = L.add_format_text(L.attach_labels(rows, labels, label_col), text_col)
    return Labelled(labels, labelled)
