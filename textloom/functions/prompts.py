"""A small built-in prompt catalogue.

The usual way in is the caller's own prompt table (``prompt_table`` of ``stage_two``, with the
columns kind, id, step, content). These defaults make every flow run: an opening for the model,
two ways to present the lines, two chains that end in a request for the label, and points
for a critique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import PROMPTS

ANSWER_FORMAT = 'Label: "..."'

SYSTEM_PROMPTS = (
    "Act as an archivist who files groups of short posts. Each group gets a folder name that a "
    f"stranger would understand without opening the folder. Reply only with {ANSWER_FORMAT}",
)

USER_PROMPTS = (
    "Name the folder for these posts, one per line:\n",
    "Here are excerpts from one folder, one per line. Ignore spelling and tone; go by what is "
    "being talked about, and name the folder.\n\nExcerpts:\n",
)

QUESTION_CHAINS = (
    (
        "Would that name also fit a folder of unrelated posts? Say why or why not.",
        "Quote two lines that the name covers and one line that it covers least.",
        "Which single word in the name carries the least information?",
        "Propose two other names, one broader and one narrower.",
        f"Decide on one name, no longer than a headline, and write {ANSWER_FORMAT}",
    ),
    (
        "List the nouns that come up in several lines.",
        "What happened, or what do the writers want? One sentence.",
        "Who or what is mentioned by name?",
        f"Turn these notes into one name, no longer than a headline, and write {ANSWER_FORMAT}",
    ),
)

SUFFIX = f"\n\nEnd your reply with {ANSWER_FORMAT}"

CRITERIA = (
    "Grade the folder name from 1 (misleading) to 5 (could not be better). Give one line of the "
    "posts as evidence, and one change that would raise the grade."
)


def prompt_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table (kind, id, step, content)."""
    rows = [("system", i, 0, p) for i, p in enumerate(SYSTEM_PROMPTS)]
    rows += [("user", i, 0, p) for i, p in enumerate(USER_PROMPTS)]
    rows += [
        ("question", i, step, q)
        for i, chain in enumerate(QUESTION_CHAINS)
        for step, q in enumerate(chain)
    ]
    rows.append(("suffix", 0, 0, SUFFIX))
    rows.append(("criteria", 0, 0, CRITERIA))
    return spark.createDataFrame(rows, PROMPTS)
