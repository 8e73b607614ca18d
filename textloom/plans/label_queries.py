"""Queries for sampling, representative texts, labelling and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as X
from ..functions.models import STUB_MIN_LETTERS, STUB_WORDS, length_critic, top_words_labeller
from ..operators import aggregate, label, rep_text, review, sample
from ..schemas import labels as labels_schema
from ..sources import posts as src
from ..sources import sinks
from ..sources.scratch import new_path, settle
from . import fixtures as fx
from . import stages
from .registry import query
from .text_queries import CLUSTERED, format_sql, strip_sql, tokens_sql

MAX_SEQ_LEN = 7500
CONTENT_LEN = 300
SEED = sample.SEED


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    return fx.clustered(spark, sf)


# Counts.


@query("cluster_counts", f"select clust_id, count(*) as n from ({CLUSTERED}) group by 1 order by 1")
def cluster_counts(spark, sf):
    return aggregate.cluster_counts(clustered(spark, sf))


@query("n_clusters", f"select count(distinct clust_id) as n_clusters from ({CLUSTERED})")
def n_clusters(spark, sf):
    return aggregate.n_clusters(clustered(spark, sf))


@query(
    "cluster_stats",
    f"""select count(distinct clust_id) filter (clust_id <> -1) as n_clusters,
        count(*) filter (clust_id = -1) as n_outliers,
        count(*) filter (clust_id = -1) / count(*) * 100 as pct_outliers from ({CLUSTERED})""",
)
def cluster_stats(spark, sf):
    return aggregate.cluster_stats(clustered(spark, sf))


DROP_FLAG = "clust_id = 3 and length(text) > 100"


@query("filter_semdup", f"select doc_id, clust_id from ({CLUSTERED}) where not ({DROP_FLAG})")
def filter_semdup(spark, sf):
    rows = clustered(spark, sf).withColumn("Drop", F.expr(DROP_FLAG))
    return rep_text.filter_semdup(rows).select("doc_id", "clust_id")


# Sampling.

COUNTED = f"select *, ({tokens_sql('text')})::int as num_tokens, md5(concat('{SEED}:', doc_id)) as h from ({CLUSTERED})"
LONGEST_SQL = f"""select clust_id, doc_id, num_tokens, rank::int as rank from (
    select *, row_number() over (partition by clust_id order by num_tokens desc, doc_id) as rank
    from ({COUNTED})) where rank <= 40"""
SHUFFLED_SQL = f"""select clust_id, doc_id, row_number() over (partition by clust_id order by h) as rank
    from ({COUNTED})"""
STRATIFIED_SQL = f"""select clust_id, doc_id, source,
      row_number() over (partition by clust_id order by h) as rank
    from (select *, min(n) over (partition by clust_id) as smallest from (
      select *, count(*) over (partition by clust_id, source) as n,
        row_number() over (partition by clust_id, source order by h) as r from ({COUNTED})))
    where r <= smallest"""
HALF_SQL = f"""select clust_id, doc_id, rank from (
    select *, row_number() over (partition by clust_id order by h) as rank,
      count(*) over (partition by clust_id) as n from ({COUNTED}))
    where rank <= round_even(n * 0.5, 0)"""


@query("top_k_per_cluster", LONGEST_SQL)
def top_k_per_cluster(spark, sf):
    return sample.longest_rows(rep_text.add_token_counts(clustered(spark, sf)))


@query("sample_random", SHUFFLED_SQL)
def sample_random(spark, sf):
    return sample.shuffled_rows(clustered(spark, sf))


@query("sample_stratified", STRATIFIED_SQL)
def sample_stratified(spark, sf):
    return sample.stratified_rows(clustered(spark, sf), "source")


@query("sample_half", HALF_SQL)
def sample_half(spark, sf):
    return sample.half_rows(clustered(spark, sf))


def budget_sql(ranked: str, content: int = CONTENT_LEN) -> str:
    """Rows of a ranked table (clust_id, doc_id, num_tokens, rank) within the budget."""
    return f"""select clust_id, doc_id, num_tokens, rank, running from (
        select *, (sum(num_tokens) over (partition by clust_id order by rank
          rows between unbounded preceding and current row))::bigint as running from ({ranked}))
        where {content} + running < {rep_text.token_limit(MAX_SEQ_LEN, content)}"""


@query("budget_prefix", budget_sql(LONGEST_SQL))
def budget_prefix(spark, sf):
    ranked = sample.longest_rows(rep_text.add_token_counts(clustered(spark, sf)))
    return rep_text.budget_prefix(ranked, MAX_SEQ_LEN, CONTENT_LEN)


def rep_sql(ranked: str, content: int = CONTENT_LEN) -> str:
    return f"""select s.clust_id, coalesce(t.rep_text, '') as rep_text, s.n_rows
        from (select clust_id, count(*) as n_rows from ({CLUSTERED}) group by 1) s left join (
          select b.clust_id, string_agg(c.text, chr(10) order by b.rank) as rep_text
          from ({budget_sql(ranked, content)}) b join ({CLUSTERED}) c using (doc_id) group by 1) t
        using (clust_id)"""


REP_SQL = rep_sql(LONGEST_SQL)


def with_tokens(ranked: str) -> str:
    return f"select r.*, c.num_tokens from ({ranked}) r join ({COUNTED}) c using (doc_id)"


def rep(spark, sf, **how) -> DataFrame:
    return rep_text.rep_text(clustered(spark, sf), MAX_SEQ_LEN, CONTENT_LEN, **how)


@query("rep_text", REP_SQL)
def rep_text_longest(spark, sf):
    return rep(spark, sf, random=False)


@query("rep_text_random", rep_sql(with_tokens(SHUFFLED_SQL)))
def rep_text_random(spark, sf):
    return rep(spark, sf)


@query("rep_text_stratified", rep_sql(with_tokens(STRATIFIED_SQL)))
def rep_text_stratified(spark, sf):
    return rep(spark, sf, sampling_col="source")


@query("cluster_spine", f"select clust_id, count(*) as n_rows from ({CLUSTERED}) group by 1")
def cluster_spine(spark, sf):
    return rep_text.cluster_spine(clustered(spark, sf))


# Dialogues and labels.

SYSTEM, USER, SUFFIX = prompts.SYSTEM_PROMPTS[0], prompts.USER_PROMPTS[0], prompts.SUFFIX


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def turns(dialogs: DataFrame, key: str) -> DataFrame:
    return dialogs.select(key, F.posexplode("dialog").alias("turn", "t")).select(
        key, "turn", "t.role", "t.content"
    )


@query(
    "build_dialogs",
    f"""select clust_id, 0 as turn, 'system' as role, {quoted(SYSTEM)} as content from ({REP_SQL})
        union all select clust_id, 1, 'user', {quoted(USER)} || rep_text || {quoted(SUFFIX)} from ({REP_SQL})""",
)
def build_dialogs(spark, sf):
    return turns(label.build_dialogs(rep(spark, sf, random=False), SYSTEM, USER, SUFFIX), "clust_id")


def stub_labels_sql(rep_sql_text: str) -> str:
    """What the stand-in labeller quotes: the most frequent longer words of the text."""
    return f"""select s.clust_id, s.rep_text, s.n_rows, coalesce(l.label, '') as label
      from ({rep_sql_text}) s left join (
        select clust_id, string_agg(word, ' ' order by r) as label from (
          select clust_id, word, row_number() over (partition by clust_id order by count(*) desc, word) as r
          from (select clust_id, unnest(regexp_extract_all(lower(rep_text), '\\p{{L}}{{{STUB_MIN_LETTERS},}}')) as word
                from ({rep_sql_text})) group by clust_id, word)
        where r <= {STUB_WORDS} group by clust_id) l using (clust_id)"""


LABELS_SQL = stub_labels_sql(REP_SQL)
TABLE_SQL = f"""select clust_id as "Cluster", {strip_sql('rep_text')} as "Text", label as "Label",
    n_rows as "Cluster Count" from ({LABELS_SQL})"""


def answered(spark, sf, questions=()) -> DataFrame:
    opening = label.build_dialogs(rep(spark, sf, random=False), SYSTEM, USER, SUFFIX)
    return label.answer_dialogs(opening, top_words_labeller(USER, SUFFIX), questions)


def labels(spark, sf, label_col: str = "Label", questions=()) -> DataFrame:
    return label.label_table(answered(spark, sf, questions), label_col)


@query("label_plain", f"""select clust_id, 'Label: "' || label || '"' as answer from ({LABELS_SQL})""")
def label_plain(spark, sf):
    return answered(spark, sf).select("clust_id", "answer")


@query("label_cove", f"""select clust_id, label from ({LABELS_SQL})""")
def label_cove(spark, sf):
    rows = answered(spark, sf, prompts.QUESTION_CHAINS[0])
    return rows.select("clust_id", X.extract_label(F.col("answer")).alias("label"))


def chain_sql(chain: int) -> str:
    """Turns and roles of a dialogue: opening, answer, then question and answer."""
    n = 3 + 2 * len(prompts.QUESTION_CHAINS[chain])
    return f"""select clust_id, {chain} as chain, i::int as turn, case when i = 0 then 'system'
        when i % 2 = 1 then 'user' else 'assistant' end as role
        from (select distinct clust_id from ({CLUSTERED})), unnest(range(0, {n})) t(i)"""


@query("cove_dialog_shape", f"{chain_sql(0)} union all {chain_sql(1)}")
def cove_dialog_shape(spark, sf):
    parts = [
        turns(answered(spark, sf, questions), "clust_id").select("clust_id", F.lit(i).alias("chain"), "turn", "role")
        for i, questions in enumerate(prompts.QUESTION_CHAINS)
    ]
    return parts[0].union(parts[1])


@query("label_table", TABLE_SQL)
def label_table(spark, sf):
    return labels(spark, sf)


@query("write_labels", TABLE_SQL)
def write_labels(spark, sf):
    path = new_path(spark, "labels") + ".csv"
    sinks.write_table(labels(spark, sf), path)
    return src.read_table(spark, path, labels_schema("Label"), missing=())


@query(
    "attach_labels",
    f"""select c.doc_id, c.clust_id, l.label as "Label" from ({CLUSTERED}) c
        left join ({LABELS_SQL}) l on l.clust_id = c.clust_id""",
)
def attach_labels(spark, sf):
    rows = label.attach_labels(clustered(spark, sf), labels(spark, sf), "Label")
    return rows.select("doc_id", "clust_id", "Label")


@query(
    "enrich_twice",
    f"""select c.doc_id, c.clust_id, c.text, l.label as "CoVe_Q1", l.label as "CoVe_Q2"
        from ({CLUSTERED}) c left join ({LABELS_SQL}) l on l.clust_id = c.clust_id""",
)
def enrich_twice(spark, sf):
    path = new_path(spark, "clustered") + ".parquet"
    rows = clustered(spark, sf).select("doc_id", "clust_id", "text")
    for i, chain in enumerate(prompts.QUESTION_CHAINS, start=1):
        name = f"CoVe_Q{i}"
        sinks.write_table(label.attach_labels(rows, labels(spark, sf, name, chain), name), f"{path}.{i}.parquet")
        rows = src.read_table(spark, f"{path}.{i}.parquet")
    return rows


# Review and critique.

RANDOM_SQL = f"select h.clust_id, h.rank, c.text from ({HALF_SQL}) h join ({CLUSTERED}) c using (doc_id)"


@query("random_text", RANDOM_SQL)
def random_text(spark, sf):
    return review.random_text(clustered(spark, sf))


@query(
    "review_table",
    f"""select l."Cluster", l."Text" as "Rep Text", t.n as "Random Texts",
        l."Label" as "CoVe_Q1_Label", l."Label" as "CoVe_Q2_Label"
        from ({TABLE_SQL}) l join (select clust_id, count(*) as n from ({RANDOM_SQL}) group by 1) t
          on t.clust_id = l."Cluster" where l."Cluster" <> -1""",
)
def review_table(spark, sf):
    texts = settle(rep(spark, sf, random=False), "rep_text")  # made once, asked twice
    tables = []
    for name, chain in zip(("CoVe_Q1", "CoVe_Q2"), prompts.QUESTION_CHAINS):
        opening = label.build_dialogs(texts, SYSTEM, USER, SUFFIX)
        answers = label.answer_dialogs(opening, top_words_labeller(USER, SUFFIX), chain)
        path = new_path(spark, "labels") + ".csv"
        sinks.write_table(label.label_table(answers, name), path)
        tables.append(src.read_table(spark, path, labels_schema(name), missing=()))
    out = new_path(spark, "review") + ".csv"
    rows = review.review_table(clustered(spark, sf), *tables)
    sinks.write_table(rows, out)
    return src.read_table(spark, out, rows.schema, missing=())


CRITIQUE_TURNS = f"""select "Cluster", 'This text was used to label a cluster: "' || "Text" || '"' as txt,
    'Label: "' || "Label" || '"' as lbl from ({TABLE_SQL})"""


@query(
    "examine_dialogs",
    f"""with t as ({CRITIQUE_TURNS})
        select "Cluster", 0 as turn, 'user' as role, txt as content from t
        union all select "Cluster", 1, 'assistant', lbl from t
        union all select "Cluster", 2, 'user', {quoted(prompts.CRITERIA)} from t""",
)
def examine_dialogs(spark, sf):
    return turns(label.critique_dialogs(labels(spark, sf), "Label", prompts.CRITERIA), "Cluster")


@query(
    "examine_labels",
    f"""select "Cluster", 'text ' || length(txt) || ', label ' || length(lbl) as critique
        from ({CRITIQUE_TURNS})""",
)
def examine_labels(spark, sf):
    path = new_path(spark, "labels") + ".csv"
    sinks.write_table(labels(spark, sf), path)
    stored = src.read_table(spark, path, labels_schema("Label"), missing=())
    rows = label.examine_labels(stored, "Label", length_critic, prompts.CRITERIA)
    return rows.select("Cluster", "critique")


# Stage two: prompts by id, budget from the prompts' own tokens, both outputs.


STAGE_CONTENT = stages.count_tokens(USER + SUFFIX) + stages.count_tokens(SYSTEM)
STAGE_LABELS = stub_labels_sql(rep_sql(LONGEST_SQL, STAGE_CONTENT))


@query(
    "stage_two",
    f"""select c.doc_id, c.clust_id, length({strip_sql('c.text')})::int as length,
        ({tokens_sql('c.text')})::int as num_tokens, l.label as "CoVe_Q1", f.format_text
        from ({CLUSTERED}) c join ({STAGE_LABELS}) l using (clust_id)
        join ({format_sql('select doc_id, text from documents')}) f using (doc_id)""",
)
def stage_two(spark, sf):
    result = stages.stage_two(
        clustered(spark, sf),
        top_words_labeller(USER, SUFFIX),
        max_seq_len=MAX_SEQ_LEN,
        cove_id=0,
        label_col="CoVe_Q1",
    )
    return result.rows.select("doc_id", "clust_id", "length", "num_tokens", "CoVe_Q1", "format_text")
