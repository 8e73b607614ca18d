"""Labelling, stage two, review and critique."""

import uuid

import pytest
from pyspark.sql import functions as F

from textloom.functions import prompts
from textloom.functions.models import length_critic, letter_pair_tokenizer, top_words_labeller
from textloom.operators import label, review
from textloom.plans import stages
from textloom.sources import sinks
from textloom.sources.posts import read_table


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"apple banana number {i}" if i % 2 else f"river stone number {i}", i % 2) for i in range(30)]
    return spark.createDataFrame(data + [(99, None, 0)], "doc_id long, text string, clust_id int").cache()


def counting_labeller():
    """Answers with the number of turns it was shown."""
    return lambda dialogs: [f'Label: "{len(d)}"' for d in dialogs]


@pytest.mark.parametrize("cove_id, turns", [(None, "2"), (0, "12"), (1, "10")])
def test_stage_two_asks_the_whole_chain(rows, cove_id, turns):
    got = stages.stage_two(rows, counting_labeller, max_seq_len=4000, cove_id=cove_id, label_col="L")
    assert {r.L for r in got.labels.collect()} == {turns}
    out = got.rows.collect()
    assert len(out) == 30  # the row without a text is left out
    assert all(r.format_text.startswith("<br /> ") and r.L == turns for r in out)
    assert {"length", "num_tokens", "L", "format_text"} <= set(got.rows.columns)


def test_no_noise_cluster_loses_no_cluster(rows):
    labels = stages.stage_two(rows, counting_labeller, max_seq_len=4000).labels.orderBy("Cluster").collect()
    assert [(r.Cluster, r["Cluster Count"]) for r in labels] == [(0, 15), (1, 15)]


def test_stub_names_the_words_of_its_cluster(rows):
    stub = top_words_labeller(prompts.USER_PROMPTS[0], prompts.SUFFIX)
    got = {r.Cluster: r.Label for r in stages.stage_two(rows, stub, max_seq_len=4000).labels.collect()}
    assert got == {0: "number river stone", 1: "apple banana number"}


def logging_labeller(folder, fails_at=None):
    """Writes a line for each dialogue it answers; fails once the dialogue has that many turns."""

    def factory():
        def model(dialogs, **options):
            if fails_at and len(dialogs[0]) == fails_at:
                raise RuntimeError("lost")
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("".join(f"{len(d)}\n" for d in dialogs))
            return [f'Label: "{len(d)} {options}"' for d in dialogs]

        return model

    return factory


def test_a_lost_chain_goes_on_after_its_last_answers(spark, tmp_path):
    calls, saved = tmp_path / "calls", str(tmp_path / "saved")
    calls.mkdir()
    dialogs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(9)], "clust_id int, rep_text string")
    opening = label.build_dialogs(dialogs, "system", "user ", " suffix")
    questions = ["why?", "sure?", "again?"]

    def made():
        return sorted(int(n) for f in calls.iterdir() for n in f.read_text().split())

    with pytest.raises(Exception, match="lost"):
        label.answer_saved(opening, logging_labeller(calls, fails_at=6), questions, saved, waves=2)
    assert made() == [2] * 7 + [4] * 7  # equal dialogues are asked once
    got = label.answer_saved(opening, logging_labeller(calls), questions, saved, waves=2)
    plain = label.answer_dialogs(opening, logging_labeller(tmp_path / "calls"), questions)
    rows = [(r.clust_id, r.rep_text, r.answer, [t.content for t in r.dialog]) for r in got.orderBy("clust_id").collect()]
    assert made() == [2] * 7 + [4] * 7 + [6] * 7 + [8] * 7
    assert rows == [(r.clust_id, r.rep_text, r.answer, [t.content for t in r.dialog]) for r in plain.orderBy("clust_id").collect()]
    before = len(made())
    label.answer_saved(opening, logging_labeller(calls), questions, saved).collect()
    assert len(made()) == before
    warm = label.answer_saved(opening, logging_labeller(calls), [], saved, options={"t": 1}).first()
    assert len(made()) == before + 7 and "'t': 1" in warm.answer


def test_stage_two_with_saved_answers(rows, tmp_path):
    for _ in range(2):
        got = stages.stage_two(rows, counting_labeller, max_seq_len=4000, cove_id=0, label_col="L", saved_in=str(tmp_path))
        assert {r.L for r in got.labels.collect()} == {"12"}


def test_random_texts_in_one_column(spark, rows):
    tables = [spark.createDataFrame([(c, f"t{c}", f"l{c}") for c in (0, 0, 1)], f"Cluster int, Text string, {n} string") for n in ("CoVe_Q1", "CoVe_Q2")]
    got = {r.Cluster: r for r in review.review_table(rows, *tables, random_texts=3).collect()}
    assert got[0]["Random Texts"] == 8 and got[0]["Random Text"].count("river stone") == 3
    picked = {r.text for r in review.random_text(rows).where("clust_id = 1 and rank <= 3").collect()}
    assert all(t in got[1]["Random Text"] for t in picked)


def test_prompts_come_from_the_table(spark, rows):
    table = prompts.prompt_table(spark).withColumn(
        "content", F.when(F.col("kind") == "user", F.concat(F.lit("Hi. "), "content")).otherwise(F.col("content"))
    )
    [[user]] = label.lookup_prompts(table, [("user", 1)])
    assert user.startswith("Hi. ")
    with pytest.raises(ValueError):
        stages.stage_two(rows, counting_labeller, user_id=7, prompt_table=table)
    assert [len(c) for c in label.lookup_prompts(table, [("question", 0), ("question", 1)])] == [5, 4]


def test_a_failing_model_fails_the_job(rows):
    def broken():
        def model(dialogs):
            raise RuntimeError("no model")

        return model

    with pytest.raises(Exception, match="no model"):
        stages.stage_two(rows, broken, max_seq_len=4000)


def test_unmapped_cluster_gets_null(spark, rows):
    one = spark.createDataFrame([(1, "one")], "Cluster int, L string")
    got = label.attach_labels(rows, one, "L").groupBy("clust_id").agg(F.max("L").alias("L")).collect()
    assert {r.clust_id: r.L for r in got} == {0: None, 1: "one"}


def labels(spark, name, clusters):
    data = [(c, f"text {c}", f"{name}{c}", 1) for c in clusters]
    return spark.createDataFrame(data, f"Cluster int, Text string, {name} string, `Cluster Count` long")


def test_review(spark, rows):
    noisy = rows.withColumn("clust_id", F.col("clust_id") - 1)
    one, two = labels(spark, "CoVe_Q1", [-1, 0]), labels(spark, "CoVe_Q2", [-1, 0])
    [row] = review.review_table(noisy, one, two).collect()
    assert (row.Cluster, row["Rep Text"], row.CoVe_Q1_Label, row.CoVe_Q2_Label) == (0, "text 0", "CoVe_Q10", "CoVe_Q20")
    assert row["Random Texts"] == 8
    assert review.review_table(noisy, one, two, skip="first").count() == 1
    with pytest.raises(ValueError):
        review.review_table(noisy, one, labels(spark, "CoVe_Q2", [-1]))


def test_review_of_a_big_cluster_is_one_row(spark, tmp_path):
    big = spark.range(2501).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(0).alias("clust_id"))
    one, two = labels(spark, "CoVe_Q1", [0]), labels(spark, "CoVe_Q2", [0])
    table = review.review_table(big, one, two)
    path = str(tmp_path / "review.csv")
    sinks.write_table(table, path)
    [row] = read_table(spark, path, table.schema, missing=()).collect()
    assert row["Random Texts"] == review.random_text(big).count()
    ranks = [r["rank"] for r in review.random_text(big).collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_texts_survive_the_writers(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "NA"), (4, "null"), (5, 'a "b"\nc,'), (6, " x ")]
    df = spark.createDataFrame(texts, "id int, text string")
    for name in ("t.csv", "t.parquet"):
        path = str(tmp_path / name)
        sinks.write_table(df, path)
        assert sorted(tuple(r) for r in read_table(spark, path, df.schema, missing=()).collect()) == texts
    kept = read_table(spark, str(tmp_path / "t.parquet"))
    assert sorted(tuple(r) for r in kept.collect()) == texts


def test_calls_are_batched_and_get_options(spark, rows):
    def model():
        return lambda dialogs, limit: [f'Label: "{len(dialogs)} {limit}"' for _ in dialogs]

    got = stages.stage_two(rows, model, max_seq_len=4000, batch_size=1, options={"limit": 9}).labels.collect()
    assert {r.Label for r in got} == {"1 9"}


def test_stage_two_with_a_tokenizer(rows):
    got = stages.stage_two(rows, counting_labeller, max_seq_len=9000, tokenizer=letter_pair_tokenizer).rows.collect()
    assert all(r.num_tokens == (len(r.text) + 1) // 2 for r in got)


def test_critique(spark):
    table = labels(spark, "L", [0, 1])
    got = label.examine_labels(table, "L", length_critic, prompts.CRITERIA).collect()
    assert len(got) == 2
    for r in got:
        assert [t.role for t in r.dialog] == ["user", "assistant", "user", "assistant"]
        assert r.dialog[-1].content == r.critique


def test_clusters_come_to_the_texts(spark, tmp_path):
    """The texts of CLUSTERED are not shuffled, even where Catalyst would not broadcast; the rows are the SQL's."""
    from textloom.plans import fixtures as fx

    docs = spark.range(0, 300, 1, 16).selectExpr("id as doc_id", "'a b' as text", "'s' as source", "'en' as lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 70, 1, 16).selectExpr("id as vec_id", "cast(id % 5 as int) as label", "array(1.0f) as embedding").write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fx.clustered(spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        want = fx.in_spark(spark, str(tmp_path), fx.CLUSTERED)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
