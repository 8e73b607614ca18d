import zlib

import numpy as np
from test_jaccard import plain_components
from test_packing import plain_ids
from test_scans import plain_contamination

import corpus_pipeline
from textloom.llm.secret_scan import redact
from textloom.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_run_is_the_stages_done_plainly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    toxic = {r["doc_id"] for r in toxicity(docs, labels).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    ones = {i for i, _, c in plain_components(rows) if i == c}
    rows = [r for r in rows if r[0] in ones]
    clean = {r[0] for r in plain_contamination(rows, items) if not r[-1]}
    expected = set()
    for i, t in rows:
        if i in clean:
            ids = np.array([*plain_ids(redact((t or "").encode()).decode()), 0], "<u4")
            expected |= {(i, k, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:5] for r in got} == expected and len(got) == len(expected)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
