"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.alignment import alignment_digest
from textloom.llm.caps import link_vectors
from textloom.llm.chat import read_back, windows
from textloom.llm.decontam import contamination
from textloom.llm.jaccard import jaccard_components
from textloom.llm.packing import pack
from textloom.llm.page_text import extract
from textloom.llm.ppm import score_texts
from textloom.llm.quality import quality
from textloom.llm.secret_scan import secret_digest
from textloom.llm.token_counts import token_counts
from textloom.llm.toxicity import toxicity
from textloom.llm.whitening import whitened_vectors

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


JACCARD_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select distinct doc_id, hash(w[i + 1 : i + 5]) as g
  from (select doc_id, w, unnest(range(greatest(1, len(w) - 4))) as i from words where len(w) > 0)),
sizes as (select w.doc_id, count(s.doc_id) as n from words w left join sets s on s.doc_id = w.doc_id group by w.doc_id),
links as (
  select a, b
  from (select x.doc_id as a, y.doc_id as b, count(*) as shared from sets x join sets y on x.g = y.g and x.doc_id <> y.doc_id group by all)
  join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * shared >= 75 * (p.n + q.n - shared)),
reach as (select doc_id as a, doc_id as b from sizes union select r.a, l.b from reach r join links l on l.a = r.b)
select doc_id, n as n_shingles, (select min(b) from reach where a = doc_id) as component_id from sizes
"""


@query("op7_ngram_jaccard", JACCARD_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


CONTAMINATION_SQL = r"""
with texts as (
  select 0 as kind, doc_id as id, coalesce(text, '') as text from documents
  union all select 1, item_id, coalesce(text, '') from (select distinct item_id, text from benchmark)),
words as (
  select kind, id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts),
windows as (
  select id, w[i + 1 : i + least(13, len(w))] as g, least(13, len(w)) as n
  from (select id, w, unnest(range(greatest(1, len(w) - 12))) as i from words where kind = 1 and len(w) > 0)),
sizes as (select distinct n from windows),
places as (
  select id, i, n, w[i + 1 : i + n] as g
  from (select id, w, n, unnest(range(len(w) - n + 1)) as i from words, sizes where kind = 0 and len(w) >= n)),
found as (select p.id, p.i, p.n, q.id as item from places p join windows q on p.g = q.g),
hits as (select id, count(distinct place) as n_hit from (select id, unnest(range(i, i + n)) as place from found) group by id),
items as (
  select id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct id, cast(item as varchar) as item from found) group by id)
select w.id as doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words w left join hits h on h.id = w.id left join items i on i.id = w.id
where w.kind = 0
"""


@query("op9_decontamination", CONTAMINATION_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op10_ppm_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_page_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query("op3_chat_windows")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return read_back(windows(turns.union(planted), tokenizer=tokenizer_path()))


@query("op4_cap_filters")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_vectors(table(spark, sf_dir, "embeddings"))
