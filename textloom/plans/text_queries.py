"""Queries for sources, cleaning, language, tokens and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.models import letter_encoder, letter_pair_tokenizer
from ..operators import clean, embed, label, rep_text
from ..operators.aggregate import ordered_words, top_words, word_counts
from ..operators.language import (
    CODE_BITS,
    WEIGHT_SCALE,
    detect_languages,
    language_detector,
    language_profile,
)
from ..schemas import POSTS as POSTS_SCHEMA
from ..sources import posts as src
from ..sources import sinks
from ..sources.scratch import new_path
from . import fixtures as fx
from .registry import query

POSTS = fx.for_duckdb(fx.POSTS)
RAW_POSTS = fx.for_duckdb(fx.RAW_POSTS)
CLUSTERED = fx.for_duckdb(fx.CLUSTERED)

NA_LIST = ", ".join(f"'{s}'" for s in P.NA_STRINGS)


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.in_spark(spark, sf, fx.POSTS)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents")


def sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def words_of(text: str) -> str:
    return f"regexp_extract_all({text}, '{P.NON_SPACES}')"


def strip_sql(text: str) -> str:
    return sub(text, f"^{P.SPACES}|{P.SPACES}$", "")


def clean_sql(text: str, emoji: str = P.EMOJI_WIDE) -> str:
    no_url = f"coalesce({sub(text, P.URL, '')}, '')"
    return f"trim({sub(sub(no_url, emoji, ''), P.SPACES, ' ')})"


def slug_sql(url: str) -> str:
    parts = f"list_filter(string_split({url}, '/'), lambda s: s <> '' and not regexp_matches(s, '^[0-9]'))"
    return f"replace({parts}[-1], '-', ' ')"


def url_sql(text: str) -> str:
    return f"nullif(regexp_extract({text}, '{P.URL}'), '')"


def tokens_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{P.TOKEN}')) + 2"


# Sources and sinks.


def raw_posts_file(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "posts") + ".csv"
    sinks.write_table(fx.in_spark(spark, sf, fx.RAW_POSTS), path)
    return path


NA_TO_NULL = f"case when text not in ({NA_LIST}) then text end"


@query("read_posts", f"select doc_id, {NA_TO_NULL} as text from ({RAW_POSTS})")
def read_posts(spark, sf):
    return src.read_table(spark, raw_posts_file(spark, sf), POSTS_SCHEMA)


@query("read_posts_dropna", f"select doc_id, text from ({RAW_POSTS}) where text not in ({NA_LIST})")
def read_posts_dropna(spark, sf):
    return src.read_table(spark, raw_posts_file(spark, sf), POSTS_SCHEMA, drop_missing="text")


@query(
    "write_clustered",
    f"""select p.doc_id, trim({sub('p.text', P.SPACES, ' ')}) as text, c.clust_id,
        {sub('p.text', P.URL, '')} as text_no_urls, {slug_sql(url_sql('p.text'))} as extracted_urls
        from ({POSTS}) p join ({CLUSTERED}) c on c.doc_id = p.doc_id""",
)
def write_clustered(spark, sf):
    clusters = fx.in_spark(spark, sf, fx.CLUSTERED).select("doc_id", "clust_id")
    rows = posts(spark, sf).join(clusters, "doc_id")
    rows = clean.add_extracted_urls(clean.add_text_no_urls(rows))
    path = new_path(spark, "clustered") + ".parquet"
    sinks.write_clustered(rows, path)
    return spark.read.parquet(path)


@query(
    "stopword_table",
    f"select distinct unnest({words_of('text')}) as word from benchmark",
)
def stopword_table(spark, sf):
    path = new_path(spark, "stopwords")
    spark.read.parquet(f"{sf}/benchmark.parquet").select("text").write.text(path)
    return src.read_stopwords(spark, path)


# Text expressions over the whole posts table.


@query("remove_url", f"select doc_id, coalesce({sub('text', P.URL, '')}, '') as text from ({POSTS})")
def remove_url(spark, sf):
    return posts(spark, sf).select("doc_id", X.remove_url(F.col("text")).alias("text"))


@query("text_no_urls", f"select doc_id, {sub('text', P.URL, '')} as text_no_urls from ({POSTS})")
def text_no_urls(spark, sf):
    return clean.add_text_no_urls(posts(spark, sf)).select("doc_id", "text_no_urls")


@query("extract_url", f"select doc_id, {url_sql('text')} as url from ({POSTS})")
def extract_url(spark, sf):
    return posts(spark, sf).select("doc_id", X.extract_url(F.col("text")).alias("url"))


@query("url_slug", f"select page_id, {slug_sql('url')} as slug from pages")
def url_slug(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", X.url_slug(F.col("url")).alias("slug"))


@query("extracted_urls", f"select doc_id, {slug_sql(url_sql('text'))} as extracted_urls from ({POSTS})")
def extracted_urls(spark, sf):
    return clean.add_extracted_urls(posts(spark, sf)).select("doc_id", "extracted_urls")


@query("word_count", f"select doc_id, len({words_of('text')})::int as length from ({POSTS})")
def word_count(spark, sf):
    return clean.add_length(posts(spark, sf)).select("doc_id", "length")


@query("removed_flag", f"select doc_id, text in ('[removed]', '[deleted]') as reddit_removed from ({POSTS})")
def removed_flag(spark, sf):
    return clean.add_removed(posts(spark, sf)).select("doc_id", "reddit_removed")


@query("remove_emoji", f"select doc_id, {sub('text', P.EMOJI_WIDE, '')} as text from ({POSTS})")
def remove_emoji(spark, sf):
    return posts(spark, sf).select("doc_id", X.remove_emoji(F.col("text")).alias("text"))


@query("remove_emoji_narrow", f"select doc_id, {sub('text', P.EMOJI_NARROW, '')} as text from ({POSTS})")
def remove_emoji_narrow(spark, sf):
    return posts(spark, sf).select("doc_id", X.remove_emoji(F.col("text"), narrow=True).alias("text"))


@query("normalize_ws", f"select doc_id, trim({sub('text', P.SPACES, ' ')}) as text from ({POSTS})")
def normalize_ws(spark, sf):
    return posts(spark, sf).select("doc_id", X.normalize_spaces(F.col("text")).alias("text"))


LANG_LIST = ", ".join(f"'{s}'" for s in P.ACCEPTED_LANGUAGES)


@query("lang_check", f"select doc_id, coalesce(lang in ({LANG_LIST}), false) as lang_check from documents")
def lang_check(spark, sf):
    return documents(spark, sf).select("doc_id", X.is_accepted_language(F.col("lang")).alias("lang_check"))


@query(
    "parse_vector",
    """select vec_id, (i - 1)::int as pos, embedding[i]::double as value
       from embeddings, unnest(range(1, len(embedding) + 1)) t(i)""",
)
def parse_vector(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    doubles = F.col("embedding").cast("array<double>").cast("array<string>")
    stored = F.concat(F.lit("["), F.array_join(doubles, ", "), F.lit("]"))
    return vectors.select("vec_id", F.posexplode(X.parse_vector(stored)).alias("pos", "value"))


@query("decode_text", "select doc_id, text from documents")
def decode_text(spark, sf):
    stray = F.concat(F.unhex(F.lit("C3")), F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    return documents(spark, sf).select("doc_id", X.decode_text(stray).alias("text"))


@query("char_length", f"select doc_id, length({strip_sql('text')})::int as length from ({POSTS})")
def char_length(spark, sf):
    return posts(spark, sf).select("doc_id", X.char_length(F.col("text")).alias("length"))


@query("token_count", f"select doc_id, ({tokens_sql('text')})::int as num_tokens from ({POSTS})")
def token_count(spark, sf):
    return posts(spark, sf).select("doc_id", X.token_count(F.col("text")).alias("num_tokens"))


# Answers in every form: quoted, empty, unquoted, without a colon.
ANSWERS = """select conv_id, turn, case turn % 4
    when 0 then concat('Here it is.\n Label: "', text, '".') when 1 then concat('Label: ', text)
    when 2 then replace(text, ': ', ' ') else concat('Label: "" ', text) end as answer
    from {conversations}"""
LABEL_SQL = f"""case when not regexp_matches(answer, '{P.LABEL}') then answer
    when regexp_matches(regexp_extract(answer, '{P.LABEL}'), '{P.LABEL_QUOTED}')
    then regexp_extract(answer, '{P.LABEL}', 1) end"""


@query("extract_label", f"select conv_id, turn, {LABEL_SQL} as label from ({fx.for_duckdb(ANSWERS)})")
def extract_label(spark, sf):
    answers = fx.in_spark(spark, sf, ANSWERS.replace("\n Label", "\\n Label"))
    return answers.select("conv_id", "turn", X.extract_label(F.col("answer")).alias("label"))


def format_sql(table: str) -> str:
    """The HTML wrap of each text of a table (doc_id, text) in which no text is blank."""
    return f"""
with words as (select doc_id, {words_of('text')} as w from ({table})),
placed as (
  select doc_id, unnest(w) as word, unnest(range(0, len(w))) as i, ceil(len(w) / 20.0) as runs
  from words)
select doc_id, string_agg(case when i % 19 = 0 and i // 19 < runs then '<br /> ' else '' end || word,
                          ' ' order by i) as format_text
from placed group by doc_id"""


@query("format_text", format_sql(POSTS))
def format_text(spark, sf):
    return label.add_format_text(posts(spark, sf)).select("doc_id", "format_text")


STOPWORDS = f"(select distinct unnest({words_of('text')}) as word from benchmark)"
WORDS_SQL = f"""select doc_id, lower(word) as word, count(*) as n from (
    select doc_id, unnest({words_of('text')}) as word from ({POSTS}))
    where regexp_matches(word, '{P.LETTERS_ONLY}') and word not in (select word from {STOPWORDS})
    group by all"""


def benchmark_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all("text", F.lit(P.NON_SPACES), F.lit(0)))
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(words.alias("word")).distinct()


@query("word_list", WORDS_SQL)
def word_list(spark, sf):
    return word_counts(posts(spark, sf), benchmark_stopwords(spark, sf), by="doc_id")


@query(
    "word_list_ordered",
    f"""select doc_id, pos::int as pos, lower(word) as word from (
        select doc_id, i - 1 as pos, w[i] as word from (
          select doc_id, {words_of('text')} as w from ({POSTS})), unnest(range(1, len(w) + 1)) t(i))
        where regexp_matches(word, '{P.LETTERS_ONLY}') and word not in (select word from {STOPWORDS})""",
)
def word_list_ordered(spark, sf):
    return ordered_words(posts(spark, sf), benchmark_stopwords(spark, sf))


@query(
    "top_words",
    f"""select clust_id, word, n, rank::int as rank from (
        select *, row_number() over (partition by clust_id order by n desc, word) as rank from (
        select clust_id, word, sum(n)::bigint as n from ({WORDS_SQL}) join ({CLUSTERED}) c using (doc_id)
        group by all)) where rank <= 10""",
)
def top_words_query(spark, sf):
    clusters = fx.in_spark(spark, sf, fx.CLUSTERED).select("doc_id", "clust_id")
    rows = posts(spark, sf).join(clusters, "doc_id")
    return top_words(rows, benchmark_stopwords(spark, sf))


# Language.


def letters_sql(text: str) -> str:
    return f"concat(' ', trim({sub(f'lower({text})', P.NON_LETTERS, ' ')}), ' ')"


def grams_sql(letters: str) -> str:
    shifted = [f"regexp_extract_all(substr({letters}, {i}), '...')" for i in (1, 2, 3)]
    return f"unnest(list_concat({', '.join(shifted)}))"


def code_sql(gram: str) -> str:
    """The three characters as one number."""
    c = [f"unicode(substr({gram}, {i}, 1))::bigint" for i in (1, 2, 3)]
    return f"({c[0]} * {1 << 2 * CODE_BITS} + {c[1]} * {1 << CODE_BITS} + {c[2]})"


PROFILE_SQL = f"""
with counts as (
  select lang, {code_sql('gram')} as gram, sum(n) as n from (
    select lang, gram, count(*) as n from (
      select lang, {grams_sql('letters')} as gram
      from (select lang, {letters_sql('text')} as letters from documents))
    group by all)
  group by all),
totals as (select lang, sum(n) as total from counts group by lang),
grams as (select distinct gram from counts)
select t.lang, g.gram,
  round(ln((coalesce(k.n, 0) + 1.0) / (t.total + (select count(*) from grams)))
        * {WEIGHT_SCALE})::bigint as weight
from totals t cross join grams g left join counts k on k.lang = t.lang and k.gram = g.gram
"""


def detect_sql(table: str) -> str:
    """Language of each row of a table (doc_id, text)."""
    han, kana, hangul, cyrillic = (
        r"\p{Han}", r"[\p{Hiragana}\p{Katakana}]", r"\p{Hangul}", r"\p{Cyrillic}",
    )
    n_letters = r"len(regexp_extract_all(text, '\p{L}'))"

    def mostly(script: str) -> str:
        return f"len(regexp_extract_all(text, '{script}')) * 2 > {n_letters}"

    return f"""
    select d.doc_id, case when {n_letters} = 0 then 'error'
        when regexp_matches(text, '{kana}') then 'ja' when {mostly(hangul)} then 'ko'
        when {mostly(han)} then 'zh' when {mostly(cyrillic)} then 'ru'
        else coalesce(b.lang, 'error') end as lang
    from ({table}) d left join (
      select doc_id, lang from (
        select doc_id, lang, row_number() over (partition by doc_id order by score desc, lang) as r
        from (select doc_id, p.lang, sum(p.weight * g.n) as score
              from (select doc_id, {code_sql('gram')} as gram, count(*) as n from (
                      select doc_id, {grams_sql('letters')} as gram
                      from (select doc_id, {letters_sql('text')} as letters from ({table})))
                    group by all) g
              join ({PROFILE_SQL}) p on p.gram = g.gram group by all))
      where r = 1) b on b.doc_id = d.doc_id"""


def detector(spark: SparkSession, sf: str):
    return language_detector(language_profile(documents(spark, sf)))


@query("lang_profiles", PROFILE_SQL)
def lang_profiles(spark, sf):
    return language_profile(documents(spark, sf))


@query("detect_language", detect_sql("select doc_id, text from documents"))
def detect_language(spark, sf):
    return detector(spark, sf).add(documents(spark, sf).select("doc_id", "text")).select("doc_id", "lang")


@query("detect_languages_joined", detect_sql("select doc_id, text from documents"))
def detect_languages_joined(spark, sf):
    # Few trigrams go to the workers, so that the others are joined.
    profile = language_profile(documents(spark, sf))
    return detect_languages(documents(spark, sf).select("doc_id", "text"), profile, most=500).select("doc_id", "lang")


CLEAN_POSTS_SQL = f"""
with tidy as (select doc_id, text, len({words_of('text')})::int as length from (
    select doc_id, {clean_sql('text')} as text from ({POSTS}))),
kept as (select * from tidy where length > 2 and text not in ('[removed]', '[deleted]')),
langs as ({detect_sql('select doc_id, text from kept')})
select doc_id, text, lang, length, true as lang_check, false as reddit_check
from kept join langs using (doc_id) where lang in ({LANG_LIST})
"""


@query("clean_posts", CLEAN_POSTS_SQL)
def clean_posts(spark, sf):
    return clean.clean_posts(posts(spark, sf), detector(spark, sf))


# Embeddings.

EMBED_SQL = f"""
with words as (
  select doc_id, unnest(regexp_extract_all(lower(text), '{P.WORD}')) as word from documents),
tf as (select doc_id, ('0x' || substr(md5(word), 1, 2))::int as pos, count(*) as tf from words group by all),
idf as (select pos, ln(((select count(*) from documents) + 1.0) / (count(*) + 1.0)) as idf from tf group by pos),
w as (select doc_id, pos, tf * idf as w from tf join idf using (pos))
select doc_id, pos, round((w / sqrt(sum(w * w) over (partition by doc_id)))::float::double, 5) as value
from w where w <> 0
"""


@query("embed_hashed", EMBED_SQL)
def embed_hashed(spark, sf):
    vectors = embed.embed_hashed(documents(spark, sf))
    return vectors.select("doc_id", F.posexplode("embeddings").alias("pos", "value")).where(
        "value <> 0"
    ).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query(
    "embed_plugin",
    """with letters as (
         select doc_id, ascii(c) - 97 as pos from (
           select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]')) as c from documents))
       select doc_id, pos::int as pos, round((count(*) / sum(count(*)) over (partition by doc_id))::float::double, 5) as value
       from letters group by doc_id, pos""",
)
def embed_plugin(spark, sf):
    vectors = embed.embed_with(documents(spark, sf), letter_encoder)
    return vectors.select("doc_id", F.posexplode("embeddings").alias("pos", "value")).where(
        "value > 0"
    ).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query(
    "embed_stored",
    """select vec_id as doc_id, (i - 1)::int as pos, embedding[i]::float::double as value
       from embeddings, unnest(range(1, len(embedding) + 1)) t(i)""",
)
def embed_stored(spark, sf):
    text = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.to_json("embedding").alias("stored"))
    vectors = embed.stored_vectors(text, "stored")
    return vectors.select("doc_id", F.posexplode("embeddings").alias("pos", "value")).withColumn(
        "value", F.col("value").cast("float").cast("double")
    )


@query("token_count_plugin", f"select doc_id, ((length(text) + 1) // 2)::int as num_tokens from ({POSTS})")
def token_count_plugin(spark, sf):
    return rep_text.add_token_counts(posts(spark, sf), tokenizer=letter_pair_tokenizer).select("doc_id", "num_tokens")
