"""Hand-written cases of the text expressions."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.clean import clean_posts
from textloom.operators.language import language_detector, language_profile
from textloom.plans.stages import stage_one


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_urls(spark):
    texts = ["see http://a.b/c x https://d", "none", None]
    assert values(spark, texts, X.remove_url) == ["see  x ", "none", ""]
    assert values(spark, texts, X.extract_url) == ["http://a.b/c", None, None]


def test_url_slug(spark):
    urls = ["https://a.com/2020/01/foo-bar-baz/", "https://a.com/x/123", "http://9", "1/2", "", None]
    assert values(spark, urls, X.url_slug) == ["foo bar baz", "x", "http:", None, None, None]


def test_counts(spark):
    texts = ["a  b\tc", "", "   ", None, "a\u001cb　c"]
    assert values(spark, texts, X.word_count) == [3, 0, 0, 1, 3]
    assert values(spark, [" ab ", None], X.char_length) == [2, 3]
    assert values(spark, ["Hello, world 12345", ""], X.token_count) == [7, 2]
    tidy = ["a b c", "", "one"]
    assert values(spark, tidy, X.normalized_word_count) == values(spark, tidy, X.word_count)


def test_removed_is_exact(spark):
    texts = ["[removed]", "[deleted]", "[removed] x y", None]
    assert values(spark, texts, X.is_removed) == [True, True, False, False]


def test_emoji(spark):
    texts = ["a😀b", "🇩🇪x", "👩‍💻y", "日本語 かな 한국", "☃ snow"]
    assert values(spark, texts, X.remove_emoji) == ["ab", "x", "y", "  ", " snow"]
    narrow = values(spark, texts, lambda c: X.remove_emoji(c, narrow=True))
    assert narrow == ["ab", "x", "y", "日本語 かな 한국", " snow"]


def test_spaces(spark):
    assert values(spark, [" a \u001c b\n\nc "], X.normalize_spaces) == ["a b c"]


@pytest.mark.parametrize(
    "answer, label, fallback",
    [
        ('Label: "A b c".', "A b c", "A b c"),
        ('Label: ""', "", ""),
        ("Label: plain\nmore", None, "plain"),
        ("no colon", "no colon", "no colon"),
        ('x: "one" y: "two"', "one", "one"),
        ('a: b "c"\nLabel: "d"', None, 'b "c"'),
    ],
)
def test_extract_label(spark, answer, label, fallback):
    assert values(spark, [answer], X.extract_label) == [label]
    assert values(spark, [answer], lambda c: X.extract_label(c, fallback=True)) == [fallback]


def wrapped(words):
    """The definition: a mark goes in at each twentieth place of the growing list."""
    out = list(words)
    for place in range(0, len(words), 20):
        out.insert(place, "<br />")
    return " ".join(out)


def test_html_wrap(spark):
    sizes = [0, 1, 19, 20, 21, 38, 39, 40, 41, 100, 400]
    texts = [" ".join(f"w{i}" for i in range(n)) for n in sizes]
    assert values(spark, texts, X.html_wrap) == [wrapped(t.split()) for t in texts]


def test_word_list(spark):
    stop = F.array(F.lit("the"), F.lit("of"))
    got = values(spark, ["The end of x1 the Straße it's"], lambda c: X.word_list(c, stop))
    assert got == [["the", "end", "straße"]]


def test_vectors_and_bytes(spark):
    assert values(spark, ["[0.1, -2.0]"], X.parse_vector) == [[0.1, -2.0]]
    df = spark.createDataFrame([(bytearray(b"caf\xc3\xa9\xff!"),)], "b binary")
    assert df.select(X.decode_text(F.col("b"))).first()[0] == "café!"


def test_clean_posts(spark):
    rows = [
        (1, "one two three"), (2, "one two"), (3, "[removed]"), (4, None), (5, "[removed] x y"),
        (6, "https://a.b/c one two"), (7, " a b 😀 c "), (8, "日本語 かな 한국"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in clean_posts(df, lambda c: F.lit("en")).collect()}
    assert got == {1: "one two three", 5: "[removed] x y", 7: "a b c"}
    narrow = clean_posts(df, lambda c: F.lit("ja"), narrow_emoji=True)
    assert narrow.where("doc_id = 8").first().text == "日本語 かな 한국"
    assert clean_posts(df, lambda c: F.lit("xx")).count() == 0


def test_clean_posts_counts_all_trigrams_of_a_large_profile(spark):
    words = {"en": "the house stood near water", "de": "das haus stand nah am wasser", "fr": "la maison fut au bord", "es": "una casa junto al agua"}
    texts = [(lang, f"{w} {' '.join(chr(97 + (i * 7 + j) % 26) * 3 for j in range(3))}") for lang, w in words.items() for i in range(6)]
    profile = language_profile(spark.createDataFrame(texts, "lang string, text string"))
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(100, "12 34 56"), (101, None), (102, "qq xx"), (103, "это русский текст")]
    rows += [(200 + i, w) for i, w in enumerate(words["de"].split())] + [(300, "wasser nah am")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(clean_posts(df, language_detector(profile)).collect())
    assert {r.lang for r in want} == {*words, "ru"} and len(want) == len(texts) + 2
    for most in (0, 20):
        few = language_detector(profile, most=most)
        assert sorted(clean_posts(df, few).collect()) == want
        with pytest.raises(ValueError):
            few(F.col("text"))


def test_stage_one_keeps_the_rows_of_a_large_profile(spark):
    texts = [(lang, f"{w} number {i}") for lang, w in (("en", "the water"), ("de", "das wasser")) for i in range(8)]
    profile = language_profile(spark.createDataFrame(texts, "lang string, text string"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = [stage_one(df, language_detector(profile, most=most)).rows for most in (10, 1 << 20)]
    few, whole = ([tuple(r) for r in rows.select("doc_id", "text", "lang", "clust_id").orderBy("doc_id").collect()] for rows in found)
    assert few == whole and len(few) == len(texts) and {r[2] for r in few} == {"en", "de"}


def test_clean_posts_runs_on_a_stream(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "one two three"), (2, "no")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = clean_posts(stream, lambda c: F.lit("en"))
    q = out.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.doc_id for r in spark.table("cleaned").collect()] == [1]


def test_blocks_are_bounded_by_bytes():
    """Python sees a bounded share of an Arrow batch at a time, whatever its rows."""
    import pyarrow as pa

    from textloom.functions.blocks import text_blocks

    texts = ["é" * 300, None, "", "x" * 5000, "y"] * 50
    blocks = list(text_blocks(iter([pa.array(texts), pa.array([], pa.string())]), 2000))
    assert [t for b in blocks for t in b] == [t or "" for t in texts]
    assert all(len(b) == 1 or sum(len(t.encode()) + 1 for t in b) <= 2000 for b in blocks)


def test_encoder_gets_bounded_lists(spark):
    """An encoder is never given a whole Arrow batch of long texts."""
    from textloom.operators import embed

    def sizes():
        return lambda texts: [[float(sum(map(len, texts)))] for _ in texts]

    rows = spark.range(40).selectExpr("id", "repeat('word ', 40000) as text").coalesce(1)
    got = embed.embed_with(rows, sizes).selectExpr("max(embeddings[0]) as m", "count(*) as n").first()
    assert got.n == 40 and got.m <= 1 << 20  # before: 8,000,000
