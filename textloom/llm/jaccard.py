"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters.

A document's set is its distinct 5-word shingles. Two documents link when
``100 * |A and B| >= similarity * |A or B|``. Texts that are equal byte for byte are one
vertex, so copies are never paired with each other.

1. Shingles are ranked rare first: by their class in a frequency sketch of fixed size over
   all texts, then by hash. Any total order is right; this one keeps common passages out of
   prefixes.
2. Each distinct text posts its prefix shingles. A shingle that the sketch knows as
   frequent is salted, so that no task holds all of its posting.
3. Each posting links its members to one pivot of it (a star, linear in the posting).
   Pairs that pass the length, positional and suffix filters are verified on whole texts.
4. Then only pairs across the components are left to look at, as pairs inside one cannot
   change the result. While a posting has many of them, a few new pivots meet its members of
   other components, which is again linear and joins most of what can be joined. In the end
   all pairs across components that share a prefix shingle and pass the filters are verified,
   so no link that would join two components is lost.

Nulls, and texts without words: an empty set, linked with nothing, own component. A null
doc_id keeps its row; the component is the smallest id that is not null. Rows that repeat a
doc_id are all returned. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.arrays import Hasher, Words, shingle_sets, text_blocks
from textloom.llm.graph import components
from textloom.sources.scratch import settle

WIDTH = 5
SIMILARITY = 75
SKETCH_BITS = 21
SKETCH_BLOCK = 2 << 20  # shingles that are counted at a time for the sketch
SALT_ROWS = 256
SUFFIX_BINS = 512
PIVOTS = 8  # of a posting in each turn
PIVOT_TURNS = 4  # at most
PAIRS_PER_PLACE = 8  # left on average when all pairs across components are looked at
BROADCAST_ROWS = 1 << 20  # at most so many 8-byte keys are broadcast


def sketch_frequencies(texts: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Counts of frequent shingles by hash bucket: those met at least twice in one block of texts."""
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def flush() -> pa.RecordBatch:
            runs = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
            n = np.diff(np.append(at, len(runs)))
            often = n >= 2
            buckets, where = np.unique(runs[at[often]] & mask, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(buckets.astype(np.int64)), pa.array(np.bincount(where, n[often], len(buckets)).astype(np.int64))],
                ["bucket", "n"],
            )

        for _, rows in text_blocks(batches):
            words = Words(rows)
            sets = shingle_sets(words, hasher.words(words), width)
            held.extend(s for s in sets if len(s))
            size += sum(map(len, sets))
            if size >= SKETCH_BLOCK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    got = rows.toArrow()  # one row for each of the sketch's buckets at most
    sketch[got.column("bucket").to_numpy()] = np.minimum(got.column("n").to_numpy(), (1 << 32) - 1)
    return sketch


def _sets_table(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, vertex, n, bins): set size and, for the suffix filter, counts of shingles by hash range."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        shift = np.uint64(64 - SUFFIX_BINS.bit_length() + 1)
        for batch, rows in text_blocks(batches):
            words = Words(rows)
            sets = shingle_sets(words, hasher.words(words), width)
            bins = [np.bincount((s >> shift).astype(np.int64), minlength=SUFFIX_BINS).astype("<u4").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("vertex"), pa.array([len(s) for s in sets], pa.int64()), pa.array(bins, pa.binary())],
                ["doc_id", "vertex", "n", "bins"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(describe, f"doc_id {kind}, vertex long, n long, bins binary")


def _postings(texts: DataFrame, sketch: np.ndarray, width: int, similarity: int) -> DataFrame:
    """(token, salt, salts, vertex, n, pos) for the prefix shingles of each distinct text of a task."""
    frequencies = texts.sparkSession.sparkContext.broadcast(sketch)
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, sketch = Hasher(), set(), frequencies.value
        for batch, rows in text_blocks(batches):
            vertices = batch.column("vertex").to_numpy(zero_copy_only=False)
            fresh = []
            for i, v in enumerate(vertices.tolist()):
                if v not in seen:
                    seen.add(v)
                    fresh.append(i)
            if len(seen) > 1 << 18:
                seen.clear()
            words = Words([rows[i] for i in fresh])
            tokens, counts, sizes, places, owners = [], [], [], [], []
            for i, s in zip(fresh, shingle_sets(words, hasher.words(words), width)):
                n = len(s)
                if n:
                    often = sketch[(s & mask).astype(np.int64)]
                    length = n - -(-similarity * n // 100) + 1
                    levels = np.frexp(often.astype(np.float32))[1].astype(np.uint8)
                    first = np.argsort(levels, kind="stable")[:length]
                    tokens.append(s[first])
                    counts.append(often[first])
                    sizes.append(np.full(length, n))
                    places.append(np.arange(length))
                    owners.append(np.full(length, vertices[i]))
            if not tokens:
                continue
            owner = np.concatenate(owners)
            salts = 1 + np.concatenate(counts).astype(np.int64) // SALT_ROWS
            salt = (owner.astype(np.uint64) % salts.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens).view(np.int64)),
                    pa.array(salt.astype(np.int32)),
                    pa.array(salts > 1),
                    pa.array(owner),
                    pa.array(np.concatenate(sizes).astype(np.int32)),
                    pa.array(np.concatenate(places).astype(np.int32)),
                ],
                ["token", "salt", "salted", "vertex", "n", "pos"],
            )

    return texts.mapInArrow(post, "token long, salt int, salted boolean, vertex long, n int, pos int")


def _may_link(similarity: int, na, pa_, nb, pb):
    """Length filter, and the positional filter of a pair's first common shingle."""
    need = similarity * (na + nb)
    left = F.least(na - pa_, nb - pb)
    return (100 * F.least(na, nb) >= similarity * F.greatest(na, nb)) & ((100 + similarity) * left >= need)


def _suffix_filter(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose counts by hash range still allow the overlap that a link needs."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in text_blocks(batches, "bins_a"):
            x, y = (np.frombuffer(b"".join(b), "<u4").reshape(-1, SUFFIX_BINS) for b in (first, batch.column("bins_b").to_pylist()))
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            total = x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)
            ok = pa.array((100 + similarity) * most >= similarity * total)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(ok)

    bins = sets.where("n > 0").select("vertex", "bins").dropDuplicates(["vertex"])
    both = pairs.join(bins.toDF("a", "bins_a"), "a").join(bins.toDF("b", "bins_b"), "b")
    return both.mapInArrow(keep, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """The pairs that link, by whole sets; only texts of some pair are moved."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch, left in text_blocks(batches, "text_a"):
            sets = []
            for rows in (left, batch.column("text_b").to_pylist()):
                words = Words(rows)
                sets.append(shingle_sets(words, hasher.words(words), width))
            ok = []
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    needed = settle(pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct(), "needed")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    found = settle(texts.select("vertex", "text").join(needed, "vertex", "left_semi").dropDuplicates(["vertex"]), "found")
    both = pairs.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b")
    return both.mapInArrow(links, "a long, b long")


def _split_tokens(members: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of shingles that more than one component shares, and per shingle its size and pairs across."""
    known = members.drop("component").join(whole.withColumnRenamed("node", "vertex"), "vertex", "left")
    known = settle(known.withColumn("component", F.coalesce("component", "vertex")), "members")
    each = known.groupBy("token", "component").agg(F.count("*").alias("m"))
    sizes = each.groupBy("token").agg(F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("inner"), F.count("*").alias("parts"))
    sizes = settle(sizes.where("parts > 1").withColumn("meetings", F.expr("(size * size - inner) / 2")), "sizes")
    return known.join(sizes.select("token"), "token", "left_semi"), sizes


def _chosen(vertex, size):
    """Some PIVOTS members of a posting, mostly the same ones in postings of about the same members."""
    return F.pmod(F.xxhash64(vertex), F.lit(1 << 20)) * size < PIVOTS << 20


def _vertex(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _rows(docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """(doc_id, vertex, n, component) for every row of ``docs``; the component is one of its vertices."""
    texts = docs.select(
        "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), _vertex().alias("vertex")
    )
    sketch = sketch_frequencies(texts.select("text"), width)
    sets = settle(_sets_table(texts, width), "sets")

    entry = F.struct("vertex", "n", "pos")
    group = Window.partitionBy("token", "salt").orderBy("vertex")
    shared = (
        _postings(texts.select("text", "vertex"), sketch, width, similarity)
        .withColumn("pivot", F.first(entry).over(group))
        .withColumn("alone", F.lag("vertex").over(group).isNull() & F.lead("vertex").over(group).isNull())
        .where("salted or not alone")
    )
    shared = settle(shared.drop("salt", "alone"), "postings")

    here, there = [F.col(c) for c in ("n", "pos")], [F.col(f"pivot.{c}") for c in ("n", "pos")]
    stars = shared.where("pivot.vertex <> vertex").where(_may_link(similarity, *here, *there))
    stars = stars.select(F.col("pivot.vertex").alias("a"), F.col("vertex").alias("b"))
    heads = shared.where("salted and pivot.vertex = vertex").select("token", "vertex", "n", "pos")
    tops = heads.groupBy("token").agg(F.min(entry).alias("pivot"))
    upper = heads.join(tops, "token").where("pivot.vertex <> vertex").where(_may_link(similarity, *here, *there))
    stars = stars.union(upper.select(F.col("pivot.vertex").alias("a"), F.col("vertex").alias("b"))).distinct()
    stars = settle(_suffix_filter(stars, sets, similarity), "stars")
    first = settle(_verify(stars, texts, width, similarity), "links")
    links, tried = first, stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = shared.select("token", "vertex", "n", "pos").distinct()
    turn, stuck = 0, False
    while True:
        whole = components(links)
        members, sizes = _split_tokens(members, whole)
        heavy = sizes.where(F.col("meetings") > PAIRS_PER_PLACE * F.col("size"))
        last = stuck or turn == PIVOT_TURNS or heavy.isEmpty()
        x, y = members.alias("x"), members.alias("y")
        if not last:
            x = members.join(heavy.select("token", "size"), "token")
            x = x.where(_chosen(F.col("vertex").bitwiseXOR(F.lit(turn)), F.col("size"))).alias("x")
        order = F.col("x.vertex") < F.col("y.vertex") if last else F.lit(True)
        across = x.join(
            y,
            (F.col("x.token") == F.col("y.token"))
            & order
            & (F.col("x.component") != F.col("y.component"))
            & _may_link(similarity, F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")),
        ).select(F.least("x.vertex", "y.vertex").alias("a"), F.greatest("x.vertex", "y.vertex").alias("b"))
        fresh = settle(across.distinct().join(tried, ["a", "b"], "left_anti"), "fresh")
        rest = settle(_suffix_filter(fresh, sets, similarity), "rest")
        found = settle(_verify(rest, texts, width, similarity), "links")
        links = links.union(found)
        if last:
            whole = components(links)
            break
        stuck = found.isEmpty()
        tried, turn = tried.union(fresh), turn + 1

    rows = sets.drop("bins").join(whole.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    return settle(rows, "rows")


def jaccard_components(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    rows = _rows(docs, width, similarity)
    lowest = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("lowest"))
    return rows.join(lowest, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each component, that with the smallest doc_id, and every row without words."""
    rows = _rows(docs, width, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "vertex")).alias("first")
    chosen = rows.where("n > 0").groupBy("component").agg(first).select("first.doc_id", "first.vertex")
    wordless = rows.where("n = 0").select("doc_id", "vertex").distinct()
    kept = settle(chosen.union(wordless).toDF("kept doc_id", "kept vertex"), "kept")
    if kept.count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    out = docs.join(kept, docs["doc_id"].eqNullSafe(F.col("kept doc_id")) & (_vertex() == F.col("kept vertex")), "left_semi")
    again = rows.where("n > 0").groupBy("doc_id", "vertex").count().where("count > 1")
    if again.isEmpty():
        return out
    # Whole rows repeat: of equal (doc_id, text) one row stays, other than rows without words.
    again = again.select(F.col("doc_id").alias("again doc_id"), F.col("vertex").alias("again vertex"))
    repeated = docs["doc_id"].eqNullSafe(F.col("again doc_id")) & (_vertex() == F.col("again vertex"))
    once = out.join(again, repeated, "left_semi").withColumn("kept vertex", _vertex()).dropDuplicates(["doc_id", "kept vertex"])
    return out.join(again, repeated, "left_anti").union(once.drop("kept vertex"))
