import re

from cases import LOWER, SCHEMA, awkward, documents, edited, prose

from textloom.llm.jaccard import jaccard_components, keep_one_of_each


def plain_components(rows, width=5, similarity=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                group[max(root(a), root(b))] = min(root(a), root(b))
    lowest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            lowest[root(k)] = min(i, lowest.get(root(k), i))
    return [(i, len(s), lowest.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def planted():
    rows = awkward()
    near = prose(1, 120)
    rows += [(100 + k, edited(near, k, 3 + k % 5)) for k in range(40)]  # around the threshold, so chains matter
    passage = prose(2, 60)
    rows += [(200 + k, passage + " " + prose(300 + k, 8 + k)) for k in range(30)]  # a frequent passage
    rows += [(400, near.upper()), (401, near.replace(" ", "  \n")), (402, "one two three"), (403, "One two THREE"), (404, "two three")]
    return rows


def test_same_components_as_all_pairs(spark):
    rows = planted()
    got = [tuple(r) for r in jaccard_components(documents(spark, rows)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(plain_components(rows), key=key)


def test_one_of_each_group_stays_with_its_columns(spark):
    rows = planted()
    docs = documents(spark, rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    expected = {(i, c) for i, n, c in plain_components(rows) if n and (i == c)} | {(i, i) for i, n, c in plain_components(rows) if not n or i is None}
    assert ids == sorted((i is None, i or 0) for i, _ in expected)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
