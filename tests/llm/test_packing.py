import random

import pytest

from tidegate.llm import packing as m

SCHEMA = "doc_id long, text string, source string, bin string, size long"


def slow_best_fit(items, capacity):
    """Every bin is looked at for every item."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [k for k, (used, sources, clusters) in enumerate(bins) if used + size <= capacity and (source is None or source not in sources) and (cluster is None or cluster not in clusters)]
        k = min(fits, key=lambda k: (capacity - bins[k][0], k), default=None)
        if k is None:
            k = len(bins)
            bins.append((0, set(), set()))
        used, sources, clusters = bins[k]
        bins[k] = (used + size, sources | {source}, clusters | {cluster})
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_a_search_of_all_bins(seed):
    rng = random.Random(seed)
    items = [(rng.choice([0, 1, rng.randint(1, 100)]), rng.choice(["hot", "hot", "a", "b", "c", None]), rng.choice([rng.randrange(50), None])) for _ in range(400)]
    items.sort(key=lambda x: -x[0])
    assert m.best_fit(items, 100) == slow_best_fit(items, 100)


def check(rows, sizes, capacity):
    bins, parts = {}, {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
        parts.setdefault(r.id, []).append((r.start, r.length))
    for own in bins.values():
        assert sum(r.length for r in own) <= capacity
    for i, (size, *_) in sizes.items():
        at = 0
        for start, length in sorted(parts[i]):
            assert start == at and (length == capacity or start + length == size)
            at += length
        assert at == size
    for own in bins.values():
        for k in (1, 2):
            held = [sizes[r.id][k] for r in own if sizes[r.id][k] is not None]
            assert len(held) == len(set(held))
    return bins


def test_documents_are_whole_and_bins_keep_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = m.document_sizes(docs)
    known = {r.id: (r.size, r.source, r.cluster) for r in sizes.collect()}
    assert {r.doc_id: len(r.text.encode().split()) for r in docs.collect()} == {i: s for i, (s, *_) in known.items()}
    rows = m.pack(sizes, 512, 300).collect()
    bins = check(rows, known, 512)
    assert len({b.split("-")[0] for b in bins}) >= 4
    assert sum(r.length for r in rows) / (512 * len(bins)) > 0.85


def test_pieces_carry_their_text_and_clusters_come_from_outside(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clusters = docs.selectExpr("doc_id AS id", "doc_id div 3 AS component").where("id % 5 <> 0")
    sizes = m.document_sizes(docs, clusters=clusters, words=True)
    known = {r.id: (r.size, r.source, r.cluster) for r in sizes.collect()}
    rows = m.pack(sizes, 200, 100).collect()
    check(rows, known, 200)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(known[i][2] == i // 3 for i in known if i % 5)
    got = {}
    for r in sorted(rows, key=lambda r: r.piece):
        assert len(r.text.encode().split()) == r.length
        got[r.id] = got.get(r.id, "") + r.text
    assert got == {i: t.lstrip(" \t\n\x0b\x0c\r") for i, t in texts.items()}


def test_groups_cost_little_fill(spark):
    """Bins against what all words would fill, and against one group of all pieces."""
    sizes = m.document_sizes(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    parts, whole = m.pack(sizes), m.pack(sizes, group_rows=10**9)
    n = parts.select("bin").distinct().count()
    bound = -(-parts.agg({"length": "sum"}).first()[0] // 1024)
    assert n <= 1.02 * whole.select("bin").distinct().count() and n >= bound


def test_nulls_empty_long_repeated_rows_and_no_rows(spark):
    rows = [(1, None, None, "x", 9), (2, "", "s", "x", 9), (3, "w " * 100000, "s", "x", 9), (4, "a b", "s", "x", 9), (4, "a b", "s", "x", 9), (None, "c", "s", "x", 9), (5, "A B", "t", "x", 9)]
    got = m.pack(m.document_sizes(spark.createDataFrame(rows, SCHEMA)), 1000).collect()
    assert sum(r.id == 3 for r in got) == 100 and len(got) == 106
    by = {}
    for r in got:
        by.setdefault(r.bin, []).append(r.id)
    assert all(len([i for i in ids if i in (2, 3, 4, None)]) <= 1 for ids in by.values()), "one source"
    assert all(len([i for i in ids if i in (4, 5)]) <= 1 for ids in by.values()), "one cluster"
    assert m.pack(m.document_sizes(spark.createDataFrame([], SCHEMA))).count() == 0
