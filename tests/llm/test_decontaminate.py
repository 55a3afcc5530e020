import random

import numpy as np

from tidegate.llm import decontaminate as m
from tidegate.llm.common import align

DOCS = "doc_id long, text string, x string, leaks string"
ITEMS = "item_id long, text string, x string"


def slow_align(a, b, match=2, miss=1, gap=1):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else -miss), h[i - 1][j] - gap, h[i][j - 1] - gap)
    return max(map(max, h))


def test_alignment_scores_equal_the_textbook_recurrence():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(1, 6, size=rng.integers(1, 25)), rng.integers(1, 6, size=rng.integers(1, 40))
        score, matches, i0, i1, j0, j1 = align(a, b)
        assert score == slow_align(a.tolist(), b.tolist())
        assert 0 <= matches <= min(i1 - i0, j1 - j0)
        assert align(a, b, 0, 100)[0] == score
        assert align(a, b, 0, 3)[0] <= score


def made(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 40)))) for k in range(20)]
    docs, want = [], set()
    for d in range(120):
        text = [word() for _ in range(rng.randint(30, 200))]
        if d % 3 == 0:
            item, passage = items[rng.randrange(20)]
            passage = passage.upper().split()
            for _ in range(len(passage) // 14):
                passage[rng.randrange(len(passage))] = word()
            at = rng.randrange(len(text))
            text[at:at] = passage
            want.add((d, item))
        docs.append((d, ", ".join(text), "a", "b"))
    return docs, [(*i, "a") for i in items], want


def test_planted_exact_and_edited_passages_are_found_and_nothing_else(spark):
    docs, items, want = made()
    got = m.contaminated_pairs(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.id, r.item_id) for r in got} == want
    texts = {d[0]: m.words_of(d[1]) for d in docs}
    for r in got:
        assert r.similarity >= 0.8 and set(texts[r.id][r.start_word : r.end_word]) & set(m.words_of(items[r.item_id][1]))


def test_copies_edited_at_every_fifth_and_sixth_word_are_found(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(30)), "a") for k in range(20)]
    docs = []
    for every in (5, 6):
        for k, text, _ in items:
            copy = [word() if i % every == every - 1 else w for i, w in enumerate(text.split())]
            docs.append((100 * every + k, " ".join([word() for _ in range(40)] + copy + [word() for _ in range(40)]), "a", "b"))
    got = m.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    # with every fifth replaced the aligned stretch holds 24 of 30 words: just the limit
    assert {(r.id, r.item_id) for r in got} == {(100 * every + k, k) for every in (5, 6) for k in range(20)}


def test_recall_of_edited_copies_of_long_and_short_items(spark):
    """Words replaced, left out and put in at random, as many as the threshold allows; recall by kind."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items, docs, kinds = [], [], {}
    for k in range(400):
        words = [word() for _ in range((5, 8, 12, 20, 40)[k % 5])]
        kind = ("replaced", "deleted", "inserted", "mixed")[k // 5 % 4]
        copy = list(words)
        for n in range(len(words) // 5):
            how = kind if kind != "mixed" else ("replaced", "deleted", "inserted")[n % 3]
            at = rng.randrange(1, len(copy) - 1)
            copy[at : at + (how != "inserted")] = [] if how == "deleted" else [word()]
        codes = {w: c for c, w in enumerate(dict.fromkeys(words + copy), 1)}
        _, matches, _, _, j0, j1 = align(np.array([codes[w] for w in words]), np.array([codes[w] for w in copy]))
        items.append((k, " ".join(words), "a"))
        docs.append((k, " ".join([word() for _ in range(30)] + copy + [word() for _ in range(30)]), "a", "b"))
        if matches >= 0.8 * max(len(words), j1 - j0):
            kinds.setdefault((kind, len(words)), set()).add(k)
    got = {r.id for r in m.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect() if r.id == r.item_id}
    found = {kind: len(want & got) / len(want) for kind, want in kinds.items()}
    assert len(kinds) >= 18 and sum(map(len, kinds.values())) > 300
    assert sum(len(w & got) for w in kinds.values()) >= 0.97 * sum(map(len, kinds.values())) and min(found.values()) >= 0.9, found


def test_short_items_are_found_whole(spark):
    items = [(2, "zwei woerter", "a"), (3, "drei kurze woerter", "a"), (4, "what is four really", "a"), (5, "a five word test item", "a")]
    docs = [(i, f"before {t.upper()} after", "a", "b") for i, t, _ in items] + [(9, "nothing of the kind in here at all", "a", "b"), (10, "a five other test item", "a", "b")]
    got = {(r.id, r.item_id) for r in m.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(2, 2), (3, 3), (4, 4), (5, 5), (10, 5)}


def test_common_seeds_serve_where_an_item_has_no_rare_ones(spark):
    docs, items, want = made(2)
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for rare, fallback in ((0, 24), (1, 8), (10**9, 0)):
        got = m.contaminated_pairs(*frames, rare=rare, fallback=fallback).collect()
        assert {(r.id, r.item_id) for r in got} == want, (rare, fallback)
    # an item that is in every document, beside a rare one
    common = items[0][1]
    many = [(k, f"own{k} words{k} {common} and more{k}" + (" " + items[1][1] if k == 7 else ""), "a", "b") for k in range(400)]
    got = {(r.id, r.item_id) for r in m.contaminated_pairs(spark.createDataFrame(many, DOCS).repartition(5), frames[1], rare=20).collect()}
    assert got == {(k, 0) for k in range(400)} | {(7, 1)}


def test_rare_seeds_are_chosen_by_their_frequency(spark):
    seeds = spark.createDataFrame([(k, 1, k, 9) for k in range(8)] + [(10, 2, 0, 3), (11, 2, 1, 3), (99, 3, 0, 3)], "key long, unit long, place int, words int")
    hits = spark.createDataFrame([(d, 0, k, 0) for k, n in ((0, 1), (1, 2), (2, 3), (3, 50), (4, 60), (10, 70), (11, 80)) for d in range(n)], "a long, b long, key long, pos int")
    got = sorted((r.unit, r.key) for r in m.chosen_seeds(seeds, hits, 3, 2).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 10), (2, 11)]
    assert sorted((r.unit, r.key) for r in m.chosen_seeds(seeds, hits, 3, 4).collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 10), (2, 11)]


def test_the_filter_has_every_seed_and_little_else(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, 20_000)
    bits = m.seed_filter(spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3))
    one, two = m.slots(keys, len(bits))
    assert (bits[one] & bits[two]).all()
    one, two = m.slots(rng.integers(-(2**63), 2**63 - 1, 50_000), len(bits))
    assert (bits[one] & bits[two]).mean() < 0.05


def test_no_cross_join_and_nothing_broadcast_without_a_bound(spark, monkeypatch):
    docs, items, want = made(3)
    monkeypatch.setattr(m, "SMALL", 0)
    out = m.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {(r.id, r.item_id) for r in out.collect()} == want


def test_equals_an_alignment_of_every_document_with_every_item(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs += [(1000 + r.item_id, "before it " + r.text + " after it") for r in items.collect()[:10]]
    got = {(r.id, r.item_id) for r in m.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    want, seen = set(), {}
    for d, t in docs:
        codes = m.codes_of(t, seen)
        for r in items.collect():
            words = m.codes_of(r.text, seen)
            if len(words) < 2:
                continue
            _, matches, _, _, j0, j1 = align(words, codes)
            if matches >= 0.8 * max(len(words), j1 - j0):
                want.add((d, r.item_id))
    assert got == want and len(want) >= 10


def test_documents_without_leaks_keep_their_columns(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, item, "x", "l"), (2, "clean", "x", "l"), (None, None, "x", "l"), (None, item + " and more", "x", "l"), (3, "", "x", "l"), (2, "clean", "x", "l")], DOCS)
    items = spark.createDataFrame([(1, item, "a")], ITEMS)
    left = m.without_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, ""), (2, "clean"), (2, "clean"), (3, "")]
    assert m.without_leaks(docs, items.where("false")).count() == 6


def test_nulls_empty_long_repeated_rows_and_items(spark):
    item = "one two three four five six seven eight"
    docs = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "word " * 200000 + item, "a", "b"), (3, "word " * 200000 + item, "a", "b"), (None, item, "a", "b"), (4, item * 1, "a", "b"), (5, (item + " ") * 50, "a", "b")]
    items = [(1, item, "a"), (1, item, "a"), (2, None, "a"), (None, item, "a"), (3, "", "a"), (4, "one two nine", "a"), (5, "six", "a")]
    got = m.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted({(r.id or -1, r.item_id) for r in got}) == [(-1, 1), (3, 1), (4, 1), (5, 1)]
    assert sum(r.id == 3 for r in got) == 1, "rows that repeat an id and text are one document"
    assert m.contaminated_pairs(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert m.contaminated_pairs(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
