import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidegate.llm import near_copies as m

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    return out


def brute(texts):
    sets, stay = sets_of(texts), []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in stay if len(sets[i] & sets[j])):
            stay.append(i)
    return set(stay)


def near(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA).repartition(4)
    return {r.doc_id for r in corpus_pipeline.near_deduplication(spark, docs, "").collect()}


def test_stage_drops_edited_copies_and_keeps_what_is_less_similar(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {}
    for k in range(60):
        base = [word() for _ in range(100)]
        texts[10 * k] = " ".join(base)
        for n, edits in enumerate((1, 2, 4, 6), 1):
            copy = list(base)
            for e in range(edits):
                copy[10 + 12 * e] = word()
            texts[10 * k + n] = " ".join(copy)
    want = brute(texts)
    assert {10 * k + 1 for k in range(60)}.isdisjoint(want) and {10 * k + 4 for k in range(60)} <= want
    assert near(spark, texts) == want


def test_a_chain_of_copies_does_not_take_its_far_end(spark):
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") * 3 + str(k) for k in range(400)]
    texts = {k: " ".join(words[20 * k : 20 * k + 200]) for k in range(10)}
    want = brute(texts)
    assert 1 < len(want) < 10 and near(spark, texts) == want


def test_stage_equals_brute_force_on_real_rows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    want, got = brute(texts), near(spark, texts)
    assert len(want) < len(texts) and len(want ^ got) <= 0.002 * len(texts)


def test_nulls_empty_long_ties_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, key string, leader long, s0 long, copy string"
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    texts = [(1, "a b c d e f g h"), (2, "A b c\td e f g  h"), (3, None), (4, ""), (5, " \n"), (None, "a b c d e f g h"), (6, long), (7, long + " end"), (8, "a b"), (8, "c d"), (9, "c d"), (1, "a b c d e f g h")]
    docs = spark.createDataFrame([(i, t, "k", 5, 6, "c") for i, t in texts], schema).repartition(3)
    assert sorted(r.id for r in m.distinct_ids(docs).collect()) == [1, 3, 6, 8]
    assert m.distinct_ids(docs.where("false")).collect() == []
    assert sorted(r.id for r in m.distinct_ids(docs.where("doc_id = 6")).collect()) == [6]


def test_sketches_agree_as_the_sets_are_alike():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        off = []
        for _ in range(40):
            both, own = rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64), rng.integers(0, 1 << 63, (2, int(200 * (1 - share))), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, x])) for x in own)
            same = m.BITS - int(np.bitwise_count((m.sketch(a) ^ m.sketch(b)).view(np.uint64)).sum())
            off.append(same / m.BITS - (1 + m.jaccard(a, b)) / 2)
        assert abs(np.mean(off)) < 0.01 and max(map(abs, off)) < 0.06


def test_simhash_links_find_candidates_of_their_own(spark, monkeypatch):
    """With no band at all, near copies that the fingerprints link go, and what isn't similar stays."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(9000)}" for _ in range(3000)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "other"]), 3: " ".join(f"v{rng.randrange(9000)}" for _ in range(3000)), 4: " ".join(words[::-1]), 5: ""}
    bands = m.coded
    monkeypatch.setattr(m, "coded", lambda rows, shingle: bands(rows, shingle).withColumn("keys", F.slice("keys", 1, 0)))
    assert brute(texts) == {1, 3, 4, 5}
    assert near(spark, texts) == {1, 3, 4, 5}
