import math
import random

import numpy as np
import pytest

from tidegate.llm import quality as m

DOCS = "doc_id long, text string, key string, log_weight string"
LABELS = "doc_id long, quality int, toxic int, text string"


def test_held_out_rows_are_told_apart(spark):
    """All labelled rows that the model was not fitted on, whatever made them junk or toxic."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.id for r in m.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    share = lambda ids: len(kept.intersection(ids)) / len(ids)
    clean, junk, toxic = share([r.doc_id for r in held if r.quality == 1 and not r.toxic]), share([r.doc_id for r in held if not r.quality]), share([r.doc_id for r in held if r.toxic])
    assert clean > 0.97 and junk < 0.15 and toxic < 0.5, (clean, junk, toxic)


def test_the_table_grows_with_the_corpus():
    assert [m.table_bits(n) for n in (0, 1000, 300_000, 1_000_000, 10**9)] == [21, 21, 22, 23, 24]


def brute_counts(rows, target, bits):
    raw, hit, seen = np.zeros(1 << bits, int), np.zeros(1 << bits, int), {}
    for i, t, *_ in rows:
        own = {int(x) for b in m.buckets(m.grams(t, seen), bits) for x in b}
        for b in own:
            raw[b] += 1
            hit[b] += i in target
    return raw, hit


def made(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(40)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=30)
        bad = i % 5 == 0
        if bad:
            words[3:3] = ["nasty", "horrid", "vile"]
        rows.append((i, " ".join(words), "a", "b"))
        if i % 2:
            labels.append((i, 1, int(bad), "x"))
    return rows, labels


def test_counts_weights_and_top_k_equal_brute_force(spark):
    rows, labels = made()
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    target = {i for i, q, t, _ in labels if q == 1 and not t}
    raw, hit, n, k = m.counts(docs, np.array(sorted(target)), 14, "doc_id", "text")
    want_raw, want_hit = brute_counts(rows, target, 14)
    assert (n, k) == (300, len(target)) and (raw == want_raw).all() and (hit == want_hit).all()
    weights = {r.id: r for r in m.weigh(docs, marks, bits=14).collect()}
    ratio = m.log_ratios(raw, hit, n, k, 8.0, 1.0)
    for i, t, *_ in rows:
        assert math.isclose(weights[i].log_weight, m.log_weight(t, ratio, 14, {}) / 0.25, abs_tol=1e-6)
    assert all((weights[i].log_weight < -3) == (i % 5 == 0) for i in weights)
    for size in (1, 17, 240, 300, 900):
        got = {r.id for r in m.resample(docs, marks, k=size, bits=14).collect()}
        assert got == set(sorted(weights, key=lambda i: -weights[i].key)[:size])
    drawn = {r.id for r in m.resample(docs, marks, bits=14).collect()}
    assert len(drawn) == round(sum(min(1.0, math.exp(w.log_weight)) for w in weights.values()))
    assert sum(i % 5 > 0 for i in drawn) >= 0.94 * len(drawn)


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_kth_largest(spark, few):
    rng = random.Random(few)
    values = [rng.gauss(0, 3) for _ in range(500)] + [1.5] * 20 + [-40.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 250, 400, 520, 521, 600):
        assert m.kth_largest(df, "v", k, bins=16, few=few) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_nulls_empty_long_repeated_rows_and_no_labels(spark):
    rows, labels = made(60)
    rows += [(1000, None, "a", "b"), (1001, "", "a", "b"), (1002, "word " * 200000, "a", "b"), (1, rows[1][1], "a", "b"), (None, "lonely", "a", "b")]
    labels += [(None, 1, 0, "x"), (7777, 1, 0, "x"), (3, None, None, "x"), (1, 1, 0, "x")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = m.weigh(docs, marks, bits=14).collect()
    assert len(got) == len(rows) and {r.log_weight for r in got if r.id in (1000, 1001)} == {0.0}
    assert m.resample(docs, spark.createDataFrame([], LABELS), bits=14).count() == len(rows)
    assert m.resample(spark.createDataFrame([], DOCS), marks, bits=14).count() == 0


def written_out(rows, target, sure=8.0, least=1.0, temperature=0.25):
    """Weights from n-grams as they are, in dictionaries: no codes, no buckets, none of the module's functions."""
    import re

    def grams(text):
        tokens = re.findall(r"\w+|[^\w\s]+", text or "")
        out = {("w", t) for t in tokens} | {("p", a, b) for a, b in zip(tokens, tokens[1:], strict=False)}
        words = [t for t in tokens if t[0].isalnum() or t[0] == "_"]
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        if 64 * same > len(tokens):
            out.add(("again", int(math.log2(64 * same / len(tokens)))))
        return out

    own = [(i, grams(t)) for i, t, *_ in rows]
    raw, hit = {}, {}
    for i, gs in own:
        for g in gs:
            raw[g] = raw.get(g, 0) + 1
            hit[g] = hit.get(g, 0) + (i in target)
    share = sum(i in target for i, _ in own) / len(own)
    lr = {g: math.log((hit[g] + 1) / (raw[g] * share + 1)) for g in raw}
    half, run, middle = sum(hit.values()) / 2, 0, 0.0
    for g in sorted(lr, key=lr.get):
        run += hit[g]
        middle = lr[g]
        if run >= half:
            break

    def telling(g):
        far = lr[g] - middle
        z = 2 * (math.sqrt(hit[g] + 0.375) - math.sqrt(raw[g] * share * math.exp(middle) + 0.375))
        return far if abs(far) >= least and abs(z) >= (sure / 2 if abs(far) >= 2 * least else sure) else 0.0

    return {i: sum(telling(g) for g in gs) / temperature for i, gs in own}


def test_weights_equal_dictionaries_of_whole_ngrams(spark):
    rows, labels = made(400, seed=4)
    rows = [(i, t + (" echo" * 12 if i % 9 == 0 else "") + ", done.", a, b) for i, t, a, b in rows]
    target = {i for i, q, t, _ in labels if q == 1 and not t}
    want = written_out(rows, target)
    got = {r.id: r.log_weight for r in m.weigh(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS), bits=24).collect()}
    assert sum(w < -3 for w in want.values()) > 50
    assert all(math.isclose(got[i], want[i], rel_tol=1e-4, abs_tol=1e-3) for i in want), max((abs(got[i] - want[i]), i) for i in want)
