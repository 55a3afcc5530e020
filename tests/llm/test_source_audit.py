import re
from collections import Counter

from tidegate.llm import source_audit as m

SCHEMA = "doc_id long, text string, lang string, source string, v long, names string, term string"


def brute(rows, min_docs=30, prior=5, top=50):
    docs = [(g or "", s or "", [re.sub("[A-Z]", lambda x: x[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for _, t, g, s, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, w) for g, s, w in docs if g == lang]
        held = Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in held.items() if n >= min_docs}
        count = {s: Counter() for s, _ in own}
        for s, w in own:
            count[s].update(t for t in w if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + prior) // (sum(c.values()) + prior * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            pair = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in count if x != s]
            term = [(t, p[s][t] - q[t]) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])]
    return sorted(out)


def run(spark, rows, **more):
    return sorted(tuple(r) for r in m.divergence(spark.createDataFrame(rows, SCHEMA).repartition(4), **more).collect())


def test_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, 1, "n", "t") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute(rows)
    assert len(want) > 1000
    assert run(spark, rows) == want


def test_nulls_empty_long_ties_repeats_and_clashing_columns(spark):
    rows = [(k, "Café naïve_x y A-Z9b\x7fc" if k % 2 else "a b b É", None if k % 3 else "", "s" if k % 5 else None, 1, "n", "t") for k in range(40)]
    rows += [(1, "a b", "xx", "only", 1, "n", "t"), (2, None, "yy", "p", 1, "n", "t"), (3, "", "yy", "q", 1, "n", "t"), (4, " 12 ", "yy", "r", 1, "n", "t"), (None, "word " * 200_000, "", "long", 1, "n", "t")]
    rows += [(7, "same row", "zz", s, 1, "n", "t") for s in "aab"]
    for least in (1, 3, 30):
        want = brute(rows, min_docs=least, top=2)
        assert run(spark, rows, min_docs=least, top=2) == want
    assert ("yy", "p", "pair", "q", 0, 1) in want  # a language without terms
    assert not any(r[0] == "xx" for r in want)
    assert run(spark, []) == []


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    rows = [(10**13, 2 * 10**13, 7), (2**60, 2**60 + 1, 1), (0, 10**15, 10**6)]
    got = spark.createDataFrame(rows, "n long, t long, k long").select(m.share(F.col("n"), F.col("t"), F.col("k"), 5).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * k) for n, t, k in rows]


def test_plan_sums_before_the_exchange_and_limits_ranks_early(spark):
    df = m.divergence(spark.createDataFrame([(1, "a b", "x", "s", 1, "n", "t")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
