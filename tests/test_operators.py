import random
from collections import OrderedDict, deque
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tidegate import queries
from tidegate.config import DEFAULTS
from tidegate.operators import caches, corpus, decisions, images, keywords, logs, semantic

TEXTS = "request_id long, text string"


def hits(spark, words, text):
    lex = spark.createDataFrame(words, "category string, word string")
    rows = keywords.keyword_hits(spark.createDataFrame([(1, text)], TEXTS), lex).collect()
    return sorted((r.start, r.end, r.category, r.word, r.kind) for r in rows)


def test_keyword_scan(spark):
    assert hits(spark, [("c", "裸聊"), ("c", "加我")], "来裸聊加我") == [(1, 3, "c", "裸聊", "literal"), (3, 5, "c", "加我", "literal")]
    assert len(hits(spark, [("c", "裸聊"), ("d", "裸聊")], "裸聊")) == 2
    assert [h[:2] for h in hits(spark, [("c", "aa")], "aaaa")] == [(0, 2), (1, 3), (2, 4)], "overlaps count"
    assert hits(spark, [("c", "ab")], "xＡＢ a@b")[0][4] == "fullwidth"
    assert hits(spark, [("c", "ab")], "a*b") == [(0, 3, "c", "ab", "symbol")]
    assert hits(spark, [("c", "ab")], "😀ab") == [(1, 3, "c", "ab", "literal")], "code points"
    assert hits(spark, [("c", "x+y")], "y and x") == [(0, 7, "c", "x+y", "literal")]
    assert hits(spark, [("c", "x+y"), ("c", "a+a"), ("c", " + "), ("c", "")], "but x, a a") == []
    assert hits(spark, [("c", "x")], None) == []


def test_how_a_word_is_written_goes_before_how_it_sounds(spark):
    known = {"赌": "du", "賭": "du", "博": "bo", "网": "wang", "網": "wang", "捡": "jian", "见": "jian", "闻": "wen", "裸": "luo", "聊": "liao"}

    def found(words, text):
        lex = spark.createDataFrame(words, "category string, word string")
        return [(r.start, r.end, r.word, r.kind) for r in keywords.keyword_hits(spark.createDataFrame([(1, text)], TEXTS), lex, known).collect()]

    assert found([("c", "赌博网")], "来賭博網") == [(1, 4, "赌博网", "traditional")]
    assert found([("c", "捡闻")], "见闻很多") == [(0, 2, "捡闻", "pinyin_full")]
    assert found([("c", "捡闻+裸聊")], "见闻裸聊") == [], "an AND rule needs its words as they are written"
    assert found([("c", "捡闻+裸聊")], "捡闻裸聊") == [(0, 4, "捡闻+裸聊", "literal")]
    assert found([("c", "捡闻+裸聊")], "jianwen裸聊") == [(0, 9, "捡闻+裸聊", "literal")], "spelled in Latin letters they stand in the text"


def test_a_lexicon_in_parts_gives_the_same(spark):
    lex = spark.createDataFrame([("c", w) for w in ("ab", "bc", "cd", "x+y")], "category string, word string")
    texts = spark.createDataFrame([(1, "abcd"), (2, "y x")], TEXTS)
    v = keywords.automaton_rows(lex)
    whole, parts = keywords.keyword_scan(texts, v), keywords.keyword_scan(texts, v, most_chars=300)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)


def test_rules(spark):
    texts = spark.createDataFrame([(1, "来加我好友")], TEXTS)
    lex = spark.createDataFrame([("c", "加我")], "category string, word string")
    rule = lambda *r: spark.createDataFrame(r, "id long, category string, pattern string, action string, note string, is_active boolean")
    out = keywords.regex_exempt(texts, lex, rule((1, "", "官方加我", "exempt", "", True), (2, "c", "加我", "exempt", "", True), (3, "", "加我", "exempt", "", True))).collect()
    assert [r.rule_id for r in out] == [2]
    assert keywords.regex_exempt(texts, lex, rule((1, "d", "加我", "exempt", "", True))).first().rule_id is None
    r = keywords.regex_violate(texts, rule((1, "", "加.", "violate", "", True), (2, "", "加", "violate", "", False))).collect()
    assert [(x.start, x.end) for x in r] == [(1, 3)]


RULE = "id long, category string, pattern string, action string, note string, is_active boolean"


def test_violating_rules_equal_python_expressions_tried_one_by_one(spark):
    import re

    rng = random.Random(4)
    patterns = [r"\bcat", r"(?<=x)cat", r"^dog", r"cat$", r"d.g", r"[a-c]at", r"(cat|dog)s?", r"CAT", r"ca+t", r"😀cat", r"q{2,3}", r"cat dog", r"\d+"]
    texts = [(k, "".join(rng.choice(["cat", "dog", "x", " ", "😀", "CAT", "q", "7", "con"]) for _ in range(rng.randint(1, 12)))) for k in range(300)]
    texts += [(300, "concat cat"), (301, ""), (302, None), (303, "İ cat")]
    rules = spark.createDataFrame([(k, "c" if k % 2 else "", p, "violate", "", True) for k, p in enumerate(patterns)], RULE)
    got = {(r.request_id, r.rule_id, r.category, r.start, r.end) for r in keywords.regex_violate(spark.createDataFrame(texts, TEXTS).repartition(3), rules).collect()}
    want = {(i, k, "c" if k % 2 else "", m.start(), m.end()) for i, t in texts if t for k, p in enumerate(patterns) if (m := re.search(p, t))}
    assert got == want and (300, 0, "", 7, 10) in got and len(got) > 300


def test_wrong_rules_are_named_and_stop_the_job(spark):
    import pytest

    rules = spark.createDataFrame([(1, "", "a(", "violate", "", True), (2, "", "b", "allow", "", True), (3, "", None, "exempt", "", True), (4, "", "c", "exempt", "", True)], RULE)
    assert {r.id: r.error.split(":")[0] for r in keywords.rule_errors(rules).collect()} == {1: "pattern", 2: "action", 3: "pattern"}
    texts = spark.createDataFrame([(1, "abc")], TEXTS)
    for bad in (1, 2):
        with pytest.raises(ValueError, match=f"rule {bad}"):
            keywords.regex_violate(texts, rules.where(f"id = {bad}"))
    assert keywords.regex_violate(texts, rules.where("id = 4")).count() == 0


def test_one_pass_gives_hits_exemptions_and_violations(spark):
    texts = spark.createDataFrame([(1, "来加我好友"), (2, "x+y and 捡闻"), (3, None)], TEXTS)
    words = spark.createDataFrame([("c", "加我"), ("c", "x+y"), ("d", "见闻")], "category string, word string")
    rules = spark.createDataFrame([(1, "", "加我好友", "exempt", "", True), (2, "", "加我", "violate", "", True)], RULE)
    known = {"捡": "jian", "见": "jian", "闻": "wen"}
    rows = keywords.judged_hits(texts, words, rules, known).collect()
    got = sorted((r.request_id, r.start, r.end, r.word, r.kind, r.rule_id or 0, r.violates) for r in rows)
    assert got == [(1, 1, 3, "加我", "literal", 1, False), (1, 1, 3, "加我", "literal", 2, True), (2, 0, 3, "x+y", "literal", 0, False), (2, 8, 10, "见闻", "pinyin_full", 0, False)]
    assert sorted(map(tuple, keywords.judged_hits(texts, words, rules, known, most_chars=60).collect()), key=str) == sorted(map(tuple, rows), key=str)


def scores(spark, black, white):
    rows = [(1, "black", k + 1, k, f"c{k}", s) for k, s in enumerate(black)] + [(1, "white", k + 1, 100 + k, "w", s) for k, s in enumerate(white)]
    top = spark.createDataFrame(rows, "request_id long, pool string, rank int, vec_id long, category string, score double")
    return semantic.semantic_confidence(semantic.semantic_signals(top)).first()


def test_confidence(spark):
    r = scores(spark, [0.9, 0.775, 0.775, 0.775, 0.775], [0.2] * 5)
    assert r.confidence == 1.0 and r.triggered
    r = scores(spark, [0.3] * 3, [0.9] * 3)
    assert abs(r.confidence - 0.18) < 1e-12 and not r.triggered and r.category == "c0"
    d = replace(DEFAULTS, semantic_threshold=0.8)
    s = spark.createDataFrame([(0.82, 0.81, 0.0)], "black_top double, white_top double, margin double")
    assert not semantic.semantic_confidence(s, d).first().triggered
    assert scores(spark, [], [0.9]).confidence is None


def test_tiers_and_merge(spark):
    df = spark.createDataFrame([(c,) for c in (0.34, 0.35, 0.5, 0.75, 0.76)], "c double")
    assert [r.t for r in df.select(decisions.tier(F.col("c")).alias("t")).collect()] == ["safe", "llm", "llm", "llm", "violation"]
    v = F.struct(F.lit(True).alias("is_violation"), F.lit(None).cast("string").alias("category"), F.lit(0.6).alias("confidence"))
    r = spark.range(1).select(decisions.merge(F.lit(0.4), F.lit(False), F.lit("s"), v).alias("x")).first().x
    assert abs(r.confidence - 0.52) < 1e-12 and r.category == "s" and r.source == "llm" and r.has_violation
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (0.5,)], "c double")
    assert [r.x for r in df.select(decisions.finite_or(F.col("c"), 0.7).alias("x")).collect()] == [0.7, 0.7, 0.7, 0.5]


def test_topk_ties_zero_vectors_and_short_pools(spark):
    pools = spark.createDataFrame([(1, "black", "a", [1.0, 0.0]), (2, "black", "b", [2.0, 0.0]), (3, "black", "c", [0.0, 0.0]), (4, "white", "d", [0.0, 1.0])], "vec_id long, pool string, category string, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "request_id long, query array<double>")
    for small in (semantic.SMALL, 0):
        rows = semantic.vector_topk(queries, pools, 2, small=small).orderBy("pool", "rank").collect()
        assert [(r.request_id, r.pool, r.rank, r.vec_id) for r in rows] == [(7, "black", 1, 2), (7, "black", 2, 1), (7, "white", 1, 4)]
        assert semantic.vector_topk(queries, pools.where("false"), 2, small=small).collect() == []


def test_topk_of_broadcast_and_packed_pools_agree(spark):
    rng = random.Random(4)
    vec = lambda: [round(rng.gauss(0, 1), 1) for _ in range(3)]
    pools = spark.createDataFrame([(k, "black" if k % 3 else "white", f"c{k % 4}", vec()) for k in range(150)], "vec_id long, pool string, category string, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(k, vec()) for k in range(60)], "request_id long, query array<double>").repartition(3)
    for others in (False, True):
        a, b = (sorted((r.request_id, r.pool, r.rank, r.vec_id, r.category, round(r.score, 9)) for r in semantic.vector_topk(queries, pools, 4, others, small).collect()) for small in (semantic.SMALL, 0))
        assert a == b and len(a) == 60 * 8


def test_near_hashes_by_bands_equal_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(256) for _ in range(30)]
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(256), n))
    frames = [(k, "m", f"{flip(h, k % 26):064x}") for k, h in enumerate(base)]
    # turned bits that lie evenly over the bands, the worst case
    frames += [(100 + k, "m", f"{h ^ sum(1 << (32 * (j % 8) + j // 8 + k) for j in range(k)):064x}") for k, h in enumerate(base[:24])]
    known = [(k, "w", f"{h:064x}") for k, h in enumerate(base)]
    a, b = spark.createDataFrame(frames, "frame_id long, md5 string, phash string"), spark.createDataFrame(known, "white_id long, white_md5 string, white_phash string")
    for d in (0, 3, 5, 7, 8, 12, 15, 16, 23, 40):
        want = {(i, j, (int(x, 16) ^ int(y, 16)).bit_count()) for i, _, x in frames for j, _, y in known if (int(x, 16) ^ int(y, 16)).bit_count() <= d}
        near = images.near_hashes(a, b, d)
        assert {tuple(r) for r in near.collect()} == want and (d < 5 or len(want) > d)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert ("Cartesian" in plan or "NestedLoop" in plan) == (d > 23)


def test_key_references(spark):
    rng = random.Random(8)
    keys = sorted({"".join(rng.choice("ab-_") for _ in range(rng.randint(1, 6))) for _ in range(120)} | {"UNIQUE-1", "x" * 50})
    refs = sorted({k[: rng.randint(1, 6)] for k in keys} | {"UNI", "U*N?I", "none", "", "**", "x" * 49, "x" * 50, "x" * 51, *keys[:20]})
    out = caches.resolve_keys(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame([(k,) for k in keys], "key string").repartition(4))
    got = {r.ref: (r.key, r.n) for r in out.collect()}
    for ref in refs:
        prefix = "".join(c for c in ref if c.isalnum() or c in "_-")
        found = [k for k in keys if prefix and k.startswith(prefix)]
        assert got[ref] == (ref if ref in keys else found[0] if len(found) == 1 else None, len(found)), ref
    assert got["U*N?I"] == ("UNIQUE-1", 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_samples_keep_few_rows_a_task(spark):
    rows = spark.createDataFrame([("black" if k % 5 else "white", k, f"t{k}", "s") for k in range(200)], "pool string, line_no int, text string, source string").repartition(6)
    got = [(r.pool, r.line_no, r.turn) for r in corpus.balanced_sample(rows, 90).orderBy("turn", "pool").collect()]
    black, white = [k for k in range(200) if k % 5], [k for k in range(200) if not k % 5]
    want = [x for t in range(200) for x in ([("black", black[t], t + 1)] if t < len(black) else []) + ([("white", white[t], t + 1)] if t < len(white) else [])][:90]
    assert got == want
    for df in (corpus.balanced_sample(rows, 10), corpus.sample_examples(rows, 5, 20)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    drawn = corpus.sample_examples(rows, 7, 20).collect()
    assert len(drawn) == 7 and all((r.line_no in black[:20]) or (r.line_no in white[:20]) for r in drawn)


def test_inserts_upserts_and_removals(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "a int, b string, seq int")
    table, new = make((1, "x", 0)), make((1, "y", 1), (2, "z", 3), (2, "w", 2), (3, None, 4))
    assert {tuple(r) for r in corpus.fresh_rows(table, new, ["a"], "seq").collect()} == {(2, "w", 2), (3, None, 4)}
    assert tuple(corpus.insert_ignore(table, new, ["a"], "seq").first()) == (2, 2)
    assert {tuple(r) for r in corpus.upsert(table, new, ["a"], "seq").collect()} == {(1, "y", 1), (2, "z", 3), (3, None, 4)}
    assert {r.a for r in corpus.remove(new, table, ["a"]).collect()} == {2, 3}


def test_review_reports(spark, tmp_path):
    import json

    from tidegate.operators import review

    make = lambda rows: spark.createDataFrame(rows, "request_id string, has_violation boolean, confidence double, source string, text string")
    rows = [(f"v{k}", True, 0.4 + k / 100, "s", None) for k in range(7)] + [("s0", False, 0.42, "s", None)]
    lost, judged = make(rows), make([(*r[:4], "text") for r in rows])
    verdicts = spark.createDataFrame([(f"v{k}", True) for k in range(7)] + [("s0", True)], "request_id string, is_violation boolean")
    run = lambda sample, v: review.report(sample, v, logs.band_stats(sample)).first()
    r = run(lost, None)
    assert (r["mode"], r.skipped_reason, r.sampled, r.reviewed, r.action) == ("statistical", "llm_unavailable", 0, 0, None)
    r = run(lost.where("false"), verdicts)
    assert (r["mode"], r.skipped_reason, r.sampled, r.action) == ("statistical", "no_samples", 0, None)
    r = run(lost, verdicts)
    assert (r["mode"], r.skipped_reason, r.sampled, r.text_missing, r.reviewed, r.consistent_rate) == ("statistical", "text_unavailable", 8, 8, 0, None)
    assert (r.action, r.watched) == ("watch", "confidence_high")
    assert run(lost.where("request_id IN ('v1', 's0')"), verdicts).action is None
    r = run(judged.union(lost.limit(1)), verdicts)
    assert (r["mode"], r.skipped_reason, r.sampled, r.text_missing, r.reviewed, r.missed, r.action, r.confidence_high) == ("full", None, 9, 1, 8, 1, "raise_high", 0.8)
    path = review.write_report(review.report(judged, verdicts, logs.band_stats(judged)), str(tmp_path), "2024-01-01T00:00:00")
    (part,) = (tmp_path / "2024-01-01T00-00-00.json").glob("part-*.json")
    assert path.endswith("2024-01-01T00-00-00.json") and json.loads(part.read_text())["reviewed"] == 8


def test_rate_limit_counts_admitted_only(spark):
    rng = random.Random(1)
    rows = [(u, e, round(rng.random() * 300, 3)) for e, u in enumerate(rng.choices([1, 2, 3], [8, 1, 1], k=400))]
    d = replace(DEFAULTS, rate_limit=5, rate_window_s=20.0)
    want, seen = {}, {}
    for u, e, t in sorted(rows, key=lambda r: (r[2], r[1])):
        q = seen.setdefault(u, deque())
        while q and t - q[0] > 20:
            q.popleft()
        want[e] = len(q) < 5
        if want[e]:
            q.append(t)
    got = caches.rate_limit(spark.createDataFrame(rows, "user_id long, event_id long, t double"), d)
    assert {r.event_id: r.admitted for r in got.collect()} == want


def test_cache_and_breaker_replay(spark):
    rng = random.Random(5)
    rows = [("a", k, float(k), rng.choice(["get", "put"]), str(rng.randrange(8))) for k in range(300)]
    got = {r.seq: r.hit for r in caches.cache_replay(spark.createDataFrame(rows, "cache string, seq long, t double, op string, key string"), 4, 30.0).collect()}
    held = OrderedDict()
    for _, seq, t, op, key in rows:
        if op == "get":
            hit = key in held and t - held[key] <= 30
            if hit:
                held.move_to_end(key)
            else:
                held.pop(key, None)
            assert got[seq] == hit
        else:
            held[key] = t
            held.move_to_end(key)
            if len(held) > 4:
                held.popitem(last=False)
    calls = [("p", float(t), ok) for t, ok in [(0, True), (1, False), (2, False), (3, False), (4, True), (34, False), (35, True), (70, True), (71, False)]]
    states = [r.state for r in caches.circuit_replay(spark.createDataFrame(calls, "provider string, t double, ok boolean")).orderBy("t").collect()]
    assert states == ["closed"] * 4 + ["open", "half_open", "open", "half_open", "closed"]
    reqs = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 5.0), ("k", 3, 20.0), ("j", 4, 6.0)], "key string, event_id long, t double")
    assert {r.event_id: r.cached for r in caches.first_within(reqs, 10.0).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_light_model_equals_numpy(spark):
    import numpy as np

    from tidegate.functions.hashing import _fnv

    table = np.random.default_rng(0).normal(size=(64, 3)).round(3)
    weights = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(table)], "bucket int, embedding array<double>")
    linear, bias = [[0.3, -0.2, 0.5], [-0.4, 0.9, 0.1]], [0.1, -0.2]
    texts = [(1, "abca"), (2, ""), (3, None), (4, "漢é")]
    got = {r.request_id: r for r in semantic.light_model(spark.createDataFrame(texts, TEXTS), weights, linear, bias, 64).collect()}
    for i, t in texts:
        grams = []
        for ch in t or "":
            p = f"<{ch}>"
            grams += [f"w:{ch}"] + [p[k : k + n] for n in range(3, 7) for k in range(len(p) - n + 1)]
        x = table[[int(b) for b in _fnv([g.encode() for g in grams]) % np.uint64(64)]].mean(axis=0) if grams else np.zeros(3)
        z = np.array(linear) @ x + bias
        e = np.exp(z - z.max())
        assert got[i].label == int(z.argmax()) and abs(got[i].score - e[1] / e.sum()) < 1e-9


def test_corpus_helpers(spark):
    rows = spark.createDataFrame([(k, "black" if k % 3 == 0 else "white", f"t{k % 5}", "s", None) for k in range(30)] + [(40, "red", "t", "s", None), (41, "black", " ", "s", None), (42, "white", "", "s", "p.png")], "line_no long, pool string, text string, source string, image_path string")
    ids = {r.line_no: r.id for r in corpus.manifest_ids(rows).collect()}
    assert ids[0] == "black:1" and ids[3] == "black:2" and ids[1] == "white:1" and ids[42] == "white:21" and 40 not in ids and 41 not in ids
    assert [r.pool for r in corpus.balanced_sample(rows.where("line_no < 9"), 8).collect()] == ["black", "white"] * 3 + ["white"] * 2
    assert {r.text for r in corpus.pool_conflicts(rows).collect()} == {f"t{k}" for k in range(5)}
    assert corpus.sample_examples(rows, 4).count() == 4
    table = spark.createDataFrame([("a", 1, 0)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 4, 1)], "k string, v int, at int")
    assert {(r.k, r.v) for r in corpus.upsert(table, new, ["k"], "at").collect()} == {("a", 3), ("b", 4)}


def test_logs_pages_are_checked_and_median_is_the_upper(spark):
    import pytest

    df = spark.createDataFrame([("a", True, 0.1), ("b", False, 0.2), ("c", None, 0.4), ("d", False, 0.9)], "source string, has_violation boolean, confidence double")
    assert logs.band_stats(df).first().median == 0.4
    with pytest.raises(ValueError):
        logs.page(df, 0)


def test_hashing_a_long_token_among_many_short_ones():
    from tests.test_text import fnv
    from tidegate.functions.hashing import _fnv

    data = [b"x" * 200_000, b"", *(str(k).encode() for k in range(20_000))]
    assert _fnv(data).tolist()[:50] == [fnv(d) for d in data[:50]]


def test_a_light_model_on_words(spark):
    texts = spark.createDataFrame([(1, "good words"), (2, "bad"), (3, ""), (4, None)], TEXTS)
    weights = spark.range(64).select(F.col("id").cast("int").alias("bucket"), F.array(F.sin(F.col("id"))).alias("embedding"))
    run = lambda **more: {r.request_id: r.score for r in semantic.light_model(texts, weights, [[1.0], [-1.0]], [0.1, 0.0], 64, **more).collect()}
    words = lambda c: F.split(c, " ")
    by_word, by_letter = run(cut=words), run()
    assert by_word[3] == by_word[4] == by_letter[3] and by_word[1] != by_letter[1]
    again = semantic.light_model(spark.createDataFrame([(1, "words good")], TEXTS), weights, [[1.0], [-1.0]], [0.1, 0.0], 64, cut=words).first().score
    assert abs(again - by_word[1]) < 1e-12


def test_vectors_of_another_length_are_not_added(spark):
    import pytest

    pool = spark.createDataFrame([("black", 1)], "pool string, id int")
    new = spark.createDataFrame([("black", 1, 0, [1.0, 0.0]), ("black", 2, 1, [3.0, 4.0]), ("black", 2, 2, [9.0, 0.0])], "pool string, id int, seq int, embedding array<double>")
    assert [(r.id, r.seq, r.embedding) for r in semantic.add_vectors(pool, new, 2).collect()] == [(2, 1, [0.6, 0.8])]
    with pytest.raises(Exception, match="not 3 components"):
        semantic.add_vectors(pool, new, 3).collect()


def test_nearest_meets_a_pool_tile_by_tile(monkeypatch):
    """The nearest over many tiles, ties included, are those of one sort, and no matrix is wider than a tile."""
    rng = np.random.default_rng(2)
    q, p = (rng.integers(1, 4, (n, 3)).astype(float) for n in (40, 900))
    ids = rng.permutation(900)
    monkeypatch.setattr(semantic, "TILE", 64)
    row, col, score, rank = semantic._nearest(np.arange(40), q, ids, p, 5, True)
    for i in range(40):
        want = sorted((c for c in range(900) if ids[c] != i), key=lambda c: (-round(float(q[i] @ p[c]), 9), -ids[c]))[:5]
        assert col[row == i].tolist() == want and rank[row == i].tolist() == [1, 2, 3, 4, 5]


def test_a_large_pool_hands_on_k_rows_a_part(spark):
    """What the last window sorts doesn't grow with the number of the pool's blocks."""
    rng = random.Random(1)
    pools = spark.createDataFrame([(k, "black", "c", [rng.gauss(0, 1), rng.gauss(0, 1)]) for k in range(3 * semantic.BLOCK)], "vec_id long, pool string, category string, embedding array<double>").coalesce(1)
    top = semantic.vector_topk(pools.where("vec_id < 50").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("query")), pools, 4, True, small=0)
    top.collect()
    plan = top._jdf.queryExecution().executedPlan()
    assert "Cartesian" in plan.toString() and top.count() == 200


def test_rerank_queries_ask_once(spark, monkeypatch):
    """The neighbours that a query uses twice come from one retrieval."""
    kept = []
    monkeypatch.setattr(queries, "checkpoint", lambda df: kept.append(df) or df)
    for name in ("rerank_responses", "rerank_confidence", "override_application"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns
    assert len(kept) == 3
