"""The order of decision, request by request, and rows that a stage can't take."""

import pytest
from pyspark.sql import functions as F

from tidegate.functions import text as T
from tidegate.plans import errors, funnel

NEAR = [1.0, 0.0]


@pytest.fixture
def world(spark):
    pools = spark.createDataFrame([(k, "black", "abuse", [1.0, 0.1 * (k % 5)]) for k in range(1000, 1005)] + [(k, "white", "normal", [0.0, 1.0]) for k in range(2000, 2005)], "vec_id long, pool string, category string, embedding array<double>")
    words = spark.createDataFrame([("c", "idiot"), ("d", "moron")], "category string, word string")
    rules = spark.createDataFrame([(1, "", "no idiot", "exempt", "mild", True), (2, "e", "card [0-9]+", "violate", None, True)], "id long, category string, pattern string, action string, note string, is_active boolean")
    verdicts = spark.createDataFrame([], "request_id long, is_violation boolean, category string, confidence double")
    listed = spark.createDataFrame([], "hash string, color string")
    return dict(pools=pools, words=words, rules=rules, verdicts=verdicts, listed=listed)


def run(spark, world, requests, queries=(), **more):
    r = spark.createDataFrame([(*x, *[False] * (4 - len(x))) for x in requests], "request_id long, text string, key_tier string, skip_llm boolean")
    q = spark.createDataFrame(list(queries), "request_id long, query array<double>")
    return {x.request_id: x for x in funnel.audit(r, q, **(world | more)).collect()}


def decision(x):
    return x.tier, x.has_violation, round(x.confidence, 6) if x.confidence is not None else None, x.category, x.source


def test_a_text_without_risk_passes_whatever_lies_near_it(spark, world):
    got = run(spark, world, [(1, "plain harmless text", "full"), (2, "plain", "standard"), (3, None, "full"), (4, "no idiot here", "full")], [(1, NEAR), (4, NEAR)])
    for k in (1, 2, 3, 4):
        assert decision(got[k]) == (None, False, 0.0, None, "basic_rules_pass")
    assert got[1].detail.hits == [] and got[2].detail is None and got[3].text_hash is None
    assert [h.word for h in got[4].detail.regex_filtered] == ["idiot"] and got[4].detail.semantic is None


def test_tiers_verdicts_and_no_answer(spark, world):
    q = [(1, NEAR), (2, [0.0, 1.0]), (3, [0.75, 0.7]), (4, [0.75, 0.7]), (5, [0.75, 0.7]), (6, [0.75, 0.7])]
    verdicts = spark.createDataFrame([(3, True, None, 0.6), (4, False, "z", None), (5, True, "z", 0.9), (9, True, "z", 0.9)], "request_id long, is_violation boolean, category string, confidence double")
    got = run(spark, world, [(1, "idiot", "full"), (2, "idiot", "full"), (3, "idiot", "full"), (4, "idiot", "full"), (5, "idiot", "full", True), (6, "moron", "full"), (7, "idiot moron", "full"), (8, "IDIOT", "full"), (9, "card 12", "full")], q, verdicts=verdicts)
    assert decision(got[1])[:2] == ("violation", True) and got[1].category == "abuse" and got[1].source == "semantic"
    assert decision(got[2])[:2] == ("safe", False) and got[2].category is None
    sem = got[6].confidence
    assert got[6].tier == "llm" and got[6].source == "semantic" and 0.35 <= sem <= 0.75
    assert decision(got[3]) == ("llm", True, round(0.6 * 0.6 + 0.4 * sem, 6), "abuse", "llm") and got[3].detail.llm.confidence == 0.6
    assert decision(got[4]) == ("llm", False, round(sem, 6), "z", "llm")
    assert got[5].source == "semantic" and got[5].detail.llm is None, "skip_llm takes no verdict"
    assert decision(got[7]) == (None, True, 0.0, "c", "semantic") and got[7].degraded == "semantic:embedding_error"
    assert decision(got[8]) == (None, False, 0.0, None, "semantic"), "another case is no strong signal"
    assert decision(got[9]) == (None, True, 0.0, "e", "semantic"), "a violating rule is"


def test_lists_come_first_and_blank_texts_are_not_looked_up(spark, world):
    h = lambda t: spark.range(1).select(T.text_hash(F.lit(t)).alias("h")).first().h
    listed = spark.createDataFrame([(h("idiot"), "white"), (h("plain"), "black"), (h("plain"), "white"), (h(""), "black"), ("frame", "black")], "hash string, color string")
    frames = spark.createDataFrame([(4, True, "frame", 0, 2), (5, True, "other", 0, 1), (6, False, None, 0, None)], "request_id long, whitelisted boolean, hash string, frame int, distance int")
    got = run(spark, world, [(1, "idiot", "full"), (2, "plain", "full"), (3, "  ", "full"), (4, "idiot", "full"), (5, "x", "full"), (6, "", "full")], [(1, NEAR)], listed=listed, frames=frames)
    assert decision(got[1]) == (None, False, 0.0, None, "permanent_list") and got[1].detail is None
    assert decision(got[2]) == (None, True, 0.0, None, "permanent_list")
    assert got[3].source == "basic_rules_pass"
    assert decision(got[4]) == (None, True, 0.0, None, "permanent_list"), "black before white, text or frame"
    assert got[5].source == "basic_rules_pass" and [tuple(f) for f in got[5].detail.image_whitelist] == [(0, True, 1)]
    assert decision(got[6]) == (None, False, 0.0, None, "semantic") and got[6].degraded == "semantic:embedding_error"


def test_overrides_light_model_and_refusal(spark, world):
    own = spark.createDataFrame([(1, 0.99, 0.0, 0.0, 0.999), (2, 0.5, None, None, None)], "request_id long, semantic_threshold double, margin_w double, confidence_low double, confidence_high double")
    light = spark.createDataFrame([(3, True), (4, False)], "request_id long, violation boolean")
    got = run(spark, world, [(1, "idiot", "full"), (2, "idiot", "standard"), (3, "plain", "full"), (4, "plain", "full")], [(1, [0.2, 0.9])], overrides=own, light=light)
    assert got[1].tier == "llm"
    assert got[2].error == "overrides_not_permitted" and got[2].has_violation is None and got[2].source is None
    assert decision(got[3]) == (None, True, 0.0, None, "semantic") and got[3].detail.light_model is True
    assert got[4].source == "basic_rules_pass"


def test_rows_that_a_stage_cannot_take_do_not_stop_the_others(spark, world):
    q = [(1, [1.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [0.75, 0.7]), (5, [0.75, 0.7]), (6, [0.75, 0.7])]
    replies = spark.createDataFrame([(4, '{"is_violation": true, "confidence": 1.0}'), (5, "not json"), (6, None)], "request_id long, reply string")
    got = run(spark, world, [(k, "idiot", "full") for k in range(1, 7)] + [(7, "见闻", "full")], q, verdicts=replies, known={"见": None, "捡": "jian"})
    assert [got[k].error for k in (1, 2, 3)] == ["semantic: not 2 components", "semantic: a component is null", "semantic: a component is not finite"]
    assert all(got[k].degraded == "semantic:semantic_exception" and got[k].has_violation and got[k].confidence == 0.0 for k in (1, 2, 3))
    assert got[4].source == "llm" and got[4].error is None
    assert got[5].source == "semantic" and got[5].error == "llm: no verdict in the reply"
    assert got[6].source == "semantic" and got[6].error is None


def test_a_text_on_which_the_scan_breaks_off_is_safe_with_an_error(spark, world):
    got = run(spark, world, [(1, "idiot", "full"), (2, "idiot 见闻", "full"), (3, "idiot 见闻", "standard")], known={"见": None, "捡": "jian"}, words=spark.createDataFrame([("c", "idiot"), ("c", "捡捡")], "category string, word string"))
    assert got[1].error is None and got[1].has_violation
    assert got[2].error.startswith("scan: TypeError") and decision(got[2]) == (None, False, 0.0, None, "semantic") and got[2].degraded.startswith("error: TypeError")
    assert got[3].degraded is None and got[3].error.startswith("scan: ")


def test_empty_pools_and_tables(spark, world):
    none = world["pools"].where("false")
    assert run(spark, world, [(1, "idiot", "full")], [(1, NEAR)], pools=none)[1].degraded == "semantic:empty_black_pool"
    assert run(spark, world, [(1, "idiot", "full")], [(1, NEAR)], pools=world["pools"].where("pool = 'black'"))[1].degraded == "semantic:empty_white_pool"
    assert run(spark, world, []) == {}


def test_texts_are_scanned_once_and_only_open_requests_are_retrieved(spark, world, monkeypatch):
    seen = []
    from tidegate.operators import keywords, semantic

    monkeypatch.setattr(keywords, "judged_texts", lambda *a, f=keywords.judged_texts, **k: seen.append("scan") or f(*a, **k))
    monkeypatch.setattr(semantic, "vector_topk", lambda q, *a, f=semantic.vector_topk, **k: seen.append(sorted(r.request_id for r in q.collect())) or f(q, *a, **k))
    run(spark, world, [(1, "idiot", "full"), (2, "plain", "full"), (3, "moron", "full")], [(1, NEAR), (2, NEAR), (3, [1.0]), (4, NEAR)])
    assert seen == ["scan", [1]]


def test_split_rows(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1), (4, 100)], "request_id long, v int")
    good, bad = errors.split_rows(rows, "s", {"negative": F.col("v") < 0, "odd": F.col("v") % 2 == 1, "large": F.col("v") > 50})
    assert sorted(r.request_id for r in good.collect()) == [2]
    assert {tuple(r) for r in bad.collect()} == {(1, "s", "odd"), (3, "s", "negative"), (4, "s", "large")}
