import random
import re
import warnings

import pytest
from pyspark.sql import functions as F

from tidegate.functions import patterns
from tidegate.operators import keywords

RULE = "id long, category string, pattern string, action string, note string, is_active boolean"
PIECES = ["a", "b", "c", "A", "K", "k", "s", "ſ", "é", "赌", "聊", r"\x41", r"\.", ".", "[ab]", "[]a]", "[^a]", "[a-c]", r"\d", r"\w", "İ", "ı", "σ", "Σ", "ς", r"\b", "^", "$", "ab", "Ab", "bc", r"\012"]


def expression(rng, depth=0):
    r = rng.random()
    inner = lambda: expression(rng, depth + 1)
    if depth > 3 or r < 0.35:
        return rng.choice(PIECES)
    if r < 0.6:
        return inner() + inner()
    if r < 0.7:
        return f"(?:{inner()}|{inner()})"
    if r < 0.78:
        return f"({inner()})"
    if r < 0.9:
        return f"(?:{inner()})" + rng.choice(["?", "*", "+", "{2}", "{0,2}", "{1,3}", "??", "+?", "*+"])
    return rng.choice(["(?=%s)", "(?!%s)", "(?i:%s)", "(?>%s)", "(?<=a)%s", "(?x: %s )"]) % inner()


def test_no_match_without_what_is_required():
    warnings.simplefilter("ignore")
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcABCkKKsSſ赌聊éÉİıσΣς. 1\n]") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    matched = pruned = told = 0
    for _ in range(2500):
        pattern = rng.choice(["", "", "(?i)", "(?s)"]) + expression(rng)
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        clauses = patterns.required(pattern)
        told += bool(clauses)
        for t in rng.sample(texts, 60):
            held = patterns.holds(patterns.fold(t), clauses)
            pruned += not held
            if compiled.search(t):
                matched += 1
                assert held, (pattern, t, clauses)
    assert matched > 10_000 and pruned > 10_000 and told > 500


@pytest.mark.parametrize(
    "pattern,clauses",
    [
        (r"\x41bc", [["abc"]]), (r"[]ab]cd", [["]cd", "acd", "bcd"]]), (r"foo\012bar", [["foo\nbar"]]), ("(?:a|b)c", [["ac", "bc"]]), ("colou?r", [["color", "colour"]]),
        ("idiot[a-z ]{0,3}the", [["idiot"], ["the"]]), ("(cat|dog)s? bed", [["cat bed", "cats bed", "dog bed", "dogs bed"]]), ("(?i:Foo)Bar", [["foobar"]]), ("[0-9]{13,16}", []), ("加我|裸聊", [["加我", "裸聊"]]),
        ("a.b", []), ("(?:long|.)x", []), ("(?:abc.*|def+)g", [["abc", "deg", "de"]]), ("(?x) a b # c", [["ab"]]), (r"(\w+) \1", []), ("赌", [["赌"]]),
    ],
)
def test_required(pattern, clauses):
    got = sorted(sorted(c) for c in patterns.required(pattern))
    if pattern == "(?:abc.*|def+)g":
        assert got and all(any(s in t for s in c) for c in got for t in ("abcxg", "defg", "deffg"))
    else:
        assert got == sorted(sorted(c) for c in clauses)


def test_rules_are_posted_under_their_rarest_string():
    rows = [(k, "", f"word{k}[a-z ]{{0,3}}the", [frozenset([f"word{k}"]), frozenset(["the"])]) for k in range(500)]
    r = keywords.Rules(rows, {"the": 1000})
    assert len(r.posted) == 500 and all(len(p) == 1 for p in r.posted)
    assert r.candidates("the word7 and the") == [7, ]
    assert r.candidates("the the the") == []
    assert list(r.matches("a word7 the b"))[0][0] == 7
    anything = keywords.Rules([(1, "", ".", []), (2, "", "xy", [frozenset(["xy"])])])
    assert anything.candidates("q") == [0] and anything.candidates("aXY") == [0, 1]


def test_violations_equal_all_expressions_on_all_texts(spark):
    warnings.simplefilter("ignore")
    rng = random.Random(9)
    rules = []
    while len(rules) < 120:
        p = expression(rng) + rng.choice(["", "bc", "赌聊"])
        try:
            re.compile(p)
            rules.append((len(rules), "", p, "violate", None, True))
        except re.error:
            pass
    texts = [(k, "".join(rng.choice("abcABCkKſ赌聊éİı. 1\n]") for _ in range(rng.randint(1, 14)))) for k in range(200)]
    got = {(r.request_id, r.rule_id, r.start, r.end) for r in keywords.regex_violate(spark.createDataFrame(texts, "request_id long, text string").repartition(3), spark.createDataFrame(rules, RULE)).collect()}
    assert got == {(i, k, m.start(), m.end()) for i, t in texts for k, _, p, *_ in rules if (m := re.search(p, t))}


def test_lists_and_lookups_of_strings(spark):
    rules = spark.createDataFrame([(1, "", "MIT (?:License|Licence)", "exempt", None, True), (2, "", "idiot.{0,3}the", "violate", None, True), (3, "", "(", "violate", None, True), (4, "", None, "violate", None, True)], RULE)
    found = {r.id: r.x for r in rules.select("id", patterns.required_literals(F.col("pattern")).alias("x")).collect()}
    assert found == {1: [["mit licence", "mit license"]], 2: [["idiot"], ["the"]], 3: None, 4: None}
    good = rules.where("id < 3")
    assert {r.phrase: list(r.rule_ids) for r in keywords.phrase_index(good).collect()} == {"mit licence": [1], "mit license": [1], "idiot": [2], "the": [2]}
    said = spark.createDataFrame([(7, "the"), (7, "idiot"), (8, "none")], "request_id long, phrase string")
    assert [tuple(r) for r in keywords.rules_for_phrases(good, said).collect()] == [(7, 2)]
    with pytest.raises(ValueError, match="rules of"):
        keywords.active_rules(good, "exempt", "violate", most_chars=10)
