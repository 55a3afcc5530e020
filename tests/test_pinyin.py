import pyarrow as pa

from tidegate.operators import keywords, pinyin

READINGS = {"捡": "jian", "见": "jian", "闻": "wen", "很": "hen", "多": "duo", "赌": "du", "博": "bo", "网": "wang", "安": "an", "昂": "ang", "全": "quan"}


def hits(spark, words, text):
    known = pinyin.readings(spark.createDataFrame(list(READINGS.items()), "char string, syllable string"))
    lex = spark.createDataFrame([("c", w) for w in words], "category string, word string")
    rows = keywords.keyword_hits(spark.createDataFrame([(1, text)], "request_id long, text string"), lex, known).collect()
    return sorted((r.start, r.end, r.word, r.kind) for r in rows if r.kind.startswith("pinyin"))


def test_sounds(spark):
    assert hits(spark, ["捡闻"], "见闻很多") == [(0, 2, "捡闻", "pinyin_full")]
    assert hits(spark, ["赌博网"], "有dbw推广") == [(1, 4, "赌博网", "pinyin_init")]
    assert hits(spark, ["赌博"], "有db推广 dubo") == [(6, 10, "赌博", "pinyin_full")], "two characters have no initials"
    assert hits(spark, ["安全"], "昂全") == [(0, 2, "安全", "pinyin_fuzzy")]
    assert hits(spark, ["多", "", None], "多duo") == []
    assert hits(spark, ["捡闻"], None) == []
    assert hits(spark, ["捡闻"], "😀 x见闻") == [(3, 5, "捡闻", "pinyin_full")]


def test_homophones_are_one_keyword(spark):
    lines = spark.createDataFrame([(1, "捡闻", "x"), (2, "见闻", "x"), (3, "见闻", "y")], "line_no long, line string, category string")
    said = pinyin.spoken(READINGS)
    assert {(r.category, r.line_no) for r in keywords.preprocess_keywords(lines, said).collect()} == {("x", 1), ("y", 3)}
    assert {(r.category, r.line_no) for r in keywords.preprocess_keywords(lines).collect()} == {("x", 1), ("x", 2), ("y", 3)}
    more = spark.createDataFrame([(1, "捡闻+赌博", "x"), (2, "见 闻 + 独博", "x"), (3, "見聞", "x"), (4, None, "x"), (5, " + ", "x")], "line_no long, line string, category string")
    known = READINGS | {"独": "du"}
    assert [(r.line_no, r.match_type) for r in keywords.preprocess_keywords(more, pinyin.spoken(known)).orderBy("line_no").collect()] == [(1, "and"), (3, "word")]


def test_a_scan_holds_a_piece_of_what_it_finds_whatever_the_batch():
    batch = pa.RecordBatch.from_pydict({"request_id": list(range(3000)), "text": ["x", None, ""] * 1000})
    run = keywords._scanner(lambda: 100, lambda made, i, text: ((i, text, None) for _ in range(made)), "request_id long, word string, start int")
    sizes = [b.num_rows for b in run(iter([batch, batch]))]
    assert sum(sizes) == 200_000 and max(sizes) <= keywords.HITS_AT_ONCE
