from pyspark.sql import functions as F

import corpus_pipeline as m
from tidegate.llm import decontaminate
from tidegate.llm.common import align

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_works_on_all_that_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = []
    for name, stage in m.STAGES:
        docs = m.checkpoint(stage(spark, docs, SF))
        if name != "best-fit packing":
            assert docs.columns == m.COLUMNS
        left.append(docs)
    quality, lines, near, clean, packed = left
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality.collect()}
    good = [i for i, x in labels.items() if x == (1, 0)]
    assert len(kept.intersection(good)) > 0.97 * len(good)
    rude = [i for i, t in rows.items() if sum(w in t for w in ("idiot", "moron", "scum")) > 1]
    assert len(rude) > 20 and len(kept.intersection(rude)) < 0.5 * len(rude), "few rows to learn from"
    after = {r.doc_id: r for r in lines.collect()}
    assert set(after) == kept and all(r.n_chars == len(r.text) for r in after.values())
    assert any(len(after[i].text) < len(rows[i]) for i in kept)
    texts = [r.text for r in near.collect()]
    assert len(texts) == len(set(texts)) < len(after)
    ids = {r.doc_id for r in near.collect()}
    seen: dict = {}
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(w := decontaminate.codes_of(r.text, seen)) > 1]
    held = set()
    for i in ids:
        codes = decontaminate.codes_of(after[i].text, seen)
        for words in items:
            if len(set(words.tolist()).intersection(codes.tolist())) >= 0.8 * len(set(words.tolist())):
                _, matches, _, _, a, b = align(words, codes)
                if matches >= 0.8 * max(len(words), b - a):
                    held.add(i)
    assert {r.doc_id for r in clean.collect()} == ids - held and held
    size = {r.doc_id: len(r.text.encode().split()) for r in clean.collect()}
    got, said = {}, {}
    for r in sorted(packed.collect(), key=lambda r: r.piece):
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
        said[r.doc_id] = said.get(r.doc_id, "") + r.text
    assert got == size
    assert said == {r.doc_id: r.text.lstrip(" \t\n\x0b\x0c\r") for r in clean.collect()}


def test_run_gives_the_stages_result(spark):
    rows = m.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start_word", "n_words", "text", "bin"}


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (None, "a b c", "en", "s", 5), (1, "", "en", "s", 0), (2, "x " * 100, "en", None, 200), (2, "x " * 100, "en", None, 200), (3, "x " * 100, None, "s", 200), (4, "one text of an id", "en", "s", 17), (4, "another text of it", "en", "s", 18), (5, "long words " * 30000, "en", "s", 330000)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, SCHEMA)
        for _, stage in m.STAGES[:4]:
            docs = m.checkpoint(stage(spark, docs.withColumn("id", F.lit("clash")), "/root/testdata/sf0.001"))
        want = [None, None, 1, 2, 4, 4, 5] if data else []
        assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted(want, key=str)
        packed = m.best_fit_packing(spark, docs.withColumn("bin", F.lit("clash")), "").collect()
        assert len([r for r in packed if r.doc_id != 5]) == max(0, len(want) - 1) and len(packed) == len(want) + 58 * bool(data)
