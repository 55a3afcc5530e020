import random

import numpy as np

from tidegate.llm import license_scan as m
from tidegate.llm.common import WORD, align
from tidegate.llm.license_templates import TEMPLATES

SCHEMA = "doc_id long, text string, license string, x string"


def test_full_edited_and_short_wordings_are_found_with_their_spans(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join("".join(rng.choice("xyzwvk") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for k, (name, text) in enumerate(TEMPLATES):
        words = text.split()
        if len(words) > 40:
            for _ in range(2):
                words[rng.randrange(len(words))] = "zzz"
        rows.append((k, f"{filler(20)}\n{' '.join(words)}\n{filler(30)}", "a", "b"))
        want[k] = name
    rows.append((100, filler(500), "a", "b"))
    got = m.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {}
    for r in got:
        found.setdefault(r.id, {})[r.license] = r
    assert 100 not in found
    for k, name in want.items():
        r = found[k][name]
        text = rows[k][1]
        own = [w for w in WORD.findall(TEMPLATES[k][1].lower())]
        inside = WORD.findall(text[r.start_char : r.end_char].lower())
        assert r.coverage >= 0.9 and len(inside) <= len(own) * 1.1 + 1 and set(inside) & set(own)


def test_equals_an_alignment_with_every_template(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text LIKE '%icen%' OR doc_id % 20 = 0")
    got = {(r.id, r.license) for r in m.scan_licenses(docs).collect() if r.coverage >= 0.9}
    index, want = m.TemplateIndex(TEMPLATES), {}
    for r in docs.collect():
        codes = index.words_of(r.text)[0]
        for name, words in index.templates:
            _, matches, _, _, a, b = align(words, codes)
            if matches >= 0.9 * max(len(words), b - a):
                want.setdefault(r.doc_id, []).append((matches, name))
    assert got == {(d, max(x)[1]) for d, x in want.items()} and len(want) > 10


def test_nulls_empty_long_repeated_rows_and_two_at_once(spark):
    mit, cc = "Released under the MIT License.", "licensed  UNDER cc by-nc 4.0"
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "wörd " * 200000 + mit, "a", "b"), (4, mit + cc, "a", "b"), (4, mit + cc, "a", "b"), (None, "İ " + mit, "a", "b"), (5, "the the the " * 1000, "a", "b")]
    got = sorted((r.id or -1, r.license, r.start_char, r.end_char) for r in m.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect())
    assert (3, "MIT-short", 1000000, 1000000 + len(mit) - 1) in got
    assert [x for x in got if x[0] == 4] == sorted([(4, "MIT-short", 0, 30), (4, "CC-BY-NC-4.0-short", 31, 59)] * 2)
    assert {x[0] for x in got} == {-1, 3, 4}
    assert m.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cut_and_edited_wordings_are_reported_with_their_coverage():
    index = m.TemplateIndex(TEMPLATES)
    rng = random.Random(6)
    for name, text in TEMPLATES:
        words = text.split()
        if len(words) < 40:
            continue
        cut = " ".join(words[: int(0.7 * len(words))])
        found = {x["license"]: x for x in index.scan("Begin here. " + cut + " The end.", 0.5)}
        assert name in found and 0.6 <= found[name]["coverage"] <= 0.75, name
        edited = [("zzz" if rng.random() < 0.12 else w) for w in words]
        found = {x["license"]: x for x in index.scan(" ".join(edited), 0.5)}
        assert name in found and found[name]["coverage"] < 0.98, name


def test_spans_are_those_of_the_text_where_lowering_changes_its_length():
    text = "İİİ Licensed under the MIT License. İ"
    (hit,) = [x for x in m.TemplateIndex(TEMPLATES).scan(text, 0.9)]
    assert text[hit["start_char"] : hit["end_char"]] in ("Licensed under the MIT License", "under the MIT License")


def test_many_seeds_stay_in_a_band():
    assert m.diagonals([5, 1, 9, 30, 31, 1], 10) == [(1, 9), (30, 31)]
    assert all(b - a <= 10 for a, b in m.diagonals(list(range(1000)), 10))
