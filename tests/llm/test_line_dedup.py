import numpy as np

from tidegate.llm import line_dedup as m

SCHEMA = "doc_id long, text string, key string, drop string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(((r.id, r.kept, r.n_lines, r.n_dropped) for r in m.dedup_lines(df, **more).collect()), key=str)


def test_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, "a", "b") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute(rows)
    assert sum(x[3] for x in want) > 50
    assert run(spark, rows) == want


def test_hot_and_other_keys_are_joined_alike(spark, monkeypatch):
    rows = [(r.doc_id, r.text, "a", "b") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(10_000 + k, "a line that is in very many of all documents\nown", "a", "b") for k in range(500)]
    monkeypatch.setattr(m, "MOST_HOT", 20)
    assert run(spark, rows) == brute(rows)


def test_a_full_filter_changes_nothing(spark):
    rows = [(r.doc_id, r.text, "a", "b") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows, most_bits=16, min_docs=2) == brute(rows, min_docs=2)


def test_nulls_empty_long_ties_repeats_and_clashing_columns(spark):
    line = "É  the same long line that many documents hold, once"
    rows = [(k, f"{line if k % 2 else ' ' + line.upper().replace('É', 'É') + chr(9)}\nown {k}", "a", "b") for k in range(8)]
    rows += [(7, rows[7][1], "a", "b"), (None, line, "a", "b"), (20, None, "a", "b"), (21, "", "a", "b"), (22, "\n" * 3, "a", "b"), (23, line + "\n" + "x" * 300000, "a", "b"), (24, f"{line}\n{line}\nz", "a", "b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    got = m.dedup_lines(spark.createDataFrame(rows, SCHEMA), carry=("key", "drop"))
    assert got.columns == ["id", "kept", "n_lines", "n_dropped", "key", "drop"]
    assert {(r["key"], r["drop"]) for r in got.collect()} == {("a", "b")}


def test_no_key_seen_twice_is_missed():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, size=4000, dtype=np.uint64)
    a, b = m.TwiceSeen(18), m.TwiceSeen(18)
    a.add(keys[:2500])
    b.add(keys[2000:])
    b.add(keys[3500:])
    twice = a.twice | b.twice | (a.once & b.once)
    hit = m._test(twice, m._slots(keys, 18))
    assert hit[2000:2500].all() and hit[3500:].all()
    assert hit[:2000].mean() < 0.2
