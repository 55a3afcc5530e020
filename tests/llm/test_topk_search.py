import numpy as np
import pytest

from tidegate.llm import topk_search as m

SCHEMA = "vec_id long, embedding array<double>, label int, score long"


def brute(rows, k, scale=64, every=20):
    good = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(scale * x)) for x in v]))
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for m, (j, x) in enumerate(good) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(tuple(r) for r in m.search(df, df.where("vec_id % 20 = 0"), **more).collect())


@pytest.mark.parametrize("case", ["clusters", "uneven norms", "hot vector"])
def test_equals_a_scan_of_all(spark, monkeypatch, case):
    monkeypatch.setattr(m, "BLOCK", 64)
    rng = np.random.default_rng(2)
    n = 1500
    x = rng.normal(size=(n, 12)) + 3 * rng.normal(size=(8, 12))[rng.integers(8, size=n)]
    if case == "uneven norms":
        x *= rng.lognormal(0, 1.5, size=(n, 1))
    if case == "hot vector":
        x[rng.random(n) < 0.4] = x[0]
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    assert run(spark, rows, k=7, rings=4, pivots=16) == brute(rows, 7)


def test_annuli_are_passed_over(spark):
    rng = np.random.default_rng(4)
    centres = 40 * rng.normal(size=(20, 8))
    x = np.concatenate([c + rng.normal(size=(200, 8)) for c in centres]).round(3)
    pivots = m.Pivots(np.floor(64 * centres), 1)
    pivots.edges = [np.zeros(0)] * 20
    v = np.floor(64 * x).astype(np.int64)
    near, d = pivots.nearest(v)
    import pandas as pd

    cells = pd.DataFrame([(p, d[near == p].min(), d[near == p].max(), np.sqrt((v[near == p].astype(float) ** 2).sum(1)).max()) for p in range(20)], columns=["cell", "low", "high", "norm"])
    top = m.bounds(v, pivots, cells)
    s = m.products(v, v)
    for p in range(20):
        assert (s[:, near == p].max(axis=1) <= top[:, p]).all()
    tenth = np.sort(s, axis=1)[:, -10]
    assert (top < tenth[:, None]).mean() > 0.5


def test_nulls_ties_repeats_lengths_and_large_numbers(spark):
    rows = [(k, [float(k % 3), 1.0], 0, 0) for k in range(50)] + [(100, None, 0, 0), (120, [1.0, None], 0, 0), (140, [float("nan"), 1.0], 0, 0), (160, [float("inf"), 1.0], 0, 0), (None, [1.0, 1.0], 0, 0), (180, [], 0, 0), (200, [1.0, 2.0, 3.0], 0, 0), (40, [1.0, 1.0], 0, 0)]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == []
    big = [(k, [1e30 * (k % 2 * 2 - 1), float(k)], 0, 0) for k in range(0, 60, 5)]
    got = run(spark, big)
    assert {s for *_, s in got} == {2**63 - 1, -(2**63)}
    mid = [(k, [1e6 * k, -1e6, 3.0], 0, 0) for k in range(40)]
    assert run(spark, mid) == brute(mid, 20)


def test_rows_that_repeat_an_id_are_all_candidates_and_all_asked(spark):
    rows = [(k, [float(k % 7), 1.0, -float(k % 3)], 0, 0) for k in range(60)]
    rows += [(20, [3.0, 1.0, 0.0], 0, 0), (20, [3.0, 1.0, 0.0], 0, 0), (20, rows[20][1], 0, 0), (5, [9.0, 9.0, 9.0], 0, 0), (5, [9.0, 9.0, 9.0], 0, 0)] + [(7, [8.0, 8.0, 8.0], 0, 0)] * 30
    for k in (3, 20, 200):
        assert run(spark, rows, k=k) == brute(rows, k)
