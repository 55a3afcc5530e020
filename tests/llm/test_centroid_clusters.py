import hashlib

import numpy as np
import pytest

from tidegate.llm import centroid_clusters as m

SCHEMA = "vec_id long, embedding array<double>, id string, cluster string, n long"


def brute(rows, k=16, rounds=3, dim=64):
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    good = [(i, [max(-m.MOST, min(m.MOST, x)) for x in v]) for i, v in good]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:k]
    c = [list(v) for _, v in first]
    if not c:
        return []
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in good:
            own.setdefault(best(v)[1], []).append(v)
        for j, vs in own.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    near = [(i, *best(v)) for i, v in good]
    per = {}
    for _, d, j in near:
        per[j] = per.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, j, d, fits(per[j]), fits(sum(per.values())), sha[j]) for i, d, j in near), key=str)


def run(spark, rows, **more):
    return sorted((tuple(r) for r in m.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()), key=str)


@pytest.mark.parametrize("case", ["even", "clusters", "hot vector", "coarse"])
def test_equals_a_scan_of_all(spark, monkeypatch, case):
    monkeypatch.setattr(m, "TREE", 150)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8))
    if case == "clusters":
        x = 0.02 * x + 10 * rng.normal(size=(20, 8))[rng.integers(20, size=700)]
    if case == "hot vector":
        x[rng.random(700) < 0.4] = x[3]
    if case == "coarse":
        x = np.round(x) / 64  # many ties
    rows = [(i, v.tolist(), "a", "b", 1) for i, v in enumerate(x)]
    assert run(spark, rows, dim=8) == brute(rows, dim=8)


def test_nodes_hold_their_rows_and_pairs_are_dropped(monkeypatch):
    rng = np.random.default_rng(6)
    middle = 2000 * rng.normal(size=(24, 64))
    x = np.floor(middle[rng.integers(24, size=2000)] + 20 * rng.normal(size=(2000, 64))).astype(np.int64)
    t = m.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(2000))
    for b, e, c, r, own in zip(t.begin, t.end, t.centre, t.radius, t.children, strict=True):
        rows = t.order[b:e]
        assert c in rows and np.sqrt(((x[rows] - x[c]) ** 2).sum(1)).max() <= r + 1e-6
        assert not own or sum(t.end[k] - t.begin[k] for k in own) == e - b
    c = np.floor(middle[:16]).astype(np.int64)
    seen = []
    monkeypatch.setattr(m, "exact", lambda p, q, f=m.exact: seen.append(len(p) * len(q)) or f(p, q))
    got = np.empty(2000, dtype=np.int64)
    for rows, which in m.assign(t, x, c, m.CoverTree(c, m.FEW)):
        got[rows] = which
    assert (got == ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(seen) < 2000 * 16 / 3


def test_nulls_lengths_ties_repeats_large_numbers_and_empty(spark):
    rng = np.random.default_rng(7)
    v = lambda: rng.normal(size=4).tolist()
    rows = [(k, v(), "a", "b", 1) for k in range(30)] + [(5, v(), "a", "b", 1), (5, [0.0] * 4, "a", "b", 1)]
    rows += [(100, None, "a", "b", 1), (101, [1.0, None, 1.0, 1.0], "a", "b", 1), (102, [float("nan")] * 4, "a", "b", 1), (103, [float("inf")] * 4, "a", "b", 1), (104, [], "a", "b", 1), (105, [1.0] * 5, "a", "b", 1)]
    rows += [(None, v(), "a", "b", 1), (2**60 + 1, v(), "a", "b", 1)] + [(7, [0.5] * 4, "a", "b", 1)] * 3
    assert run(spark, rows, dim=4) == brute(rows, dim=4)
    few = rows[:3]
    assert run(spark, few, dim=4) == brute(few, dim=4)
    assert run(spark, [], dim=4) == run(spark, [(None, v(), "", "", 0)], dim=4) == []
    big = [(k, [1e5 * k, -3e6, 1e30 * (k % 2), 1.0], "a", "b", 1) for k in range(40)]
    assert run(spark, big, dim=4, k=3) == brute(big, dim=4, k=3)


def test_a_common_vector_is_one_node_and_balls_lie_apart():
    rng = np.random.default_rng(9)
    x = rng.integers(-60, 60, size=(2000, 64))
    x[rng.random(2000) < 0.35] = x[5]
    t = m.CoverTree(x)
    common = [k for k, (b, e, r) in enumerate(zip(t.begin, t.end, t.radius, strict=True)) if r == 0 and e - b > 500]
    assert len(common) == 1
    seen = []
    m_exact = m.exact
    try:
        m.exact = lambda p, q: seen.append(len(p)) or m_exact(p, q)
        c = np.unique(x, axis=0)[::60][:16]
        got = np.empty(2000, dtype=np.int64)
        for rows, which in m.assign(t, x, c, m.CoverTree(c, m.FEW)):
            got[rows] = which
    finally:
        m.exact = m_exact
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (got == d.argmin(1)).all() and sum(seen) < 1500
    y = np.floor(3000 * rng.normal(size=(20, 8))[rng.integers(20, size=1500)] + 30 * rng.normal(size=(1500, 8))).astype(np.int64)
    t = m.CoverTree(y)
    for own, reach in zip(t.children, t.radius, strict=True):
        for k in own:
            assert t.radius[k] <= reach + 1e-6
    assert max(map(len, t.children)) > 3 and sum(not k for k in t.children) > 10
