import numpy as np
import pytest
import xxhash

from tidegate.llm import simhash_dedup as m

SCHEMA = "doc_id long, text string, fp string, component string"


def brute(texts):
    fps = {}
    for i, t in texts.items():
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    comp = {i: i for i in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_equals_brute_force_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    got = {r.id: (r.fingerprint, r.component) for r in m.near_duplicates(docs).collect()}
    assert got == want


def test_nulls_empty_short_repeated_rows_and_extra_columns(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, " \t\n", "x", "y"), (4, "One two", "x", "y"), (5, "one  TWO", "x", "y"), (6, long, "x", "y"), (6, long, "x", "y"), (7, "É a b c", "x", "y"), (None, "lonely words here", "x", "y")]
    got = sorted((r.id or -1, r.fingerprint, r.component) for r in m.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    want = brute({i: t for i, t, *_ in rows if i})
    assert len(got) == len(rows)
    for i, fp, comp in got:
        if i > 0:
            assert (fp, comp) == want[i]
        else:
            assert comp is None
    assert m.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_links_of_a_leaf_and_of_a_tree_equal_all_pairs(dense):
    rng = np.random.default_rng(3)
    pts = rng.integers(0, 1 << 63, size=1500, dtype=np.uint64)
    base = pts[:20] if dense else pts[:400]
    near = base[rng.integers(len(base), size=1500)].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, size=len(near), dtype=np.uint64)
    pts = np.unique(np.concatenate([pts, near]))
    links = m._Links(pts, 3, leaf=32)
    close = np.bitwise_count(pts[:, None] ^ pts[None, :]) <= 3
    comp = np.arange(len(pts))
    while True:
        new = np.where(close, comp[None, :], len(pts)).min(axis=1)
        if (new == comp).all():
            break
        comp = new
    assert [links.find(i) for i in range(len(pts))] == comp.tolist()
    halves = [m._Links(pts, 3, half, 1, leaf=32) for half in (0xFFFFFFFF, 0xFFFFFFFF << 32)]
    for i in range(len(pts)):
        halves[0].join(i, halves[1].find(i))
    assert [halves[0].find(i) for i in range(len(pts))] == comp.tolist()
    tree = m.VantageTree(pts, len(pts), 64, 3)
    leaves, index = tree.route(pts)
    homes = [set(leaves[index == i].tolist()) for i in range(len(pts))]
    assert len(set(leaves.tolist())) > 4
    assert all(homes[i] & homes[j] for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True))
