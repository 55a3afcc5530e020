import random

from tidegate.operators import asof


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_equals_a_scan(spark):
    rng = random.Random(1)
    left = [(k, rng.choice("aaaab"), rng.choice([None, *range(40)])) for k in range(300)] + [(300, None, 5)]
    right = [(k, rng.choice("abc"), rng.choice([None, *range(40)])) for k in range(60)] + [(60, None, 1)]
    a, b = spark.createDataFrame(left, "id int, key string, t int"), spark.createDataFrame(right, "seq int, key string, t int").select("t", "seq", "key")
    for strict in (False, True):
        got = {r.id: (r.found.t, r.found.seq) if r.found else None for r in asof.asof(a, b, ["key"], "t", slices=7, strict=strict).collect()}
        want = {i: max(((u, s) for s, x, u in right if x == k and k is not None and u is not None and t is not None and (u < t if strict else u <= t)), default=None) for i, k, t in left}
        assert got == want and len(got) == 301
    alone = {r.id: r.found.seq if r.found else None for r in asof.asof(a, b, [], "t", slices=3).collect()}
    assert alone == {i: max(((u, s) for s, _, u in right if u is not None and t is not None and u <= t), default=(0, None))[1] for i, _, t in left}
    text = plan(asof.asof(a, b, ["key"], "t"))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_asof_without_rows_or_with_one_time(spark):
    a, b = spark.createDataFrame([(1, "a", 5), (2, "a", 5)], "id int, key string, t int"), spark.createDataFrame([("a", 5, 9)], "key string, t int, v int")
    assert [r.found.v for r in asof.asof(a, b, ["key"], "t").collect()] == [9, 9]
    assert [r.found for r in asof.asof(a, b.where("false"), ["key"], "t").collect()] == [None, None]
    assert asof.asof(a.where("false"), b, ["key"], "t").collect() == []


def test_lists_change_over_time(spark):
    log = [
        (1, 1, "add", "x", "black"), (1, 2, "add", "y", "white"), (5, 3, "remove", "x", None), (7, 4, "add", "x", "white"), (10, 5, "replace", "z", "black"), (10, 5, "replace", "z", "white"), (10, 5, "replace", "x", "black"),
        (12, 6, "invalidate", None, None), (14, 7, "add", "y", "black"), (14, 8, "remove", "y", None), (16, 10, "invalidate", None, None), (16, 9, "add", "x", "black"), (16, 11, "add", "y", "white"),
    ]
    changes = spark.createDataFrame(log, "ts int, seq int, op string, hash string, color string")

    def state(t, h):
        black, white = set(), set()
        for at, _, op, x, color in sorted(log, key=lambda r: (r[0], r[1])):
            if at > t:
                break
            if op == "invalidate" or op == "replace" and (at, "done") not in white:
                if op == "replace":
                    black, white = {r[3] for r in log if r[0] == at and r[2] == "replace" and r[4] == "black"}, {r[3] for r in log if r[0] == at and r[2] == "replace" and r[4] == "white"} | {(at, "done")}
                else:
                    black, white = set(), set()
            if op == "add":
                (black if color == "black" else white).add(x)
                (white if color == "black" else black).discard(x)
            if op == "remove":
                black.discard(x)
                white.discard(x)
        return "black" if h in black else "white" if h in white else None

    asked = [(f"{t}{h}", h, t) for t in range(19) for h in "xyzq"]
    got = {r.request_id: r.verdict for r in asof.permanent_list_at(spark.createDataFrame(asked, "request_id string, hash string, ts int"), changes).collect()}
    assert got == {i: state(t, h) for i, h, t in asked}
    assert got["0x"] is None and got["1x"] == "black" and got["10z"] == "black" and got["13x"] is None
