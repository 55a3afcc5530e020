"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint

BLOCK = 1024  # vectors of an annulus, or queries, that are compared at once
RESULT = "query long, vec_id long, uid long, score long"


def quantize(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec): floor(scale * x) of each component, as a binary of 64-bit integers; only vectors that are whole.

    Vectors that are null or hold a null or a component that isn't finite are left out, as are rows without an id.
    Components beyond +-2**62 are held there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, vecs = [], []
            for i, x in zip(pdf["id"], pdf["x"], strict=True):
                x = np.asarray(x, dtype=np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    vecs.append(np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype("<i8").tobytes())
            yield pd.DataFrame({"id": np.array(ids, dtype=np.int64), "vec": vecs})

    whole = F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull()) & F.col(id_col).isNotNull()
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")).mapInPandas(run, "id long, vec binary")


def matrix(vecs, dim: int) -> np.ndarray:
    """Rows of integers; a shorter vector is filled up with zeros."""
    out = np.zeros((len(vecs), dim), dtype=np.int64)
    for k, v in enumerate(vecs):
        x = np.frombuffer(v, dtype="<i8")
        out[k, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b: in floating point where every sum is an exact integer."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Pivots:
    """Pivots, and the annuli of distance around each: cell = pivot * rings + annulus."""

    def __init__(self, points: np.ndarray, rings: int):
        self.points, self.rings, self.edges = points.astype(np.float64), rings, None

    def distances(self, m: np.ndarray) -> np.ndarray:
        p, x = self.points, m.astype(np.float64)
        return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T))

    def nearest(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(m)
        near = d.argmin(axis=1)
        return near, d[np.arange(len(m)), near]

    def cells(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, d = self.nearest(m)
        ring = np.array([np.searchsorted(self.edges[p], x) for p, x in zip(near, d, strict=True)], dtype=np.int64)
        return near * self.rings + ring, d


def fit_pivots(rows: DataFrame, total: int, dim: int, rings: int, sample: int, most: int) -> Pivots:
    """At most ``most`` pivots, far apart, and annuli of like numbers, fitted on at most ``2 * sample`` vectors chosen by hash."""
    share = F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30))
    some = matrix([r["vec"] for r in rows.where(share).select("vec").limit(2 * sample).collect()], dim)
    some = np.unique(some, axis=0) if len(some) else np.zeros((1, dim), np.int64)
    count = int(min(most, max(2, total // (rings * BLOCK // 4)), len(some)))
    chosen = [0]
    far = np.full(len(some), np.inf)
    while len(chosen) < count:
        far = np.minimum(far, ((some - some[chosen[-1]]).astype(np.float64) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    # one step towards the middle of what is nearest to each
    pivots = Pivots(some[chosen], rings)
    near, _ = pivots.nearest(some)
    pivots = Pivots(np.stack([some[near == k].mean(axis=0) if (near == k).any() else some[c] for k, c in enumerate(chosen)]), rings)
    near, d = pivots.nearest(some)
    pivots.edges = [np.quantile(d[near == k], np.arange(1, rings) / rings) if (near == k).any() else np.zeros(rings - 1) for k in range(count)]
    return pivots


def blocks(rows: DataFrame, pivots: Pivots, dim: int, total: int) -> DataFrame:
    """(cell, low, high, norm, ids, uids, vecs): the index. Annuli of any size, in rows of at most ``BLOCK`` vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, d = pivots.cells(matrix(pdf["vec"], dim))
                yield pd.DataFrame({"cell": cell, "dist": d, "id": pdf["id"], "uid": pdf["uid"], "vec": pdf["vec"]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of cell; a block ends with its cell or when it is full."""
        cell, held = None, []
        for pdf in batches:
            for c, d, i, u, v in zip(pdf["cell"], pdf["dist"], pdf["id"], pdf["uid"], pdf["vec"], strict=True):
                if held and (c != cell or len(held) == BLOCK):
                    yield block(cell, held)
                    held = []
                cell = c
                held.append((d, i, u, v))
        if held:
            yield block(cell, held)

    def block(cell: int, held: list) -> pd.DataFrame:
        m = matrix([v for *_, v in held], dim)
        d = [x for x, *_ in held]
        packed = lambda k: np.array([x[k] for x in held], dtype="<i8").tobytes()
        norm = float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max())
        return pd.DataFrame({"cell": [cell], "low": [min(d)], "high": [max(d)], "norm": [norm], "n": [len(held)], "ids": [packed(1)], "uids": [packed(2)], "vecs": [m.tobytes()]})

    dealt = rows.mapInPandas(run, "cell long, dist double, id long, uid long, vec binary")
    salt = F.pmod(F.xxhash64("uid"), F.lit(max(1, total // (64 * BLOCK))))  # a cell with a third of all vectors is many tasks' work
    dealt = dealt.repartition("cell", salt).sortWithinPartitions("cell", "dist")
    return dealt.mapInPandas(pack, "cell long, low double, high double, norm double, n long, ids binary, uids binary, vecs binary")


def bounds(q: np.ndarray, pivots: Pivots, cells: pd.DataFrame) -> np.ndarray:
    """No vector of a cell has a larger inner product with the query than this.

    q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2, |x| is at most the cell's norm, and |q-x| at least the gap between the
    query's distance to the pivot and the annulus. Nor is q.x larger than |q| |x|.
    """
    d = pivots.distances(q)[:, cells["cell"].to_numpy() // pivots.rings]
    gap = np.maximum(0.0, np.maximum(cells["low"].to_numpy()[None, :] - d, d - cells["high"].to_numpy()[None, :]))
    nq = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None]
    nx = cells["norm"].to_numpy()[None, :]
    top = np.minimum((nq**2 + nx**2 - gap**2) / 2, nq * nx)
    return top + 1e-6 * (1 + nq**2 + nx**2)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, rings: int = 8, sample: int = 8192, pivots: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products, ties to the smaller id.

    Vectors are indexed by nearest pivot and distance to it. Each round a query's next annuli, best bound first,
    are compared in blocks, four times as many as before; a query stops when the next bound is below its k-th
    score. The directory has ``pivots * rings`` rows at most. Vectors that are null or hold a null or non-finite
    component take no part. Rows that repeat an id stand each for itself: all are candidates and, among the queries, asked;
    a query's own row, one row of its id and vector, is no answer of it, another one is. Rows alike in both are compared
    once and counted as often as they are. Vectors of unlike lengths meet as if filled up with zeros. Empty tables give no
    rows; other columns aren't read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = quantize(vectors, id_col, vec_col, scale).groupBy("id", "vec").agg(F.count("*").alias("times"))
    rows = checkpoint(rows.withColumn("uid", F.monotonically_increasing_id()))
    asked = quantize(queries, id_col, vec_col, scale).groupBy("id", "vec").agg(F.count("*").alias("asked"))
    own = rows.select(F.col("id").alias("i"), F.col("vec").alias("v"), F.col("uid").alias("own"), "times")
    asked = asked.join(own, (F.col("id") == F.col("i")) & (F.col("vec") == F.col("v")), "left")
    # the row that a query mustn't find, if its own is the only one
    alone = F.when(F.col("times") == 1, F.col("own")).otherwise(F.lit(-1))
    asked = checkpoint(asked.select("id", "vec", "asked", "own", alone.alias("skip")).withColumn("query", F.monotonically_increasing_id()))
    total, size = rows.agg(F.count("*"), F.max(F.length("vec"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, size // 8, (asked.agg(F.max(F.length("vec"))).first()[0] or 0) // 8)
    index = fit_pivots(rows, total, dim, rings, sample, pivots)
    stored = checkpoint(blocks(rows, index, dim, total))
    cells = stored.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")).toPandas().sort_values("cell", ignore_index=True)
    shared = spark.sparkContext.broadcast((index, cells))

    def plan(first: int, last: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, cells = shared.value
            for pdf in batches:
                for at in range(0, len(pdf), BLOCK):
                    part = pdf.iloc[at : at + BLOCK]
                    if not len(part):
                        continue
                    q = matrix(part["vec"], dim)
                    top = bounds(q, pivots, cells)
                    place = np.argsort(np.argsort(-top, axis=1, kind="stable"), axis=1, kind="stable")
                    least = part["least"].to_numpy(dtype=np.float64, na_value=-np.inf)
                    go = (place >= first) & (place < last) & (top >= least[:, None])
                    names, skips = part["query"].to_numpy(dtype="<i8"), part["skip"].to_numpy(dtype="<i8")
                    out = [(int(cells["cell"][c]), names[w].tobytes(), skips[w].tobytes(), least[w].tobytes(), q[w].tobytes()) for c in np.nonzero(go.any(axis=0))[0] for w in (go[:, c],)]
                    yield pd.DataFrame(out, columns=["cell", "q_names", "q_skips", "q_least", "q_vecs"])

        return run

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, uids, names, skips = (np.frombuffer(x, "<i8") for x in (r.ids, r.uids, r.q_names, r.q_skips))
                s = products(np.frombuffer(r.q_vecs, "<i8").reshape(-1, dim), np.frombuffer(r.vecs, "<i8").reshape(-1, dim))
                good = (s >= np.frombuffer(r.q_least, "<f8")[:, None]) & (skips[:, None] != uids[None, :])
                out = []
                for a in np.nonzero(good.any(axis=1))[0]:
                    at = np.nonzero(good[a])[0]
                    at = at[np.lexsort((ids[at], -s[a, at]))[:k]]
                    out.append(pd.DataFrame({"query": names[a], "vec_id": ids[at], "uid": uids[at], "score": s[a, at]}))
                if out:
                    yield pd.concat(out)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    top = spark.createDataFrame([], RESULT)
    first, last = 0, 4
    while first < len(cells):
        known = top.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        state = asked.join(known, "query", "left").select("query", "skip", "vec", F.col("least").cast("double").alias("least"))
        todo = checkpoint(state.mapInPandas(plan(first, last), "cell long, q_names binary, q_skips binary, q_least binary, q_vecs binary"))
        if todo.isEmpty():
            break
        found = todo.join(stored, "cell").select("q_names", "q_skips", "q_least", "q_vecs", "ids", "uids", "vecs").mapInPandas(compare, RESULT)
        ranked = top.unionByName(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        top = checkpoint(ranked.drop("rank"))
        first, last = last, last + 3 * last
    # rows alike in id and vector stand as often as they are, but for the query's own
    some = top.join(asked.select("query", F.col("id").alias("query_id"), "asked", "own"), "query").join(rows.select("uid", "times"), "uid")
    often = F.col("times") - F.coalesce((F.col("uid") == F.col("own")).cast("int"), F.lit(0))
    each = some.where(often > 0).select("query", "query_id", "asked", "vec_id", "uid", "score", F.explode(F.sequence(F.lit(1), F.least(often, F.lit(k)).cast("int"))))
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("asked").cast("int"))).alias("n_")).drop("n_")
