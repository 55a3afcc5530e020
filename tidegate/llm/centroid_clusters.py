"""Lloyd's rounds over two trees: cover trees of the vectors, built once, and one of the centroids, built each round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint

TREE = 2048  # vectors of one cover tree
LEAF = 32
MOST_BALLS = 256
FEW = 1  # rows of a ball of centroids
MOST = 2**27  # components are held within this, so that squared distances of 64 components fit 64 bits


class CoverTree:
    """Nodes over rows of integers, each with a centre among its rows and the distance of the farthest.

    A node's rows are covered by balls of half its reach around rows of it, which lie farther than that apart. Balls of ``leaf``
    rows or more are its children, and what lies in smaller ones, or in none of the first ``MOST_BALLS`` tried in an order
    that a hash gives, is one leaf beside them. A node of few rows, of equal rows, or without two such parts is a leaf.
    ``order`` lists the rows so that those of a node are neighbours.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        x = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.begin, self.end, self.centre, self.radius, self.children = [], [], [], [], []
        whole: set[int] = set()  # leaves that aren't looked at again
        if len(points):
            self._add(x, 0, len(points))
        at = 0
        while at < len(self.begin):
            b, e, reach = self.begin[at], self.end[at], self.radius[at]
            if e - b > leaf and reach > 0 and at not in whole:
                own = self._balls(x, self.order[b:e], reach / 2, leaf)
                sizes = np.bincount(own)
                if np.count_nonzero(sizes) > 1:
                    self.order[b:e] = self.order[b:e][np.argsort(own, kind="stable")]
                    for ball, n in enumerate(sizes.tolist()):
                        if n:
                            if ball == 0:
                                whole.add(len(self.begin))
                            self.children[at].append(len(self.begin))
                            self._add(x, b, b + n)
                            b += n
            at += 1

    def _add(self, x: np.ndarray, begin: int, end: int) -> None:
        """The row nearest to the mean is the centre."""
        rows = self.order[begin:end]
        far = ((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1)
        centre = int(rows[far.argmin()])
        self.begin.append(begin)
        self.end.append(end)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1).max())))
        self.children.append([])

    @staticmethod
    def _balls(x: np.ndarray, rows: np.ndarray, reach: float, leaf: int) -> np.ndarray:
        """For each row the number of its ball, from 1; 0 for those in balls of fewer than ``leaf`` rows, or in none."""
        own, left, n = np.zeros(len(rows), dtype=np.int64), np.argsort(rows * 0x9E3779B1 % 2**32, kind="stable"), 0
        place = x[rows]
        square = (place * place).sum(axis=1)
        for _ in range(MOST_BALLS):
            if len(left) < leaf:
                break
            k = left[0]
            near = square[left] + square[k] - 2 * (place[left] @ place[k]) <= reach * reach
            near[0] = True
            if np.count_nonzero(near) >= leaf:
                n += 1
                own[left[near]] = n
            left = left[~near]
        return own


def exact(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: in floating point where every sum is a whole number that it holds."""
    top = float(max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * top * top * points.shape[1] < 2**53 else np.int64
    a, b = points.astype(kind), centroids.astype(kind)
    if kind is np.int64:  # sums of squares of differences stay within 64 bits, those of the parts need not
        return np.stack([((a - c) ** 2).sum(axis=1) for c in b], axis=1)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def assign(tree: CoverTree, points: np.ndarray, centroids: np.ndarray, above: CoverTree) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, cluster of each): every row with its nearest centroid, the smaller number of several; rows that share one may come as one number.

    A pair of a vector node and a centroid node is dropped when no row of the one can be nearer to any centroid of the other
    than to the best centroid known for it: centres' distance less both radii beyond the least centres' distance plus
    the vector node's radius. A node with one centroid left takes it whole; leaves are compared exactly.
    """
    x, c = points.astype(np.float64), centroids.astype(np.float64)
    out, todo = [], [(0, [0])] if len(points) else []
    while todo:
        node, held = todo.pop()
        b, e, r = tree.begin[node], tree.end[node], tree.radius[node]
        centre = x[tree.centre[node]]
        while True:
            d = np.sqrt(((c[[above.centre[k] for k in held]] - centre) ** 2).sum(axis=1))
            reach = np.array([above.radius[k] for k in held])
            least = (d + r).min()
            held = [k for k, near in zip(held, d - reach - r <= least + 1e-6 * (1 + least), strict=True) if near]
            wide = [k for k in held if above.children[k] and above.radius[k] >= r]
            if not wide:
                break
            held = [k for k in held if k not in wide] + [n for k in wide for n in above.children[k]]
        left = np.sort(np.concatenate([above.order[above.begin[k] : above.end[k]] for k in held]))
        rows = tree.order[b:e]
        if len(left) == 1:
            out.append((rows, np.int64(left[0])))
        elif tree.children[node]:
            todo += [(k, held) for k in tree.children[node]]
        else:
            out.append((rows, left[exact(points[rows], centroids[left]).argmin(axis=1)]))
    return out


def quantized(vectors: DataFrame, dim: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): floor(scale * x) of the components of vectors that have ``dim`` of them, none null or not finite."""
    x = F.col(vec_col)
    whole = F.coalesce(F.size(x) == dim, F.lit(False)) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    held = lambda v: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v.cast("double") * scale)))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(x, held).alias("vec"))


def trees(rows: DataFrame) -> DataFrame:
    """(n, ids, vecs, kind, nodes, radius): a cover tree for every ``TREE`` vectors of a task, ready to be read each round.

    Ids are text on the way, as pandas would turn those of a batch with a null into floating point.
    """
    schema = "n long, ids array<string>, vecs binary, kind string, nodes binary, radius binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), TREE):
                part = pdf.iloc[at : at + TREE]
                m = np.stack(part["vec"].to_numpy()).astype(np.int64)
                t = CoverTree(m)
                kind = "<i2" if np.abs(m).max(initial=0) < 2**15 else "<i4"
                m = m[t.order]
                back = np.argsort(t.order)
                parent = np.full(len(t.begin), -1)
                for k, own in enumerate(t.children):
                    parent[own] = k
                nodes = np.stack([t.begin, t.end, back[t.centre], parent]).astype("<i4")
                yield pd.DataFrame({"n": [len(m)], "ids": [part["id"].iloc[t.order].tolist()], "vecs": [m.astype(kind).tobytes()], "kind": [kind], "nodes": [nodes.tobytes()], "radius": [np.array(t.radius, dtype="<f8").tobytes()]})

    return rows.select(F.col("id").cast("string").alias("id"), "vec").mapInPandas(run, schema)


def _tree(r) -> tuple[CoverTree, np.ndarray]:
    t = CoverTree.__new__(CoverTree)
    begin, end, centre, parent = np.frombuffer(r.nodes, "<i4").reshape(4, -1).tolist()
    t.begin, t.end, t.centre, t.radius, t.order = begin, end, centre, np.frombuffer(r.radius, "<f8").tolist(), np.arange(r.n)
    t.children = [[] for _ in begin]
    for k, p in enumerate(parent):
        if p >= 0:
            t.children[p].append(k)
    return t, np.frombuffer(r.vecs, r.kind).reshape(r.n, -1).astype(np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): ``rounds`` of Lloyd's algorithm and a last assignment.

    Vectors of ``dim`` components, none null or not finite, are taken as integers floor(scale * x), held within 2^27. The
    first centroids are the ``k`` vectors of smallest sha256 of ``<seed>:<id>`` in that order (of equal ids the smaller
    vector first; rows without an id are clustered but start none); fewer vectors give fewer centroids, none give no rows.
    A vector goes to the nearest centroid, the smaller number of several; a centroid that has any becomes the floor of their
    mean, component by component, the others stay. Repeated rows count each; other columns don't matter. A sum of
    distances beyond 64 bits is null.

    The trees are built once over the vectors where they lie, without a shuffle; only ``k`` rows of centroids are broadcast
    and only ``k`` rows of sums come back, each summed within its task first.
    """
    rows = quantized(vectors, dim, scale, id_col, vec_col)
    first = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    spark = vectors.sparkSession
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["vec"] for r in first], dtype=np.int64)
    stored = checkpoint(trees(rows))
    names = [f"s{j}" for j in range(dim)]

    def sums(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centroids = shared.value
            above, n, s = CoverTree(centroids, FEW), np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    tree, points = _tree(r)
                    for held, own in assign(tree, points, centroids, above):
                        if own.ndim == 0:
                            n[own] += len(held)
                            s[own] += points[held].sum(axis=0)
                        else:
                            np.add.at(n, own, 1)
                            np.add.at(s, own, points[held])
            some = np.flatnonzero(n)
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], **{c: s[some, j] for j, c in enumerate(names)}})

        return run

    def final(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centroids = shared.value
            above = CoverTree(centroids, FEW)
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    tree, points = _tree(r)
                    own = np.empty(len(points), dtype=np.int32)
                    for held, which in assign(tree, points, centroids, above):
                        own[held] = which
                    d = ((points - centroids[own]) ** 2).sum(axis=1)
                    yield pd.DataFrame({"id": r.ids, "cluster": own, "distance": d})

        return run

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)
        found = stored.mapInPandas(sums(shared), "cluster int, n long, " + ", ".join(f"{c} long" for c in names))
        # sums of sums as decimals: exact at any number of vectors
        for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in names)).collect():
            centroids[r["cluster"]] = [int(r[c]) // r["n"] for c in names]
        centroids = centroids.copy()
        shared.unpersist()
    out = checkpoint(stored.mapInPandas(final(spark.sparkContext.broadcast(centroids)), "id string, cluster int, distance long"))
    per = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 2**63 else None
    about = [(c, fits(s), fits(sum(per.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in per.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select(F.col("id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
