"""SimHash near-duplicates: exact links within a Hamming radius, found through a vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint, connected_components

SEED = 42
ALL_BITS = (1 << 64) - 1


def simhash(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint, as a signed long. Null, empty and blank texts get zero."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    h = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed long."""

    @F.pandas_udf("long")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), code(F.col(text_col)).alias("fp"))


class VantageTree:
    """Top levels of a vantage-point tree. Each inner node has a vantage point and a radius.

    Distances are taken over the bits of ``mask``, where ``reach`` is how far apart a linked pair may lie. At a node, fingerprints within the radius go inside; those beyond ``radius - reach`` go outside. A pair that
    is linked and lies on both sides has its inner end within ``reach`` of the boundary, by the triangle
    inequality, so every linked pair shares a leaf and only one side is copied.
    """

    def __init__(self, sample: np.ndarray, total: int, leaf: int, reach: int, mask: int = ALL_BITS, seed: int = 7):
        self.reach, self.mask, self.nodes = reach, np.uint64(mask), []
        rng = np.random.default_rng(seed)
        self._grow(sample & self.mask, total / max(1, len(sample)), leaf, rng)

    def _grow(self, pts: np.ndarray, weight: float, leaf: int, rng) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if len(pts) * weight <= leaf or len(pts) < 8:
            return me
        tried = rng.choice(pts, size=min(8, len(pts)), replace=False)
        d = np.bitwise_count(pts[None, :] ^ tried[:, None]).astype(np.int16)
        best = int(d.std(axis=1).argmax())
        d = d[best]
        mu = int(np.median(d))
        inner, outer = pts[d <= mu], pts[d > mu - self.reach]
        if max(len(inner), len(outer)) >= 0.97 * len(pts):
            return me
        self.nodes[me] = [int(tried[best]), mu, 0, 0]
        self.nodes[me][2] = self._grow(inner, weight, leaf, rng)
        self.nodes[me][3] = self._grow(outer, weight, leaf, rng)
        return me

    def route(self, pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, index into pts) for every leaf whose region each fingerprint overlaps."""
        leaves, index, todo = [], [], [(0, np.arange(len(pts)))]
        while todo:
            node, idx = todo.pop()
            if not len(idx):
                continue
            if self.nodes[node] is None:
                leaves.append(np.full(len(idx), node, dtype=np.int32))
                index.append(idx)
                continue
            v, mu, inside, outside = self.nodes[node]
            d = np.bitwise_count((pts[idx] & self.mask) ^ np.uint64(v))
            todo += [(inside, idx[d <= mu]), (outside, idx[d.astype(np.int16) > mu - self.reach])]
        return (np.concatenate(leaves), np.concatenate(index)) if leaves else (np.empty(0, np.int32), np.empty(0, np.int64))


class _Links:
    """Components of the fingerprints of one leaf: of the pairs within ``reach``, those within ``near`` over ``mask``."""

    def __init__(self, pts: np.ndarray, reach: int, mask: int = ALL_BITS, near: int | None = None, leaf: int = 128):
        self.pts, self.reach, self.leaf, self.up = pts, reach, leaf, list(range(len(pts)))
        self.views = [(pts & np.uint64(mask), reach if near is None else near), (pts, reach)]
        self.rng = np.random.default_rng(11)
        self._search(np.arange(len(pts)))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def _one(self, idx: np.ndarray) -> bool:
        root = self.find(int(idx[0]))
        return all(self.find(int(i)) == root for i in idx)

    def _all(self, idx: np.ndarray) -> None:
        """Every pair, a row at a time; ends when all are one component."""
        for k, i in enumerate(idx):
            rest = idx[k + 1 :]
            for j in rest[np.bitwise_count(self.pts[rest] ^ self.pts[i]) <= self.reach]:
                self.join(int(i), int(j))
            if k % 256 == 255 and self._one(idx):
                return

    def _search(self, start: np.ndarray) -> None:
        todo = [(start, 0, 0)]
        while todo:
            idx, depth, view = todo.pop()
            if len(idx) < 2:
                continue
            if len(idx) <= self.leaf:
                p = self.pts[idx]
                x, y = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= self.reach, 1))
                for i, j in zip(idx[x].tolist(), idx[y].tolist(), strict=True):
                    self.join(i, j)
                continue
            v = int(idx[self.rng.integers(len(idx))])
            d = np.bitwise_count(self.pts[idx] ^ self.pts[v]).astype(np.int16)
            for j in idx[d <= self.reach]:
                self.join(v, int(j))
            if np.count_nonzero(d <= 4 * self.reach) > len(idx) // 2 and self._one(idx):
                continue
            seen, near = self.views[view]
            d = np.bitwise_count(seen[idx] ^ seen[v]).astype(np.int16)
            mu = int(np.median(d))
            inner, outer = idx[d <= mu], idx[d > mu - near]
            if depth <= 40 and max(len(inner), len(outer)) < 0.97 * len(idx):
                todo += [(inner, depth + 1, view), (outer, depth + 1, view)]
            elif view == 0:
                todo.append((idx, 0, 1))
            else:
                self._all(idx)


def link_fingerprints(codes: DataFrame, reach: int = 3, leaf: int = 8192, sample: int | None = None) -> DataFrame:
    """Links among (rep, fp) rows of distinct fingerprints as (a, b) edges that keep every component whole.

    Fingerprints within ``reach`` are within half of it over the upper or the lower 32 bits, so there is a tree
    for each half: with so short a reach few fingerprints lie near a boundary and are copied. A tree's top is fitted on at most ``2 * sample`` fingerprints, chosen by hash (sixteen for each leaf by
    default, 65,536 at least and 2**20 at most); every fingerprint is routed through it. A leaf gives one edge for each fingerprint that has a link, towards the first of its component,
    so that a dense group costs no more rows than it has members.
    """
    total = codes.count()
    sample = min(1 << 20, max(65536, 16 * total // leaf)) if sample is None else sample
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30))
    some = codes.where(share).select("fp").limit(2 * sample).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    masks = [(1 << 32) - 1, ALL_BITS - (1 << 32) + 1]
    trees = [VantageTree(some, total, leaf, reach // 2, mask) for mask in masks]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, tree in enumerate(trees):
                leaves, index = tree.route(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64))
                yield pd.DataFrame({"shard": leaves * 2 + k, "rep": pdf["rep"].to_numpy()[index], "fp": pdf["fp"].to_numpy()[index]})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        links = _Links(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64), reach, masks[int(pdf["shard"].iloc[0]) % 2], reach // 2)
        rep = pdf["rep"].to_numpy()
        root = np.array([links.find(i) for i in range(len(rep))], dtype=np.int64)
        away = root != np.arange(len(rep))
        return pd.DataFrame({"a": rep[away], "b": rep[root[away]]})

    return codes.select("rep", "fp").mapInPandas(route, "shard int, rep long, fp long").groupBy("shard").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 3) -> DataFrame:
    """One row per document: id, fingerprint (hex), component (the smallest id reachable through links).

    Equal fingerprints meet in an aggregation, so copies cost one row. Null, empty and blank texts have
    fingerprint zero and link like any other. Rows that repeat an id are each returned; a null id gets a
    fingerprint and the component of the rest of its group (null if it has none). An empty table gives no rows.
    """
    codes = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    firsts = checkpoint(codes.groupBy("fp").agg(F.min("id").alias("rep")))
    comp = connected_components(link_fingerprints(firsts.where("rep IS NOT NULL"), reach))
    groups = firsts.join(comp, firsts["rep"] == comp["node"], "left").select(F.col("fp").alias("k"), F.coalesce("component", "rep").alias("component"))
    return codes.join(groups, codes["fp"] == groups["k"], "left").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component")
