"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"\w+")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder that the session names.

    Where it names none, a temporary folder stands in on a local master, as in tests; a cluster's executors could not
    see it, so there it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidegate-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph given by its edges; component is the smallest node reachable.

    Large-star and small-star steps alternate until every edge points at its root. Each step is an
    aggregation with map-side combine and an equi-join, so a hub is split by the skew join; the number of
    edges never grows. Null ends are dropped. No edge ever reaches the driver, only one count and hash a round.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct()
    e = checkpoint(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(kept.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def word_codes(words: list, seen: dict, most: int = 1_000_000) -> np.ndarray:
    """64-bit codes of words; ``seen`` keeps those of frequent words and is emptied when it is full."""
    if len(seen) > most:
        seen.clear()
    out = []
    for w in words:
        c = seen.get(w)
        if c is None:
            c = seen[w] = xxhash.xxh64_intdigest(w)
        out.append(c)
    return np.array(out, dtype=np.uint64)


#: what Unicode has besides letters, digits and underscores; of ASCII, a table of bytes tells
_OTHER = re.compile(r"[^\w\x00-\x7f]+")
IN_WORD = np.array([b >= 128 or bool(WORD.match(chr(b))) for b in range(256)])


def lowered(text: str | None) -> str:
    """The text in lower case, spaces for what isn't ASCII and no part of a word."""
    text = (text or "").lower()
    return text if text.isascii() else _OTHER.sub(" ", text)


def word_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of ``lowered`` texts together, where their words begin and end, how many words came before each text and in all)."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([b"", *parts, bytes(8)]), np.uint8)
    inside = IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    return data, begin, end, np.searchsorted(begin, np.cumsum([1, *(len(p) + 1 for p in parts)]))


def xxh64_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each stretch of bytes; those of one length are hashed together. Eight bytes more lie behind the last one."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return x << np.uint64(bits) | x >> np.uint64(64 - bits)

    out, size = np.empty(len(begin), np.uint64), np.minimum(end - begin, 32).astype(np.uint8)
    by_size, eight = np.argsort(size, kind="stable"), np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    cuts = np.cumsum(np.bincount(size, minlength=33))
    for n in range(32):
        rows = by_size[cuts[n - 1] if n else 0 : cuts[n]]
        if not len(rows):
            continue
        at, done = begin[rows], 0
        h = np.full(len(rows), p5 + np.uint64(n))
        while n - done >= 8:
            h = turned(h ^ turned(eight[at + done] * p2, 31) * p1, 27) * p1 + p4
            done += 8
        if n - done >= 4:
            h = turned(h ^ (eight[at + done] & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3
            done += 4
        for k in range(done, n):
            h = turned(h ^ data[at + k] * p5, 11) * p1
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        out[rows] = h ^ h >> np.uint64(32)
    for row in by_size[cuts[31] :]:
        out[row] = xxhash.xxh64_intdigest(data[begin[row] : end[row]])
    return out


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of the runs of n words, in order; none if there are fewer words."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + m]
        out ^= out >> np.uint64(29)
    return out


def align(a: np.ndarray, b: np.ndarray, diagonal: int | None = None, band: int = 0, match: int = 2, miss: int = 1, gap: int = 1):
    """Best local alignment of two code arrays: (score, matches, a_start, a_end, b_start, b_end), ends exclusive.

    With ``diagonal``, only cells whose b index minus a index lies within ``band`` of it are filled. A row is
    filled at once: a run of gaps along it is a running maximum of score plus gap times position.
    """
    n, m = len(a), len(b)
    none = (0, 0, 0, 0, 0, 0)
    if not n or not m:
        return none
    h = np.zeros((n + 1, m + 1), dtype=np.int32)
    slope = gap * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        j0, j1 = 1, m
        if diagonal is not None:
            j0, j1 = max(1, i + diagonal - band), min(m, i + diagonal + band)
            if j0 > j1:
                continue
        row = h[i - 1]
        x = np.maximum(row[j0 - 1 : j1] + np.where(b[j0 - 1 : j1] == a[i - 1], match, -miss), row[j0 : j1 + 1] - gap)
        s = slope[j0 : j1 + 1]
        h[i, j0 : j1 + 1] = np.maximum(np.maximum.accumulate(np.maximum(x, 0) + s) - s, 0)
    top = int(h.argmax())
    i, j = divmod(top, m + 1)
    score = int(h[i, j])
    if not score:
        return none
    ai, bj, matches = i, j, 0
    while h[i, j] > 0:
        here, same = h[i, j], a[i - 1] == b[j - 1]
        if here == h[i - 1, j - 1] + (match if same else -miss):
            i, j, matches = i - 1, j - 1, matches + int(same)
        elif here == h[i - 1, j] - gap:
            i -= 1
        else:
            j -= 1
    return score, matches, i, ai, j, bj


def seed_windows(starts: list[int], length: int, slack: int, end: int) -> list[tuple[int, int]]:
    """Where a passage of so many words may lie, from the starts that its seeds imply: merged, padded by slack.

    A very long stretch of overlapping starts is cut into pieces that overlap by a whole padded passage.
    """
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s - out[-1][1] <= slack:
            out[-1][1] = s
        else:
            out.append([s, s])
    whole, got = length + 2 * slack, []
    for lo, hi in out:
        lo, hi = max(0, lo - slack), min(end, hi + length + slack)
        while hi - lo > 4 * whole:
            got.append((lo, lo + 4 * whole))
            lo += 3 * whole
        got.append((lo, hi))
    return got
