"""Quality by importance resampling: the ratio of hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint, word_codes

TOKEN = re.compile(r"\w+|[^\w\s]+")
CHUNK = 4096  # buckets that travel as one row


def grams(text: str | None, seen: dict) -> np.ndarray:
    """Codes of a text's n-grams: its words as they are written and its pairs of words, with repeats.

    As n-grams count once a document, a text that says its words over and over would look like one that says them
    once: pairs of equal words, signs left out, are one n-gram whatever the word, told apart by
    the share of all words that they make up, in powers of two from a 64th.
    """
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    codes = word_codes(tokens, seen)
    pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    words = codes if text.isalnum() else codes[[t[0].isalnum() or t[0] == "_" for t in tokens]]
    same = int((words[1:] == words[:-1]).sum())
    again = [np.uint64(1 + int(np.log2(64 * same / len(codes))))] if 64 * same > len(codes) else []
    return np.concatenate([codes, pairs, np.array(again, dtype=np.uint64)]) * np.uint64(0xD6E8FEB86659FD93)


def table_bits(documents: int) -> int:
    """The models grow with the corpus: eight buckets a document, 2**21 at least and 2**24 at most (16 bytes each at the driver)."""
    return min(24, max(21, (8 * documents - 1).bit_length()))


def buckets(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram's bucket in either half of the table, by two hashes."""
    shift = np.uint64(65 - bits)
    other = (codes ^ (codes >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return (codes >> shift).astype(np.int64), ((other >> shift) | np.uint64(1 << (bits - 1))).astype(np.int64)


def log_weight(text: str | None, ratio: np.ndarray, bits: int, seen: dict) -> float:
    """Log of the ratio of the likelihoods of the text's n-grams, each counted once, under the target and the raw model.

    As in a count-min sketch, of an n-gram's two buckets the one nearer to zero stands for it, so that an n-gram which
    shares one bucket with a telling one is not taken for it.
    """
    a, b = (ratio[x] for x in buckets(np.unique(grams(text, seen)), bits))
    return float(np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0.0).sum(dtype=np.float64))


def counts(docs: DataFrame, target: np.ndarray, bits: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(documents of each bucket, those in the target, all documents, target documents), over every document."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(target))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, seen = shared.value, {}
        raw, hit, n = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32), [0, 0]
        for pdf in batches:
            ids = pdf["id"].to_numpy(dtype="float64", na_value=-1).astype(np.int64) if pdf["id"].hasnans else pdf["id"].to_numpy(dtype=np.int64)
            good = np.isin(ids, wanted) & pdf["id"].notna().to_numpy()
            for text, g in zip(pdf["text"], good, strict=True):
                for b in buckets(grams(text, seen), bits):
                    raw[b] += 1  # once for a document, however often the bucket is named
                    if g:
                        hit[b] += 1
                n[0] += 1
                n[1] += int(g)
        yield pd.DataFrame({"chunk": [-1], "raw": [np.array(n[:1], np.int32).tobytes()], "hit": [np.array(n[1:], np.int32).tobytes()]})
        for k in np.nonzero(raw.reshape(-1, CHUNK).any(axis=1))[0]:
            part = slice(k * CHUNK, (k + 1) * CHUNK)
            yield pd.DataFrame({"chunk": [k], "raw": [raw[part].tobytes()], "hit": [hit[part].tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for k, raw, hit in zip(pdf["chunk"], pdf["raw"], pdf["hit"], strict=True):
                a, b = np.frombuffer(raw, np.int32).astype(np.int64), np.frombuffer(hit, np.int32).astype(np.int64)
                have[k] = [have[k][0] + a, have[k][1] + b] if k in have else [a, b]
        for k, (a, b) in have.items():
            yield pd.DataFrame({"chunk": [k], "raw": [a.tobytes()], "hit": [b.tobytes()]})

    schema = "chunk int, raw binary, hit binary"
    parts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(count, schema)
    raw, hit, n = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), [0, 0]
    for row in parts.repartition("chunk").mapInPandas(merge, schema).toLocalIterator():
        a, b = np.frombuffer(row["raw"], np.int64), np.frombuffer(row["hit"], np.int64)
        if row["chunk"] < 0:
            n = [int(a[0]), int(b[0])]
        else:
            part = slice(row["chunk"] * CHUNK, (row["chunk"] + 1) * CHUNK)
            raw[part], hit[part] = a, b
    return raw, hit, n[0], n[1]


def log_ratios(raw: np.ndarray, hit: np.ndarray, n: int, target: int, sure: float, least: float) -> np.ndarray:
    """log(target / raw) of each bucket, both counts with one added, at the scale of the target.

    Two models of one vocabulary differ by a constant besides, as the raw text also holds what the target lacks; the
    median over the target's words is taken off. Where the counts don't differ by more than chance and copying make
    them (the square roots by ``sure`` standard deviations and the ratio by e**least, or half as many where it is over
    e**(2 * least), which chance and copying seldom make), the target model is the raw model: the n-grams of a text, and those of its copies, come and go together, so their differences add up instead of
    cancelling. The README has the figures without this.
    """
    if not target:
        return np.zeros(len(raw), np.float32)
    expect = raw * (target / n)
    lr = np.log((hit + 1) / (expect + 1))
    order = np.argsort(lr)
    weight = np.cumsum(hit[order])
    middle = lr[order[np.searchsorted(weight, weight[-1] / 2)]] if weight[-1] else 0.0
    lr = lr - middle
    z = 2 * (np.sqrt(hit + 0.375) - np.sqrt(expect * np.exp(middle) + 0.375))
    far = np.abs(lr)
    return np.where((far >= least) & (np.abs(z) >= np.where(far >= 2 * least, sure / 2, sure)), lr, 0.0).astype(np.float32)


def target_ids(labels: DataFrame, wanted: str, most: int, id_col: str) -> np.ndarray:
    """Ids of labelled rows that make up the target: at most ``most``, those of the smallest hashes, so that a rerun takes the same."""
    rows = labels.where(wanted).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    n = rows.count()
    if n > most:
        rows = rows.orderBy(F.xxhash64("id"), "id").limit(most)
    return rows.toPandas()["id"].to_numpy(dtype=np.int64)


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: str = "quality = 1 AND toxic = 0", bits: int | None = None, most_labels: int = 200_000, sure: float = 8.0, least: float = 1.0, temperature: float = 0.25) -> DataFrame:
    """(id, log_weight, key) of every document: log of target over raw likelihood over ``temperature``, and that plus Gumbel noise.

    Models count in how many documents each of ``2**bits`` buckets of one- and two-word n-grams occurs, an n-gram
    in a bucket of either half of the table (``table_bits`` of the corpus by default); the raw model over all
    documents, the target model over at most ``most_labels`` labelled rows that meet ``wanted``. The noise comes from
    the id, so that a rerun draws the same. Null and empty texts and texts without evidence weigh zero, as does
    everything if no row is labelled. Rows that repeat an id are each weighed. Other columns are not read.
    """
    bits = table_bits(docs.count()) if bits is None else bits
    raw, hit, n, target = counts(docs, target_ids(labels, wanted, most_labels, id_col), bits, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, hit, n, target, sure, least))

    @F.pandas_udf("double")
    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio, seen = shared.value, {}
        for texts in batches:
            yield pd.Series([log_weight(t, ratio, bits, seen) for t in texts], dtype="float64")

    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit("gumbel")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    noise = -F.log(-F.log(u))
    rows = docs.select(F.col(id_col).alias("id"), weight(F.col(text_col)).alias("log_weight"), noise.alias("noise"))
    cool = F.col("log_weight") / F.lit(temperature)
    return rows.select("id", cool.alias("log_weight"), (cool + F.col("noise")).alias("key"))


def kth_largest(rows: DataFrame, col: str, k: int, bins: int = 1024, few: int = 10_000) -> float:
    """The k-th largest value, by counting values in ever finer bins; at most ``few`` values reach the driver."""
    lo, hi, total = rows.agg(F.min(col), F.max(col), F.count(col)).first()
    if k >= total:
        return lo
    inside = rows.select(F.col(col).alias("v"))
    while True:
        part = inside.where(F.col("v").between(lo, hi))
        n = part.count()
        if n <= few:
            return sorted((r["v"] for r in part.collect()), reverse=True)[k - 1]
        width = (hi - lo) / bins
        if not width or lo + width == lo:
            return lo
        hist = dict(part.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width)).alias("b")).count().collect())
        for b in range(bins - 1, -1, -1):
            c = hist.get(b, 0)
            if c >= k:
                # a margin on both sides, as the bounds are rounded; what lies above is counted again
                low, high = max(lo, lo + b * width - 1e-9 * width), min(hi, lo + (b + 1) * width + 1e-9 * width)
                above = part.where(F.col("v") > high).count()
                k -= above - sum(hist.get(x, 0) for x in range(b + 1, bins))
                lo, hi = low, high
                break
            k -= c


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, **more) -> DataFrame:
    """The documents that are drawn: (id, log_weight, key) of the ``k`` largest keys, all that tie with the last.

    ``k`` is how many to draw. Without it, it is the sum over all documents of the weight, at most one each: the
    expected number that the target model accepts, so that a filter keeps as many as look like the target. An empty
    table gives no rows.
    """
    rows = checkpoint(weigh(docs, labels, **more))
    if k is None:
        k = round(rows.agg(F.sum(F.exp(F.least(F.lit(0.0), "log_weight")))).first()[0] or 0)
    if k < 1 or not rows.count():
        return rows.limit(0)
    return rows.where(F.col("key") >= kth_largest(rows, "key", k))
