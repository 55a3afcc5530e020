"""Near copies by Jaccard similarity: SimHash links and banded min-hashes of word shingles find candidates, the shingle sets verify them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import simhash_dedup
from tidegate.llm.common import checkpoint, gram_codes, word_codes

FEW = 32_000_000  # letters of leaders' texts that are broadcast
BANDS, ROWS = 20, 6  # a pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS, 0.998 at 0.8
BITS = 1024  # bits of a sketch
KNOWN = 200_000  # words whose codes a task remembers
_rng = np.random.default_rng(42)
XOR = _rng.integers(0, 1 << 64, size=(BITS, 1), dtype=np.uint64)
TIMES = _rng.integers(0, 1 << 64, size=(BITS, 1), dtype=np.uint64) | np.uint64(1)
WORDS = [f"s{k}" for k in range(BITS // 64)]


def shingle_set(text: str | None, shingle: int, seen: dict) -> np.ndarray:
    """Sorted distinct codes of a text's runs of ``shingle`` words; a shorter text is one run, one without words none."""
    words = (text or "").encode().lower().split()  # as in simhash_dedup
    return np.unique(gram_codes(word_codes(words, seen, KNOWN), min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def min_hashes(grams: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least of each of ``n`` hashes over a set that isn't empty."""
    step = max(1, (1 << 18) // len(grams))
    parts = []
    for k in range(0, n, step):
        mixed = grams ^ XOR[k : min(n, k + step)]
        mixed *= TIMES[k : min(n, k + step)]
        parts.append(mixed.min(axis=1))
    return np.concatenate(parts)


def band_keys(grams: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """A key for each band, equal for two sets if all min-hashes of the band are; ``hashes`` are the set's, if they are known."""
    if not len(grams):
        return np.empty(0, np.int64)
    hashes = min_hashes(grams) if hashes is None else hashes[: BANDS * ROWS]
    least, key = hashes.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + least[:, r]
        key ^= key >> np.uint64(29)
    return ((key & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same) if len(a) or len(b) else 1.0


def coded(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, copy, keys) of (id, text) rows; texts with one set of shingles have one ``copy``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            copies, keys = [], []
            for text in pdf["text"]:
                grams = shingle_set(text, shingle, seen)
                copies.append(xxhash.xxh64_intdigest(grams.tobytes()))
                keys.append(band_keys(grams))
            yield pd.DataFrame({"id": pdf["id"], "copy": np.array(copies, dtype=np.uint64).view(np.int64), "keys": keys})

    return texts.mapInPandas(run, "id long, copy long, keys array<long>")


def linked_keys(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, key) of (id, text) rows: a key for each group of ids whose SimHash fingerprints link, none for an id alone.

    Its lower five bits are ``BANDS``, so that it is no key of a band.
    """
    found = simhash_dedup.near_duplicates(texts, "id", "text", shingle)
    groups = found.groupBy("component").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("component")
    key = F.xxhash64("component").bitwiseAND(F.lit(~31)).bitwiseOR(F.lit(BANDS))
    return found.join(groups, "component").select("id", key.alias("key")).distinct()


def sketch(grams: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """A bit of each of ``BITS`` min-hashes, in 64-bit integers; of an empty set all are 0."""
    if not len(grams):
        return np.zeros(BITS // 64, np.int64)
    hashes = min_hashes(grams, BITS) if hashes is None else hashes
    return np.packbits((hashes >> np.uint64(40) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<i8")


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, keys, *WORDS): band keys and sketches of texts. Sketches of two sets of similarity s agree in a share of (1 + s) / 2 of their bits, about."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            bits, keys = np.zeros((len(pdf), BITS // 64), np.int64), []
            for k, text in enumerate(pdf["text"]):
                grams = shingle_set(text, shingle, seen)
                hashes = min_hashes(grams, BITS) if len(grams) else None
                bits[k] = sketch(grams, hashes)
                keys.append(band_keys(grams, hashes))
            yield pd.DataFrame({"id": pdf["id"], "keys": keys, **{w: bits[:, k] for k, w in enumerate(WORDS)}})

    return texts.mapInPandas(run, "id long, keys array<long>, " + ", ".join(f"{w} long" for w in WORDS))


def unlike(a: str, b: str):
    """In how many bits the sketches of two sides of a join differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in WORDS))


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those (id, leader) pairs whose shingle sets are at least so similar. Texts of few leaders are broadcast and so never shuffled for a pair."""

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen, sets, size = {}, {}, 0
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                for t in (a, b):
                    if t not in sets:
                        if size > 2_000_000:
                            sets, size = {a: shingle_set(a, shingle, seen)}, 0
                        sets[t] = shingle_set(t, shingle, seen)
                        size += len(sets[t])
                out.append(jaccard(sets[a], sets[b]) >= similarity)
            yield pd.Series(out, dtype=bool)

    leaders = pairs.select("leader").distinct()
    right = texts.join(leaders, F.col("id") == F.col("leader"), "left_semi").select(F.col("id").alias("other"), F.col("text").alias("b"))
    if (right.agg(F.sum(F.length("b") + 64)).first()[0] or 0) <= FEW:
        right = F.broadcast(right)
    both = texts.select("id", F.col("text").alias("a")).join(pairs, "id").join(right, F.col("leader") == F.col("other"))
    return both.where(near("a", "b")).select("id", "leader").distinct()


def chosen(edges: DataFrame) -> list[DataFrame]:
    """The ids that go, in parts: in order of id, each with an edge to a leader that stays."""
    parts = []
    while not edges.isEmpty():
        waits = edges.select(F.col("id").alias("w")).distinct()
        gone = checkpoint(edges.join(waits, F.col("leader") == F.col("w"), "left_anti").select("id").distinct())
        parts.append(gone)
        left = edges.join(gone, "id", "left_anti")
        edges = checkpoint(left.join(gone.select(F.col("id").alias("leader")), "leader", "left_anti").select("id", "leader"))
    return parts


def distinct_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id): the documents that stay if, in order of id, each one goes that has a near copy among those that stay.

    Near copies have sets of ``shingle``-word shingles of at least that Jaccard similarity. So no document goes for
    a chain of links, and each that goes has a verified near copy that stays. Words are parted at ASCII white
    space, ASCII letters lower-cased. Copies with one set meet in an aggregation, texts without words (null and empty ones)
    in one group. Documents whose SimHash fingerprints link (3 bits, the reach of ``simhash_dedup``'s trees) share a key; as edited
    copies lie farther apart, those that share a band of min-hashes do too. Pairs of a key are looked at if their sketches agree in as many bits as the similarity
    asks for, but for 3.2 standard deviations (one true pair of a thousand is lost there, two at the bands), and
    then compared word for word. In each round the documents that are the smallest of all their keys stay, and
    all others of those keys are compared with them: the similar ones go, the rest wait for the next round without them.
    Once a round drops under a tenth of what waits, all pairs are looked at at once, which decides no pair otherwise.
    Within a key sketches are compared pair by pair, in the join itself; no pair is left out for the size of its
    group. Null ids are left out; an id that rows repeat stands for all of their texts. A text of any length is one
    row; an empty table gives no rows; other columns don't matter, whatever their names.
    """
    share = (1 + similarity) / 2
    most = int(BITS * (1 - share) + 3.2 * (BITS * share * (1 - share)) ** 0.5)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    firsts = checkpoint(coded(rows, shingle).groupBy("copy").agg(F.min(F.struct("id", "keys")).alias("x")).select("x.id", "x.keys"))
    linked = checkpoint(linked_keys(rows, shingle).join(firsts, "id", "left_semi"))
    live, texts, gone, more = firsts.select("id", F.explode("keys").alias("key")).unionByName(linked), None, [], True
    while True:
        leaders = live.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").drop("last")
        met = checkpoint(live.join(leaders, "key"))
        if met.isEmpty():
            break
        if texts is None:
            texts = checkpoint(rows.join(met.select("id").distinct(), "id", "left_semi"))
            links = linked.groupBy("id").agg(F.collect_set("key").alias("links"))
            both = F.concat("keys", F.coalesce("links", F.array().cast("array<long>")))
            marks = checkpoint(sketches(texts, shingle).distinct().join(links, "id", "left").select("id", both.alias("keys"), *WORDS))
        if not more:
            own = met.select("key", "id").join(marks, "id")
            # a pair comes out at the least key that both have, and so once
            once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
            near = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id")) & (unlike("x", "y") <= most) & once
            pairs = own.alias("x").join(own.alias("y"), near).select("x.id", F.col("y.id").alias("leader")).distinct()
            gone += chosen(checkpoint(similar_pairs(checkpoint(pairs), texts, shingle, similarity)))
            break
        waits = met.where("id > leader").select("id").distinct()
        pairs = met.where("id > leader").select("id", "leader").distinct().join(waits.select(F.col("id").alias("leader")), "leader", "left_anti").select("id", "leader")
        like = pairs.join(marks.alias("x"), "id").join(marks.alias("y"), F.col("leader") == F.col("y.id")).where(unlike("x", "y") <= most).select(pairs["id"], "leader")
        gone.append(checkpoint(similar_pairs(checkpoint(like.distinct()), texts, shingle, similarity).select("id").distinct()))
        more = 10 * gone[-1].count() >= waits.count()
        live = met.select("key", "id").join(waits, "id", "left_semi").join(gone[-1], "id", "left_anti")
    stay = firsts.select("id").distinct()
    return stay.join(reduce(DataFrame.unionByName, gone), "id", "left_anti") if gone else stay
