"""Benchmark decontamination: rare word n-grams join passages with test items, a Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import WORD, align, checkpoint, gram_codes, seed_windows, word_codes

SHORT = 5  # items of so many words are seeded with pairs of words
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26  # of the filter of seeds
SMALL = 32_000_000  # bytes of items that are broadcast
KNOWN = 200_000  # words whose codes a task remembers
FOUND = "a long, b long, item_id long, similarity double, score int, start_word int, end_word int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def codes_of(text: str | None, seen: dict) -> np.ndarray:
    return word_codes(words_of(text), seen, KNOWN)


def seed_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """Keys of the runs of ``size`` words, in order; runs of unlike sizes have unlike keys."""
    grams = gram_codes(codes, size)
    return (grams ^ np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)


def seed_size(words: int, seed: int) -> int:
    return min(2, words) if words <= SHORT else seed


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each key in a filter of ``bits`` bits, a power of two."""
    u = keys.view(np.uint64)
    return np.stack([u >> np.uint64(7), u >> np.uint64(35)]) & np.uint64(bits - 1)


def item_rows(benchmark: DataFrame, item_col: str, item_text: str, least: int) -> DataFrame:
    """(unit, item_id, codes): items of at least ``least`` words, once each, their words as codes; a unit is an item's id with its text."""
    good = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            yield pdf[["unit", "item_id"]].assign(codes=[codes_of(t, seen).view(np.int64).tolist() for t in pdf["text"]])

    rows = good.withColumn("unit", F.xxhash64("item_id", "text")).mapInPandas(run, "unit long, item_id long, codes array<long>")
    return rows.where(F.size("codes") >= max(1, least))


def seed_rows(items: DataFrame, seed: int) -> DataFrame:
    """(key, unit, place, words): every run of ``seed`` words of every item, of two words if it is short."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for unit, codes in zip(pdf["unit"], pdf["codes"], strict=True):
                keys = seed_codes(np.asarray(codes, dtype=np.int64).view(np.uint64), seed_size(len(codes), seed))
                yield pd.DataFrame({"key": keys, "unit": unit, "place": np.arange(len(keys), dtype=np.int32), "words": np.int32(len(codes))})

    return items.select("unit", "codes").mapInPandas(run, "key long, unit long, place int, words int")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bits of a filter that has every seed: sixteen a seed, within ``LEAST_BITS`` and ``MOST_BITS``; made in the tasks, word by word."""
    n = seeds.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * n):
        bits *= 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(bits // 64, dtype=np.uint64)
        for pdf in batches:
            at = slots(pdf["key"].to_numpy(dtype=np.int64), bits).ravel()
            np.bitwise_or.at(held, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(held)
        yield pd.DataFrame({"word": some, "bits": held[some].view(np.int64)})

    words = seeds.select("key").mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, id, text): rows of one id and text have one pair of hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.select(F.xxhash64("id", "text").alias("a"), F.xxhash64("text", "id").alias("b"), "id", "text")


def seed_hits(rows: DataFrame, known: np.ndarray, sizes: list[int]) -> DataFrame:
    """(a, b, key, pos): where a run of words of a text may be a seed, by the filter; a few others come along."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(known))
    bits = len(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen = np.unpackbits(shared.value).astype(bool), {}
        for pdf in batches:
            out = []
            for a, b, text in zip(pdf["a"], pdf["b"], pdf["text"], strict=True):
                codes = codes_of(text, seen)
                for size in sizes:
                    keys = seed_codes(codes, size)
                    if len(keys):
                        one, two = slots(keys, bits)
                        at = np.flatnonzero(held[one] & held[two])
                        if len(at):
                            out.append((a, b, keys[at].tolist(), at.tolist()))
            yield pd.DataFrame(out, columns=["a", "b", "keys", "places"])

    found = rows.where("text IS NOT NULL").select("a", "b", "text").mapInPandas(run, "a long, b long, keys array<long>, places array<int>")
    return found.select("a", "b", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("pos"))))


def chosen_seeds(seeds: DataFrame, hits: DataFrame, rare: int, fallback: int) -> DataFrame:
    """Seeds that occur at most ``rare`` times in the corpus, and for items with fewer such than ``fallback`` the next rarest up to that number.

    Seeds that occur nowhere find nothing and don't count. Of equally common ones those are taken that a hash puts first, so
    that they lie all over the item.
    """
    times = hits.groupBy("key").agg(F.count("*").alias("times"))
    ranked = seeds.join(times, "key").withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy("times", F.xxhash64("key", "place"))))
    return ranked.where((F.col("times") <= rare) | (F.col("rank") <= fallback)).select("key", "unit", "place", "words")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 2, seed: int = 3, least: float = 0.8, rare: int = 200, fallback: int = 24) -> DataFrame:
    """(a, b, id, item_id, similarity, score, start_word, end_word): passages of documents that copy or paraphrase an item.

    Words are runs of letters, digits and underscores, lower-cased. A passage counts if an alignment matches at least
    ``least`` of the longer of the item and the aligned stretch. Runs of ``seed`` words of an item are its seeds (of two words, if
    it has five or fewer). A filter of all seeds, bounded by ``MOST_BITS``, finds where texts may hold one; how often each
    occurs says which are rare (``chosen_seeds``), and rows of rare seeds join rows of texts by key, a hot key's split by the
    skew join. Where a seed is met a window of the text goes to its item and is aligned; whole texts never move but
    those that meet a seed, once each. So a passage with up to a fifth of its words replaced keeps a seed; a copy whose words
    are inserted and deleted in turn, so that no three of the item's stay together, may be missed (the README has the recall).

    Null and empty texts have no passages; items that are null or have fewer than ``n`` words match nothing, as a single word is in
    any text; repeated items count once, and so do rows that repeat an id and text (``a`` and ``b`` are their hashes);
    texts of any length are one row; empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    items = checkpoint(item_rows(benchmark, item_col, item_text, n))
    seeds = seed_rows(items, seed)
    lengths = [r["s"] for r in items.select(F.when(F.size("codes") <= SHORT, F.least(F.lit(2), F.size("codes"))).otherwise(F.lit(seed)).alias("s")).distinct().collect()]
    if not lengths:
        return spark.createDataFrame([], FOUND.replace("item_id", "id long, item_id", 1))
    rows = keyed(docs, id_col, text_col)
    hits = checkpoint(seed_hits(rows, seed_filter(seeds), sorted(lengths)))
    met = hits.join(chosen_seeds(seeds, hits, rare, fallback), "key")
    per = met.groupBy("a", "b", "unit").agg(F.collect_set(F.col("pos") - F.col("place")).alias("starts"), F.max("words").alias("words"))
    asked = checkpoint(per.groupBy("a", "b").agg(F.collect_list(F.struct("unit", "words", "starts")).alias("asked")))

    texts = rows.join(asked.select("a", "b"), ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
    given = texts.join(asked, ["a", "b"]).select("a", "b", "text", "asked")
    held = items.agg(F.sum(F.size("codes") * 8 + 64)).first()[0] or 0
    found = _aligned_here(given, items, least) if held <= SMALL else _aligned_there(given, items, least)
    found = found.dropDuplicates(["a", "b", "item_id", "start_word", "end_word"])
    return found.join(texts.select("a", "b", "id"), ["a", "b"]).select("a", "b", "id", "item_id", "similarity", "score", "start_word", "end_word")


def _stretches(pdf: pd.DataFrame, seen: dict) -> Iterator[tuple]:
    """(a, b, unit, lo, codes) of the windows of texts in which an item may lie."""
    for a, b, text, asked in zip(pdf["a"], pdf["b"], pdf["text"], pdf["asked"], strict=True):
        codes = codes_of(text, seen).view(np.int64)
        for x in asked:
            for lo, hi in seed_windows(list(x["starts"]), x["words"], max(4, x["words"] // 4), len(codes)):
                yield a, b, x["unit"], lo, codes[lo:hi]


def _passage(words: np.ndarray, stretch: np.ndarray, least: float) -> tuple | None:
    """(similarity, score, start, end) of an item's best alignment in a stretch, if it counts."""
    # no alignment matches more words than occur in the stretch
    if np.isin(words, stretch).sum() < least * len(words):
        return None
    score, matches, _, _, start, end = align(words, stretch)
    whole = max(len(words), end - start)
    return (matches / whole, score, start, end) if matches >= least * whole else None


COLUMNS = ["a", "b", "item_id", "similarity", "score", "start_word", "end_word"]


def _aligned_here(given: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Passages of (a, b, text, asked) rows, with items that are few enough to be broadcast."""
    shared = given.sparkSession.sparkContext.broadcast({r["unit"]: (r["item_id"], np.array(r["codes"], dtype=np.int64)) for r in items.collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            out = []
            for a, b, unit, lo, stretch in _stretches(pdf, seen):
                item, words = shared.value[unit]
                got = _passage(words, stretch, least)
                if got:
                    out.append((a, b, item, got[0], got[1], lo + got[2], lo + got[3]))
            yield pd.DataFrame(out, columns=COLUMNS)

    return given.mapInPandas(run, FOUND)


def _aligned_there(given: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """The same with windows that go to their items, whose rows a join brings."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            out = []
            for a, b, unit, lo, stretch in _stretches(pdf, seen):
                out.append((a, b, unit, lo, stretch.tolist()))
                if len(out) == 2000:
                    yield pd.DataFrame(out, columns=["a", "b", "unit", "lo", "stretch"])
                    out = []
            yield pd.DataFrame(out, columns=["a", "b", "unit", "lo", "stretch"])

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                got = _passage(np.asarray(r.codes), np.asarray(r.stretch), least)
                if got:
                    out.append((r.a, r.b, r.item_id, got[0], got[1], r.lo + got[2], r.lo + got[3]))
            yield pd.DataFrame(out, columns=COLUMNS)

    both = given.mapInPandas(windows, "a long, b long, unit long, lo int, stretch array<long>").join(items, "unit")
    return both.select("a", "b", "item_id", "lo", "codes", "stretch").mapInPandas(aligned, FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The documents that hold no passage of an item, with all their columns; null and empty texts stay."""
    found = checkpoint(contaminated_pairs(docs, benchmark, id_col, text_col, **more).select("a", "b").distinct())
    at = docs.columns
    a, b = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")), F.xxhash64(F.col(text_col).cast("string"), F.col(id_col).cast("long"))
    marked = docs.select(F.struct(*at).alias("row_"), a.alias("a_"), b.alias("b_"))
    return marked.join(found, (F.col("a_") == F.col("a")) & (F.col("b_") == F.col("b")), "left_anti").select("row_.*")
