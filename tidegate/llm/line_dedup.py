"""Line dedup: two Bloom filters pick the lines that may repeat; only those are shuffled and confirmed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import ASCII_SPACE, checkpoint

CHUNK = 1 << 15  # bytes of a filter that travel as one row
PROBES = 3
MOST_HOT = 1000


def line_key(line: str, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space, ASCII letters lower-cased; None if it is too short to count."""
    line = line.strip(ASCII_SPACE)
    return line.encode().lower() if len(line) >= min_chars else None


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    return list({k for line in (text or "").split("\n") if (k := line_key(line, min_chars)) is not None})


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row each: double hashing over the halves of the 64."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(k) * b) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) for k in range(PROBES)], axis=1).astype(np.int64)


def _test(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=1)


def _put(bitmap: np.ndarray, slots: np.ndarray) -> None:
    slots = slots.ravel()
    np.bitwise_or.at(bitmap, slots >> 3, np.left_shift(np.uint8(1), (slots & 7).astype(np.uint8)))


class TwiceSeen:
    """A filter of what was seen once and one of what was seen twice. No key seen twice is ever missed."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        values, counts = np.unique(hashes, return_counts=True)
        slots = _slots(values, self.bits)
        _put(self.twice, slots[(counts > 1) | _test(self.once, slots)])
        _put(self.once, slots)

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        once, twice = self.once.reshape(-1, min(CHUNK, len(self.once))), self.twice.reshape(-1, min(CHUNK, len(self.twice)))
        for k in np.nonzero(once.any(axis=1))[0]:
            yield int(k), once[k].tobytes(), twice[k].tobytes()


def filter_bits(chars: int, most: int) -> int:
    """Bits (as a power of two) for a text of so many characters: four for each line that could count, within 2**most."""
    return int(min(most, max(16, np.ceil(np.log2(max(1, chars) / 41 * 4)))))


def suspected(docs: DataFrame, text_col: str, min_chars: int, most_bits: int) -> tuple[bytes, int]:
    """The filter of the line hashes that were seen twice, and its bits. Its size is at most ``2**most_bits / 8`` bytes."""
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    bits = filter_bits(chars, most_bits)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = TwiceSeen(bits)
        for pdf in batches:
            seen.add(np.array([xxhash.xxh64_intdigest(k) for t in pdf["text"] for k in _keys(t, min_chars)], dtype=np.uint64))
        rows = []
        for row in seen.chunks():
            rows.append(row)
            if len(rows) == 64:
                yield pd.DataFrame(rows, columns=["chunk", "once", "twice"])
                rows = []
        yield pd.DataFrame(rows, columns=["chunk", "once", "twice"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Seen twice in a part, or once in two parts. A task holds only its own chunks, however many parts there are."""
        have: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for k, once, twice in zip(pdf["chunk"], pdf["once"], pdf["twice"], strict=True):
                a, b = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
                if k in have:
                    have[k] = [have[k][0] | a, have[k][1] | b | (have[k][0] & a)]
                else:
                    have[k] = [a, b]
        for k, (_, b) in have.items():
            yield pd.DataFrame({"chunk": [k], "twice": [b.tobytes()]})

    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(build, "chunk int, once binary, twice binary")
    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = min(CHUNK, len(whole))
    for row in parts.repartition("chunk").mapInPandas(merge, "chunk int, twice binary").toLocalIterator():
        whole[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["twice"], np.uint8)
    return whole.tobytes(), bits


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, most_bits: int = 30) -> DataFrame:
    """(id, drop): for each document that loses lines, the keys (128-bit) of the lines it loses.

    Only keys that the filter suspects are shuffled, as (key, id) rows without text. Distinct ids are counted in
    two aggregations, so that a line held by a third of all documents is summed before it meets; its rows are
    joined where they lie, as the hot keys (``MOST_HOT`` at most) are broadcast.
    """
    bitmap, bits = suspected(docs, text_col, min_chars, most_bits)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        twice = np.frombuffer(shared.value, np.uint8)
        for pdf in batches:
            keys, ids = [], []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                own = _keys(t, min_chars)
                keys += own
                ids += [i] * len(own)
            if not keys:
                continue
            hit = np.nonzero(_test(twice, _slots(np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64), bits)))[0]
            yield pd.DataFrame({"key": [xxhash.xxh128_digest(keys[k]) for k in hit], "id": pd.array([ids[k] for k in hit], dtype="Int64")})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(probe, "key binary, id long")
    rows = checkpoint(rows.distinct())
    many = rows.groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).select(F.col("key").alias("k"), "last", "n")
    # a key with over a MOST_HOT-th of the rows is hot; there can't be more than MOST_HOT of them
    hot = F.col("n") * MOST_HOT > rows.count()
    often = F.broadcast(many.where(hot))
    rest = rows.join(often, rows["key"] == often["k"], "left_anti")
    few = many.where(~hot)
    met = rows.join(often, rows["key"] == often["k"]).unionByName(rest.join(few, rest["key"] == few["k"]))
    return met.where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id").agg(F.collect_list("key").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, most_bits: int = 30, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, kept (the text without its repeated lines), n_lines, n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least ``min_chars``
    code points that at least ``min_docs`` documents hold lose all their lines, save those of the largest id that
    holds them. Null and empty texts are one empty line, and stay. Rows that repeat an id count as one document
    and are each returned; rows with a null id count as no document but lose repeated lines. An empty table gives
    no rows. A document's keys meet in one list, which is no longer than the document. Columns named in ``carry``
    are returned as they are.
    """
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs, most_bits)
    more = [f"carried_{k}" for k in range(len(carry))]
    left = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *(F.col(c).alias(x) for c, x in zip(carry, more, strict=True)))
    both = left.join(drops, F.col("doc").eqNullSafe(F.col("id")), "left").select("doc", "text", "drop", *more)
    kinds = dict(left.dtypes)

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, drop in zip(pdf["text"], pdf["drop"], strict=True):
                lines = (t or "").split("\n")
                if drop is None or not len(drop):
                    out.append((t or "", len(lines), 0))
                    continue
                gone = set(drop)
                kept = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh128_digest(k) not in gone]
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            got = pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])
            got.insert(0, "id", pd.array(pdf["doc"], dtype="Int64"))
            for x in more:
                got[x] = pdf[x].to_numpy()
            yield got

    out = both.mapInPandas(strip, ", ".join(["id long, kept string, n_lines long, n_dropped long", *(f"{x} {kinds[x]}" for x in more)]))
    return out.select("id", "kept", "n_lines", "n_dropped", *(F.col(x).alias(c) for c, x in zip(carry, more, strict=True)))
