"""Best-fit packing of documents into training sequences, with sources and duplicate clusters kept apart."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each (size, source, cluster), given largest first.

    Bins stand in order of what is left in them. Each holds a bitmap of its sources and one of its clusters; from
    the tightest bin with room on, the first that shares neither with the item takes it, else a new one does.
    Bins too full for the smallest item are put away. None as a source or cluster stands in no one's way.
    """
    bits: dict[tuple[str, object], int] = {}
    bit = lambda kind, x: 0 if x is None else 1 << bits.setdefault((kind, x), len(bits))
    least = min((size for size, *_ in items), default=0)
    open_bins: list[tuple[int, int]] = []  # (room, bin)
    held: list[int] = []
    out = []
    for size, source, cluster in items:
        own = bit("source", source) | bit("cluster", cluster)
        k = bisect_left(open_bins, (size, -1))
        while k < len(open_bins) and held[open_bins[k][1]] & own:
            k += 1
        if k < len(open_bins):
            room, b = open_bins.pop(k)
        else:
            room, b = capacity, len(held)
            held.append(0)
        held[b] |= own
        if room - size >= least:
            insort(open_bins, (room - size, b))
        out.append(b)
    return out


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, start, length, source, cluster): documents longer than a bin are cut; all but the last piece fill one. With ``words``, also the piece's text."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")

    def piece(k):
        start = k.cast("long") * capacity
        length = F.least(F.lit(capacity), F.col("size") - start).cast("int")
        text = [F.array_join(F.slice("words", (start + 1).cast("int"), length), "").alias("text")] if "words" in sizes.columns else []
        return F.struct(k.alias("piece"), start.alias("start"), length.alias("length"), *text)

    # pieces are cut before they part, so that none carries the words of its whole document
    return sizes.select("id", "source", "cluster", F.inline(F.transform(F.sequence(F.lit(0), n - 1), piece)))


def pack(sizes: DataFrame, capacity: int = 1024, group_rows: int = 4096) -> DataFrame:
    """(id, piece, start, length, bin) of (id, size, source, cluster) rows: every part of every document, once.

    With a ``words`` column (each word with the white space behind it) the text of each piece comes along. Rows are
    dealt by hash into groups of about ``group_rows`` and each is packed by itself, largest first: at most the last
    bins of a group are left emptier than they would be; the README has the figures. A bin never holds two pieces
    that share a source or a cluster, nor more than ``capacity``. Null sources and clusters share nothing. Rows of
    size zero or null take part with length zero. Repeated rows are each packed, dealt by their place in the table;
    an empty table gives no rows.
    """
    words = ["words"] if "words" in sizes.columns else []
    rows = sizes.select("id", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), F.col("source").cast("string"), F.col("cluster").cast("long"), *words)
    parts = checkpoint(pieces(rows, capacity))
    text = ["text"] if words else []
    groups = max(1, -(-parts.count() // group_rows))
    # rows that repeat an id would meet in one group; a salt that hangs on nothing but the row's place spreads them
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        known = lambda s: [None if pd.isna(x) else x for x in s]
        bins = best_fit(list(zip(pdf["length"].tolist(), known(pdf["source"]), known(pdf["cluster"]), strict=True)), capacity)
        out = pdf[["id", "piece", "start", "length", *text]].copy()
        out["bin"] = [f"{s}-{b}" for s, b in zip(pdf["shard"], bins, strict=True)]
        return out

    return dealt.groupBy("shard").applyInPandas(run, "id long, piece int, start long, length int, " + "".join(f"{c} string, " for c in text) + "bin string")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", clusters: DataFrame | None = None, words: bool = False) -> DataFrame:
    """(id, size, source, cluster): the number of words, and the duplicate cluster of each document.

    ``clusters`` is (id, component), as near-duplicate search gives it; documents that it lacks, and all without it, have
    equal texts (whatever their case) as one cluster. With ``words``, each word and the white space behind it, too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.col(source_col).alias("source"), F.xxhash64(F.lower(text)).alias("equal"))
    if words:
        rows = rows.withColumn("words", F.regexp_extract_all("t", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)))
        rows = rows.withColumn("size", F.size("words")).drop("t")
    else:
        rows = rows.withColumn("size", F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+"))).drop("t")
    if clusters is None:
        return rows.withColumnRenamed("equal", "cluster").select("id", "size", "source", "cluster", *["words"] * words)
    known = clusters.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("component").alias("component"))
    return rows.join(known, "id", "left").select("id", "size", "source", F.coalesce("component", "equal").alias("cluster"), *["words"] * words)
