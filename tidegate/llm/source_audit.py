"""How far the sources of a language differ in their words: wide term vectors, compared pair by pair of sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint

WHOLE = 1_000_000_000
#: For each byte what stands for it: letters of ASCII in lower case, all else of ASCII a space, the rest itself.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
MOST_HELD = 400_000  # counts that a task keeps before it hands them on
MOST_NAMES = 1_000_000  # sources of all languages that are broadcast


def share(count: Column, total: Column, kept: Column, prior: int) -> Column:
    """1 + floor(10^9 (count + prior) / (total + prior * kept)), exact: whole decimals all the way."""
    up = F.lit(WHOLE).cast("decimal(10,0)") * (count + prior).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", up, (total + kept * prior).cast("decimal(29,0)"))


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term, summed by task as far as ``MOST_HELD`` reaches.

    In UTF-8 what parts terms is single bytes, so a text is folded and parted as bytes, without looking at its letters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        n = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, within) in held.items():
                terms = list(times)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()), "term": pa.array(terms, pa.binary()).cast(pa.string()),
                    "n": pa.array(list(times.values()), pa.int64()), "docs": pa.array([within[t] for t in terms], pa.int64()),
                })

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = text.encode().translate(FOLDED).split()
                times, within = held.setdefault((lang, source), (Counter(), Counter()))
                n -= len(times)
                times.update(terms)
                within.update(set(terms))
                n += len(times)
                if n > MOST_HELD:
                    yield from rows()
                    held, n = {}, 0
        yield from rows()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def wide_vectors(counts: DataFrame, sources: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, v): each kept term's occurrences by source, in the order of the language's ``sources`` (lang, names).

    Counts of a term meet once, so that neither the sums by source nor those of the language move them again.
    """
    own = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = own.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m")).where(F.col("docs") >= min_docs)
    return rows.join(sources, "lang").select("lang", "term", F.transform("names", lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0))).alias("v"))


def divergence(docs: DataFrame, min_docs: int = 30, prior: int = 5, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's words lie from those of the others of its language.

    Terms are runs of ASCII letters (A-Z lower-cased) and of all that isn't ASCII; a language keeps those in at least ``min_docs``
    of its documents. Each source and the whole language give each kept term its smoothed share, in billionths. Part ``pair``
    has every other source of the language with the summed difference of shares (0 without kept terms); part ``term`` the
    ``top`` terms that the source has and uses more than the language does, by difference. Equal values rank by item in
    UTF-8. Null text, language and source are empty ones; rows that repeat an id are documents of their own; an empty
    table gives no rows; a text of any length is one row; other columns don't matter.

    A kept term is one row with an array over the language's sources, so it costs the square of the number of sources
    in sums and nothing is paired but sources, which the result holds pair by pair anyway.
    """
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))))
    sources = checkpoint(groups.distinct().groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("names")))
    # broadcast only if what it holds is few; the kept terms of a language then stay where they are
    few = (sources.agg(F.sum(F.size("names") + F.length(F.array_join("names", "")) / 100)).first()[0] or 0) <= MOST_NAMES
    small = F.broadcast if few else (lambda df: df)
    wide = checkpoint(wide_vectors(term_counts(docs, text_col, lang_col, source_col), small(sources), min_docs))
    # per language: V, and N of each source, summed place by place
    sums = wide.select("lang", F.posexplode("v").alias("k", "n")).groupBy("lang", "k").agg(F.sum("n").alias("n"), F.count("*").alias("kept"))
    totals = sums.groupBy("lang").agg(F.max("kept").alias("kept"), F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]).alias("totals"))
    langs = checkpoint(sources.join(totals, "lang", "left").select("lang", "names", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("totals", F.transform("names", lambda _: F.lit(0).cast("long"))).alias("totals")))
    p = F.zip_with("v", "totals", lambda n, total: share(n, total, F.col("kept"), prior))
    shares = wide.join(small(langs.where("kept > 0")), "lang").select("lang", "term", "v", "names", p.alias("p"), "totals", "kept")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)

    place = F.sequence(F.lit(0), F.size("names") - 1)
    pairs = F.flatten(F.transform(place, lambda a: F.transform(F.filter(place, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"), F.abs(F.get("p", a) - F.get("p", b)).alias("f")))))
    none = langs.select("lang", "names", F.transform("names", lambda _: F.lit(0).cast("long")).alias("p"))  # pairs of languages without terms
    met = shares.select("lang", "names", "p").unionByName(none).select("lang", F.inline(pairs)).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    named = met.join(small(langs.select("lang", "names")), "lang").select("lang", F.get("names", F.col("a")).alias("x"), F.get("names", F.col("b")).alias("y"), "value")
    both = named.select("lang", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("s"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))

    q = share(total(F.col("v")), total(F.col("totals")), F.col("kept"), prior)
    above = F.filter(F.zip_with(F.arrays_zip("names", "v"), "p", lambda x, own: F.struct(x["names"].alias("source"), x["v"].alias("n"), (own - F.col("q")).alias("value"))), lambda x: (x["n"] > 0) & (x["value"] > 0))
    rows = shares.withColumn("q", q).select("lang", F.col("term").alias("item"), F.inline(above)).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    term = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.unionByName(term)
