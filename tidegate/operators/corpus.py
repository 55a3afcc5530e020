"""Preparation of corpora: manifests, keep-first dedup, conflicts, balanced samples, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")


def pool_of(category, normal: str = "normal"):
    return F.when(category == normal, "white").otherwise("black")


def manifest_ids(rows: DataFrame) -> DataFrame:
    """Valid rows (line_no, pool, text, image_path) with id ``pool:n``, numbered from 1 in file order.

    Rows of an unknown pool, and those with neither a text nor an image, are left out. Numbers are counted by range
    of lines: each range counts its own, and only the ranges' totals are summed in order.
    """
    good = rows.where("pool IN ('black', 'white') AND (trim(coalesce(text, '')) <> '' OR image_path IS NOT NULL)")
    part = F.floor(F.col("line_no") / 100_000)
    own = good.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("pool", "part").orderBy("line_no")))
    before = own.groupBy("pool", "part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("pool").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(before.select("pool", "part", "before"), ["pool", "part"]).withColumn("id", F.concat_ws(":", "pool", F.col("before") + F.col("k"))).drop("part", "k", "before")


def manifest_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both manifests one after the other, the first of each (pool, text)."""
    both = first.withColumn("file", F.lit(0)).unionByName(second.withColumn("file", F.lit(1)))
    return keep_first(both.withColumn("place", F.struct("file", "line_no")), ["pool", "text"], "place").drop("place")


def pool_conflicts(rows: DataFrame) -> DataFrame:
    """Texts that are in both pools."""
    return rows.where("pool = 'black'").select("text").intersect(rows.where("pool = 'white'").select("text"))


def balanced_sample(rows: DataFrame, n: int) -> DataFrame:
    """black[0], white[0], black[1], ... up to ``n`` rows; a pool that has run out is passed over.

    Of a pool only the first ``n`` rows can be drawn, so every task hands on that many of each at most.
    """
    return first_of_each(rows, ["pool"], ["line_no"], n).withColumnRenamed("place", "turn").orderBy("turn", "pool").limit(n)


def first_of_each(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``place`` from 1: tasks keep ``k`` rows a group, and those are merged."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def sample_examples(rows: DataFrame, n: int = 20, head: int = 400, most_chars: int = 200, seed: int = 7) -> DataFrame:
    """``n`` texts drawn by a hash with a seed from the first ``head`` short ones of each pool; a text in both pools is black's."""
    short = rows.where((F.length("text") <= most_chars) & (F.trim("text") != ""))
    heads = first_of_each(short, ["pool"], ["line_no"], head).drop("place")
    return keep_first(heads, ["text"], "pool").orderBy(F.md5(F.concat("text", F.lit(str(seed)))), "text").limit(n)


def corpus_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pool").agg(F.count("*").alias("raw"), F.countDistinct("text").alias("unique_texts"), (F.count("*") - F.countDistinct("text")).alias("dropped"), F.countDistinct("source").alias("sources"))


def lexicon_by_category(words: DataFrame) -> DataFrame:
    return words.groupBy("category").agg(F.countDistinct(F.trim("word")).alias("n_words"))


def distinct_categories(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim("category").alias("category")).where("category <> ''").distinct()


def resume(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose id isn't done yet."""
    return rows.join(done.select("id"), "id", "left_anti")


def fresh_rows(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``new`` to insert: of each key that the table lacks the first in order, found within the tasks before they meet."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
    return first.join(table.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(inserted, skipped) rows of ``new``: the first of each key that the table lacks is inserted."""
    fresh = fresh_rows(table, new, keys, order)
    return new.agg(F.count("*").alias("total")).crossJoin(fresh.agg(F.count("*").alias("inserted"))).select("inserted", (F.col("total") - F.col("inserted")).alias("skipped"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table with rows of ``new`` in place of those of the same key; of several the last in order stands."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    latest = new.withColumn("n_", F.row_number().over(last)).where("n_ = 1").drop("n_")
    return table.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without rows of those keys."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def metadata_text(text, most: int = 200):
    """What a vector's metadata keeps of its text: the first ``most`` letters."""
    return F.substring(text, 1, most)


def knowledge_version(words: DataFrame, rules: DataFrame, revision: int) -> DataFrame:
    """kw{largest word id}-r{largest rule id}-rev{revision}"""
    both = words.agg(F.coalesce(F.max("id"), F.lit(0)).alias("w")).crossJoin(rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("r")))
    return both.select(F.concat(F.lit("kw"), F.col("w"), F.lit("-r"), F.col("r"), F.lit(f"-rev{revision}")).alias("version"))
