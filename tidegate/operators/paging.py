"""Pages of large tables: rows stored by ranges of an order with their positions, so that a page reads its own ranges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order of each list that is paged: (column, downwards).
ORDERS = {
    "keys": [("created_at", False), ("key", False)],
    "keywords": [("category", False), ("id", False)],
    "rules": [("id", False)],
    "settings": [("group", False), ("key", False)],
    "whitelist": [("id", False)],
    "logs": [("ts", True), ("request_id", True)],
}
LARGEST_PAGE = 500


def offset_of(page: int, size: int, largest: int = LARGEST_PAGE) -> int:
    """Where a page begins; pages count from 1."""
    if page < 1 or not 1 <= size <= largest:
        raise ValueError(f"page must be 1 or more, its size within 1 and {largest}")
    return (page - 1) * size


def _sorting(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]


@dataclass
class PageIndex:
    """A table in ``folder``, parted by ranges of its order, and how many rows stand before each range."""

    spark: SparkSession
    folder: str
    order: list[tuple[str, bool]]
    counts: list[int]

    @classmethod
    def build(cls, rows: DataFrame, order: list[tuple[str, bool]], folder: str, ranges: int = 200) -> PageIndex:
        """Write the rows in ``ranges`` ranges of the order, which has to tell any two rows apart. One count a range comes back."""
        sorting = _sorting(order)
        dealt = rows.repartitionByRange(ranges, *sorting).withColumn("range_", F.spark_partition_id())
        dealt.sortWithinPartitions(*sorting).write.mode("errorifexists").partitionBy("range_").parquet(folder)
        return cls.open(rows.sparkSession, folder, order, ranges)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, order: list[tuple[str, bool]], ranges: int = 200) -> PageIndex:
        found = {r["range_"]: r["n"] for r in spark.read.parquet(folder).groupBy("range_").agg(F.count("*").alias("n")).collect()}
        return cls(spark, folder, order, [found.get(k, 0) for k in range(max(ranges, max(found, default=0) + 1))])

    @property
    def total(self) -> int:
        return sum(self.counts)

    def rows(self, ranges: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.folder).where(F.col("range_").isin(ranges))

    def slice(self, offset: int, limit: int) -> DataFrame:
        """``limit`` rows from the place ``offset`` on, with ``place`` from 0: only the ranges that they lie in are read and sorted."""
        if limit < 1 or offset < 0:
            raise ValueError("limit must be 1 or more, offset 0 or more")
        before, held, first = 0, [], None
        for k, n in enumerate(self.counts):
            if n and before < offset + limit and before + n > offset:
                first = before if first is None else first
                held.append(k)
            before += n
        page = self.rows(held).orderBy(*_sorting(self.order)).offset(offset - (first or 0)).limit(limit)
        # a page is at most ``limit`` rows in one partition, in order
        return page.coalesce(1).select("*", (F.monotonically_increasing_id() + offset).alias("place")).drop("range_")

    def page(self, page: int, size: int) -> DataFrame:
        return self.slice(offset_of(page, size), size)

    def after(self, last: dict, limit: int) -> DataFrame:
        """The next ``limit`` rows behind the row whose order columns are ``last``: seek paging, of any depth, without places."""
        if limit < 1:
            raise ValueError("limit must be 1 or more")

        def beyond(k: int) -> Column:
            name, down = self.order[k]
            x, here = F.col(name), F.lit(last[name])
            # nulls are the least values
            further = (x < here) | (x.isNull() & here.isNotNull()) if down else (x > here) | (x.isNotNull() & here.isNull())
            same = [F.col(c).eqNullSafe(F.lit(last[c])) for c, _ in self.order[:k]]
            return reduce(Column.__and__, [*same, F.coalesce(further, F.lit(False))])

        behind = reduce(Column.__or__, (beyond(k) for k in range(len(self.order))))
        return self.spark.read.parquet(self.folder).where(behind).orderBy(*_sorting(self.order)).limit(limit).drop("range_")
