"""Audit-log queries: predicates, pages, counters, trends, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_filter(logs: DataFrame, start=None, end=None, has_violation=None, source=None, category=None, key_tier=None, min_confidence=None, max_confidence=None, hash_part=None) -> DataFrame:
    """Rows that meet all that is given: times inclusive, null confidences outside any range, part of a hash in any case."""
    tests = [
        None if start is None else F.col("ts") >= F.lit(start).cast("timestamp"),
        None if end is None else F.col("ts") <= F.lit(end).cast("timestamp"),
        None if has_violation is None else F.col("has_violation") == has_violation,
        None if source is None else F.col("source") == source,
        None if category is None else F.col("category") == category,
        None if key_tier is None else F.col("key_tier") == key_tier,
        None if min_confidence is None else F.col("confidence") >= min_confidence,
        None if max_confidence is None else F.col("confidence") <= max_confidence,
        None if hash_part is None else F.contains(F.lower("text_hash"), F.lit(hash_part.lower())),
    ]
    for t in tests:
        logs = logs if t is None else logs.where(t)
    return logs


def page(logs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, then by request id downwards."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be 1 or more, offset 0 or more")
    return logs.orderBy(F.desc("ts"), F.desc("request_id")).offset(offset).limit(limit)


def band_sample(logs: DataFrame, low: float = 0.35, high: float = 0.75, n: int = 50, scan: int = 50_000) -> DataFrame:
    """The newest ``n`` of the newest ``scan`` rows whose confidence lies in the band."""
    return page(page(logs, scan).where(F.col("confidence").between(low, high)), n)


def overview(logs: DataFrame, today: str, zone: str = "UTC") -> DataFrame:
    """(total, today, today_violations): today begins at midnight in the zone."""
    now = F.to_date(F.from_utc_timestamp("ts", zone)) == F.lit(today).cast("date")
    return logs.agg(F.count("*").alias("total"), F.count_if(now).alias("today"), F.count_if(now & F.col("has_violation")).alias("today_violations"))


def daily_trend(logs: DataFrame, last_day: str, days: int = 7, zone: str = "UTC") -> DataFrame:
    """(day, n, violations) of the last days, those without rows included."""
    spine = logs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last_day).cast("date"), days - 1), F.lit(last_day).cast("date"))).alias("day"))
    own = logs.groupBy(F.to_date(F.from_utc_timestamp("ts", zone)).alias("day")).agg(F.count("*").alias("n"), F.count_if("has_violation").alias("v"))
    return spine.join(own, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("violations"))


def band_stats(sample: DataFrame) -> DataFrame:
    """Counts, share of violations, and least, upper median and largest confidence of a bounded sample."""
    c = F.sort_array(F.collect_list("confidence"))
    n = F.count("*")
    return sample.agg(
        n.alias("total"),
        F.count_if("has_violation").alias("violations"),
        F.count_if(~F.col("has_violation")).alias("safes"),
        F.when(n > 0, F.bround(F.count_if("has_violation") / n, 3)).alias("share"),
        F.bround(F.min("confidence"), 3).alias("low"),
        F.bround(F.when(F.size(c) > 0, F.element_at(c, (F.size(c) / 2).cast("int") + 1)), 3).alias("median"),
        F.bround(F.max("confidence"), 3).alias("high"),
    )


def source_counts(sample: DataFrame) -> DataFrame:
    return sample.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def export(logs: DataFrame) -> DataFrame:
    """The nine columns of the CSV export, as text: booleans in lower case, nulls empty."""
    cols = ["request_id", "ts", "text_hash", "has_violation", "confidence", "category", "source", "detail_json", "key_tier"]
    return logs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols))
