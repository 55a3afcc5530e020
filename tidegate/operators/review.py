"""Review of sampled decisions against a second opinion, and what it suggests for the thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.config import DEFAULTS, Defaults


def agreement(sample: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row of counts and rates: sampled rows joined with second verdicts; those without one have failed."""
    v, o = F.col("is_violation"), F.col("has_violation")
    rows = sample.select("request_id", "has_violation").join(verdicts.select("request_id", "is_violation"), "request_id", "left")
    s = rows.agg(
        F.count("*").alias("sampled"),
        F.count(v).alias("reviewed"),
        F.count_if(v == o).alias("consistent"),
        F.count_if(v & o).alias("agree_violation"),
        F.count_if(v.isNotNull() & o).alias("orig_violations"),
        F.count_if(v & ~o).alias("missed"),
        F.count_if(~v & o).alias("false_alarm"),
        F.count_if(v.isNull()).alias("judge_failed"),
    )
    rate = lambda part, whole: F.when(whole > 0, part / whole)
    c = F.col
    return s.select(
        "*",
        rate(c("consistent"), c("reviewed")).alias("consistent_rate"),
        rate(c("agree_violation"), c("orig_violations")).alias("violation_agree_rate"),
        rate(c("consistent") - c("agree_violation"), c("reviewed") - c("orig_violations")).alias("safe_agree_rate"),
    )


def suggest(stats: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """Stats with ``action`` and the thresholds it would give: raise, lower or hold, within 0 and 1, two digits.

    What decides is how far the second opinion agrees where the first was a violation; without such rows, hold.
    """
    rate = F.col("violation_agree_rate")
    within = lambda x: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(x))), 2)
    agrees, differs = F.coalesce(rate >= d.review_agree_high, F.lit(False)), F.coalesce(rate <= d.review_agree_low, F.lit(False))
    move = lambda now, step: F.when(agrees, within(now + step)).when(differs, within(now - step)).otherwise(F.lit(now))
    action = F.when(agrees, "raise_high").when(differs, "lower_high").otherwise("hold")
    return stats.select("*", action.alias("action"), move(d.confidence_high, d.review_step).alias("confidence_high"), move(d.confidence_low, -d.review_step).alias("alternative_low"))


def watch(stats: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """Band statistics with what to watch where no text can be judged again: a high or low share of violations."""
    return stats.withColumn("watch", F.when(F.col("share") >= d.share_high, "high").when(F.col("share") <= d.share_low, "low"))


def report(sample: DataFrame, verdicts: DataFrame | None, band: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """One row: mode, skipped_reason, sampled, text_missing, the counts and rates of ``agreement``, action and thresholds.

    Without a judging model (no ``verdicts``) nothing is sampled: statistical, llm_unavailable. Without samples: statistical,
    no_samples. Where no text can be judged again: statistical, text_unavailable, and what to watch in the band's share of
    violations is the suggestion. Else full, over the rows that have a text. ``sample`` has ``text``, ``band`` is one row of
    ``band_stats``. Without a full review nothing is reviewed and there is no rate.
    """
    spark = sample.sparkSession
    judged = verdicts if verdicts is not None else spark.createDataFrame([], "request_id string, is_violation boolean")
    rows = sample if verdicts is not None else sample.limit(0)
    texts = rows.agg(F.count("*").alias("sampled_"), F.count_if(F.col("text").isNull()).alias("text_missing"))
    stats = suggest(agreement(rows.where("text IS NOT NULL"), judged), d).drop("sampled")
    none, lost = F.col("sampled") == 0, F.col("text_missing") == F.col("sampled")
    why = F.when(F.lit(verdicts is None), "llm_unavailable").when(none, "no_samples").when(lost, "text_unavailable")
    one = texts.withColumnRenamed("sampled_", "sampled").crossJoin(stats).crossJoin(watch(band, d).select("share", "watch")).withColumn("skipped_reason", why)
    full = F.col("skipped_reason").isNull()
    statistical = F.when((F.col("skipped_reason") == "text_unavailable") & F.col("watch").isNotNull(), "watch").when(full, F.col("action"))
    at = F.when(F.col("watch") == "high", "confidence_high").when(F.col("watch") == "low", "confidence_low")
    out = one.withColumns({"mode": F.when(full, "full").otherwise("statistical"), "action": statistical, "watched": F.when(F.col("skipped_reason") == "text_unavailable", at)})
    only = ["reviewed", "consistent", "agree_violation", "orig_violations", "missed", "false_alarm", "judge_failed"]
    out = out.withColumns({c: F.when(full, F.col(c)).otherwise(F.lit(0)) for c in only}).withColumns({c: F.when(full, F.col(c)) for c in ("consistent_rate", "violation_agree_rate", "safe_agree_rate", "confidence_high", "alternative_low")})
    return out.select("mode", "skipped_reason", "sampled", "text_missing", *only, "consistent_rate", "violation_agree_rate", "safe_agree_rate", "action", "watched", "confidence_high", "alternative_low", F.when(~none, F.col("share")).alias("share"))


def write_report(report: DataFrame, folder: str, ts: str) -> str:
    """The report as one line of JSON in ``folder``/<ts with - for :>.json, one row by construction; the path."""
    path = f"{folder.rstrip('/')}/{ts.replace(':', '-')}.json"
    report.withColumn("ts", F.lit(ts)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path
