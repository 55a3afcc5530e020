"""From signals to a decision: summary of rules, tiers, merge with a model's verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.config import DEFAULTS, Defaults


def basic_summary(requests: DataFrame, kept_hits: DataFrame, light: DataFrame, frames: DataFrame) -> DataFrame:
    """(request_id, risk, strong, hit_category, n_hits): risk by a kept hit, the light model or a frame outside the whitelist.

    ``kept_hits`` has kind and category, ``light`` has violation, ``frames`` has whitelisted; a strong signal is a
    literal hit or the light model's. The category is that of the first kept hit, ``n_hits`` their number.
    """
    h = kept_hits.groupBy("request_id").agg(F.bool_or(F.col("kind") == "literal").alias("literal"), F.min_by("category", F.struct("start", "end", "category", "word")).alias("hit_category"), F.count("*").alias("n_hits"))
    f = frames.groupBy("request_id").agg(F.bool_or(~F.col("whitelisted")).alias("unknown_frame"))
    rows = requests.select("request_id").join(h, "request_id", "left").join(light.select("request_id", F.col("violation").alias("light")), "request_id", "left").join(f, "request_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    light_hit, literal = no(F.col("light")), no(F.col("literal"))
    return rows.select("request_id", (F.col("literal").isNotNull() | light_hit | no(F.col("unknown_frame"))).alias("risk"), (literal | light_hit).alias("strong"), "hit_category", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def tier(confidence: Column, low: Column | float = DEFAULTS.confidence_low, high: Column | float = DEFAULTS.confidence_high) -> Column:
    """safe below low, violation above high, llm between and at both."""
    return F.when(confidence < low, "safe").when(confidence > high, "violation").otherwise("llm")


def finite_or(value: Column, default: float) -> Column:
    """An override if it is a finite number, else the default."""
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(good, value).otherwise(F.lit(default))


def merge(semantic: Column, triggered: Column, category: Column, verdict: Column, weight: float = DEFAULTS.llm_weight) -> Column:
    """struct(has_violation, confidence, category, source): a verdict, if there is one, weighed with the semantic confidence."""
    w = min(1.0, max(0.0, weight))
    sure = F.coalesce(verdict["confidence"], semantic)
    return F.when(
        verdict.isNotNull(),
        F.struct(verdict["is_violation"].alias("has_violation"), (w * sure + (1 - w) * semantic).alias("confidence"), F.coalesce(verdict["category"], category).alias("category"), F.lit("llm").alias("source")),
    ).otherwise(F.struct(triggered.alias("has_violation"), semantic.alias("confidence"), category.alias("category"), F.lit("semantic").alias("source")))


def without_retrieval(strong: Column, category: Column, hit_category: Column) -> Column:
    """The decision where retrieval has no answer: a strong signal is a violation, all else is safe; confidence zero."""
    return F.struct(strong.alias("has_violation"), F.lit(0.0).alias("confidence"), F.when(strong, F.coalesce(category, hit_category)).alias("category"), F.lit("semantic").alias("source"))


def detail_for(key_tier: Column, detail: Column) -> Column:
    return F.when(key_tier == "full", detail)


def permanent_list(hashes: DataFrame, listed: DataFrame) -> DataFrame:
    """(request_id, verdict): black if any hash of a request is on the black list, else white if any is on the white one."""
    met = hashes.join(listed, "hash").groupBy("request_id").agg(F.bool_or(F.col("color") == "black").alias("black"))
    return met.select("request_id", F.when(F.col("black"), "black").otherwise("white").alias("verdict"))


def decide(signals: DataFrame, basic: DataFrame, verdicts: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """(request_id, tier, has_violation, confidence, category, source) from signals, rule summary and model verdicts.

    In order: a request without any basic risk passes, whatever lies near it; where retrieval has no answer a strong signal
    decides; below ``low`` it is safe, without a category; above ``high`` a violation; between them a verdict counts, if
    there is one. Signals may have ``low`` and ``high``, thresholds of a row's own; ``basic`` may have ``skip_llm``, whose
    rows take no verdict.
    """
    own = [c for c in ("low", "high") if c in signals.columns]
    rows = basic.join(signals.select("request_id", F.col("confidence").alias("semantic"), "triggered", F.col("category").alias("semantic_category"), *own), "request_id", "left")
    rows = rows.join(verdicts.select("request_id", F.struct("is_violation", "category", "confidence").alias("verdict")), "request_id", "left")
    semantic, category, risk = F.col("semantic"), F.col("semantic_category"), F.col("risk")
    verdict = F.when(~F.coalesce("skip_llm", F.lit(False)), F.col("verdict")) if "skip_llm" in basic.columns else F.col("verdict")
    rows = rows.withColumn("verdict", verdict)
    level = tier(semantic, F.coalesce("low", F.lit(d.confidence_low)) if own else d.confidence_low, F.coalesce("high", F.lit(d.confidence_high)) if own else d.confidence_high)
    none = F.lit(None).cast("string")
    outcome = lambda hit, confidence, kind, source: F.struct(F.lit(hit).alias("has_violation"), confidence.alias("confidence"), kind.alias("category"), F.lit(source).alias("source"))
    decided = (
        F.when(~risk, outcome(False, F.lit(0.0), none, "basic_rules_pass"))
        .when(semantic.isNull(), without_retrieval(F.col("strong"), category, F.col("hit_category")))
        .when(level == "safe", outcome(False, semantic, none, "semantic"))
        .when(level == "violation", outcome(True, semantic, category, "semantic"))
        .otherwise(merge(semantic, F.col("triggered"), category, F.col("verdict"), d.llm_weight))
    )
    return rows.withColumn("out", decided).select("request_id", F.when(risk & semantic.isNotNull(), level).alias("tier"), "out.*")


OVERRIDES = ["semantic_threshold", "margin_w", "confidence_low", "confidence_high"]


def with_overrides(signals: DataFrame, overrides: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """Signals judged by thresholds of each request's own: (request_id, *OVERRIDES), where finite, else the defaults.

    Gives margin, confidence and triggered anew, and ``low`` and ``high`` for ``decide``.
    """
    rows = signals.drop("margin", "confidence", "triggered").join(overrides.select("request_id", *OVERRIDES), "request_id", "left")
    threshold, margin_w, low, high = (finite_or(F.col(c), getattr(d, c)) for c in OVERRIDES)
    margin = F.greatest(F.lit(0.0), F.col("black_avg") - F.col("white_avg") - margin_w)
    rows = rows.select(*(c for c in rows.columns if c not in OVERRIDES), margin.alias("margin"), low.alias("low"), high.alias("high"), threshold.alias("threshold"))
    raw = d.w_top * F.col("black_top") + d.w_margin * F.col("margin") / d.margin_norm
    near = (F.col("black_top") >= F.col("threshold")) & (F.col("black_top") - F.col("white_top") >= d.black_white_gap)
    confidence = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return rows.withColumn("confidence", confidence).withColumn("triggered", near | (F.col("margin") > 0)).drop("threshold")


def semantic_detail(signals: DataFrame) -> DataFrame:
    """(request_id, black_top, white_top, margin) as answers show them: tops as lists of one, the plain gap of the averages to six digits, nulls where retrieval had no answer."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<double>"))
    return signals.select("request_id", one("black_top").alias("black_top"), one("white_top").alias("white_top"), F.round(F.col("black_avg") - F.col("white_avg"), 6).alias("margin"))


def exempted_detail(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, category, word, start, end, reason) of exempted hits; the reason is the rule's note, else its pattern."""
    why = rules.select(F.col("id").alias("rule_id"), F.coalesce(F.nullif(F.col("note"), F.lit("")), "pattern").alias("reason"))
    return judged.where("rule_id IS NOT NULL").join(why, "rule_id").select("request_id", "category", "word", "start", "end", "reason")


def to_judge(decided: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """(text_hash, text, n): what a judging model is asked, of (request_id, text_hash, text, tier) rows in the llm tier.

    A short text that several requests share is asked once; longer ones are asked for each request, with n = 1.
    """
    rows = decided.where("tier = 'llm'").withColumn("own", F.when(F.length("text") > d.short_text, F.col("request_id")))
    return rows.groupBy("text_hash", "own").agg(F.first("text").alias("text"), F.count("*").alias("n")).drop("own")
