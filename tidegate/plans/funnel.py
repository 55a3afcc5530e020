"""The moderation funnel: lists, lexicon and rules, fast pass, retrieval, tiers, verdicts, each over what the stages before left open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.config import DEFAULTS, Defaults
from tidegate.functions import text as T
from tidegate.operators import decisions, keywords, semantic
from tidegate.plans import errors
from tidegate.shared import checkpoint

KEPT = "violates OR rule_id IS NULL"


def scanned(requests: DataFrame, words: DataFrame, rules: DataFrame, d: Defaults, known: dict[str, str] | None) -> DataFrame:
    """(request_id, key_tier, skip_llm, text_hash, hits, error): the one pass over the texts; a blank text has no hash."""
    skip = F.coalesce("skip_llm", F.lit(False)) if "skip_llm" in requests.columns else F.lit(False)
    texts = requests.select("request_id", "key_tier", skip.alias("skip_llm"), T.normalize_text(F.col("text")).alias("text"))
    texts = texts.withColumn("text_hash", F.when(F.col("text") != "", F.sha2("text", 256)))
    return keywords.judged_texts(texts, words, rules, known, d.regex_window, carry=("key_tier", "skip_llm", "text_hash"))


def basic_state(scan: DataFrame, light: DataFrame | None, frames: DataFrame | None) -> DataFrame:
    """Scanned rows with what the rule layer says: risk, strong, hit_category, light_violation and image_whitelist.

    A literal hit or the light model's word is a strong signal; a hit of another kind or a frame that isn't whitelisted is
    a risk alone. The category is that of the first hit that no rule exempts.
    """
    kept = F.filter("hits", lambda h: h["violates"] | h["rule_id"].isNull())
    rows = scan.withColumn("kept", kept).withColumn("exempted", F.filter("hits", lambda h: ~h["violates"] & h["rule_id"].isNotNull()))
    light = light.groupBy("request_id").agg(F.bool_or("violation").alias("light_violation")) if light is not None else None
    rows = rows.join(light, "request_id", "left") if light is not None else rows.withColumn("light_violation", F.lit(None).cast("boolean"))
    if frames is not None:
        # a request has as many frames as were taken from it, a handful
        numbered = frames.select("request_id", F.struct(*(F.col(c) if c in frames.columns else F.lit(None).cast(k).alias(c) for c, k in (("frame", "int"), ("whitelisted", "boolean"), ("distance", "int")))).alias("f"))
        rows = rows.join(numbered.groupBy("request_id").agg(F.array_sort(F.collect_list("f")).alias("image_whitelist")), "request_id", "left")
    else:
        rows = rows.withColumn("image_whitelist", F.lit(None).cast("array<struct<frame:int,whitelisted:boolean,distance:int>>"))
    rows = rows.withColumn("image_whitelist", F.coalesce("image_whitelist", F.array().cast(dict(rows.dtypes)["image_whitelist"])))
    light_hit = F.coalesce("light_violation", F.lit(False))
    unknown = F.exists("image_whitelist", lambda f: ~F.coalesce(f["whitelisted"], F.lit(False)))
    literal = F.exists("kept", lambda h: h["kind"] == "literal")
    return rows.withColumns({"risk": (F.size("kept") > 0) | light_hit | unknown, "strong": literal | light_hit, "hit_category": F.get("kept", F.lit(0))["category"]})


def audit(
    requests: DataFrame,
    queries: DataFrame,
    pools: DataFrame,
    words: DataFrame,
    rules: DataFrame,
    verdicts: DataFrame,
    listed: DataFrame,
    d: Defaults = DEFAULTS,
    light: DataFrame | None = None,
    frames: DataFrame | None = None,
    overrides: DataFrame | None = None,
    known: dict[str, str] | None = None,
    others: bool = False,
) -> DataFrame:
    """(request_id, text_hash, tier, has_violation, confidence, category, source, degraded, detail, error): a decision a request.

    ``requests`` is (request_id, text, key_tier, and skip_llm if some take no verdict), ``light`` (request_id, violation),
    ``frames`` (request_id, whitelisted, hash, and frame and distance if known), ``overrides`` (request_id and thresholds).
    ``verdicts`` is (request_id, is_violation, category, confidence) or the judging model's (request_id, reply).

    The order of decision, each step for what is left: overrides of a key that isn't of the full tier are refused (an error,
    no decision); a text or a frame on a permanent list decides with confidence 0, black before white, blank texts
    aren't looked up; a request without any basic risk passes; the others, and only they, are looked up in the pools;
    where that has no answer (``degraded`` says why) a strong signal is a violation; tiers; between the thresholds a
    verdict. Texts are read and scanned once; what they gave is kept in the shared folder, so no later stage
    sees a text. ``detail`` is for keys of the full tier: hits and exempted hits, light model, frames, signals, verdict.

    A row that a stage can't take is set aside with the stage and what is wrong in ``error``: one that the scan breaks off on
    is safe with confidence 0; a vector that can't be compared counts as no answer of retrieval, a reply without a verdict as
    none. The other rows are decided all the same. Equal texts aren't cached here: a batch decides each row.
    """
    state = basic_state(checkpoint(scanned(requests, words, rules, d, known)), light, frames)
    hashes = state.where("text_hash IS NOT NULL").select("request_id", F.col("text_hash").alias("hash"))
    if frames is not None and "hash" in frames.columns:
        hashes = hashes.unionByName(frames.where("hash IS NOT NULL").select("request_id", "hash"))
    fixed = decisions.permanent_list(hashes, listed).select("request_id", F.col("verdict").alias("list"))
    state = state.join(fixed, "request_id", "left")
    refused = F.lit(False)
    if overrides is not None:
        state = state.join(overrides.select("request_id", F.lit(True).alias("overridden")).distinct(), "request_id", "left")
        refused = F.coalesce(F.col("overridden") & (F.col("key_tier") != "full"), F.lit(False))
    route = F.when(refused, "refused").when(F.col("list").isNotNull(), "listed").when(F.col("error").isNotNull(), "failed").when(~F.col("risk"), "passed").otherwise("open")
    state = checkpoint(state.withColumn("route", route).select("request_id", "key_tier", "skip_llm", "text_hash", "kept", "exempted", "error", "light_violation", "image_whitelist", "risk", "strong", "hit_category", "list", "route"))

    left = state.where("route = 'open'").select("request_id", "text_hash", "image_whitelist")
    sizes = {r["pool"]: (r["n"], r["dim"]) for r in semantic.pool_stats(pools).collect()}
    dims = [dim for _, dim in sizes.values() if dim]
    asked, wrong = errors.wrong_vectors(queries.join(left.select("request_id"), "request_id", "left_semi"), "query", dims[0] if dims else None)
    asked = checkpoint(asked)
    signals = semantic.semantic_confidence(semantic.semantic_signals(semantic.vector_topk(asked, pools, d.top_k, others), d), d)
    if overrides is not None:
        signals = decisions.with_overrides(signals, overrides, d)
    wrong = checkpoint(wrong.groupBy("request_id").agg(F.first("stage").alias("stage"), F.first("error").alias("wrong")))
    why = semantic.degraded_reasons(left.join(asked.select("request_id", "query"), "request_id", "left").join(wrong, "request_id", "left"), sizes)
    signals = checkpoint(signals.join(why.where("reason IS NOT NULL").select("request_id"), "request_id", "left_anti"))

    open_ids = left.select("request_id")
    if "reply" in verdicts.columns:
        replies = verdicts.join(open_ids, "request_id", "left_semi").withColumn("verdict", T.parse_verdict(F.col("reply")))
        good, unread = errors.wrong_replies(replies)
        verdicts = good.where("verdict IS NOT NULL").select("request_id", "verdict.is_violation", "verdict.category", "verdict.confidence")
        wrong = wrong.unionByName(unread.withColumnRenamed("error", "wrong")).groupBy("request_id").agg(F.max("stage").alias("stage"), F.max_by("wrong", "stage").alias("wrong"))
    decided = decisions.decide(signals, state.where("route IN ('passed', 'open')").select("request_id", "risk", "strong", "hit_category", "skip_llm"), verdicts, d)

    rows = state.join(decided, "request_id", "left").join(why, "request_id", "left").join(wrong, "request_id", "left")
    shown = signals.select("request_id", F.struct("black_top", "white_top", F.round(F.col("black_avg") - F.col("white_avg"), 6).alias("margin"), F.col("confidence").alias("confidence"), "triggered", F.col("category").alias("category")).alias("semantic"))
    rows = rows.join(shown, "request_id", "left").join(verdicts.select("request_id", F.struct("is_violation", F.col("category").alias("category"), F.col("confidence").alias("confidence")).alias("llm")), "request_id", "left")
    is_list, failed, refused = (F.col("route") == r for r in ("listed", "failed", "refused"))
    black = F.col("list") == "black"
    degraded = F.when(failed, F.concat(F.lit("error: "), "error")).when(F.col("reason").isNotNull(), F.concat(F.lit("semantic:"), "reason"))
    detail = F.struct(
        F.col("kept").alias("hits"),
        F.col("exempted").alias("regex_filtered"),
        F.col("light_violation").alias("light_model"),
        "image_whitelist",
        "semantic",
        F.when((F.col("source") == "llm"), F.col("llm")).alias("llm"),
    )
    error = F.when(refused, "overrides_not_permitted").when(failed, F.concat(F.lit("scan: "), "error")).when(~is_list & F.col("wrong").isNotNull(), F.concat("stage", F.lit(": "), "wrong"))
    return rows.select(
        "request_id",
        "text_hash",
        "tier",
        F.when(~refused, F.when(is_list, black).when(failed, False).otherwise(F.col("has_violation"))).alias("has_violation"),
        F.when(~refused, F.when(is_list | failed, 0.0).otherwise(F.col("confidence"))).alias("confidence"),
        F.when(~(is_list | failed | refused), F.col("category")).alias("category"),
        F.when(~refused, F.when(is_list, "permanent_list").when(failed, "semantic").otherwise(F.col("source"))).alias("source"),
        F.when(F.col("key_tier") == "full", degraded).alias("degraded"),
        F.when((F.col("key_tier") == "full") & F.col("route").isin("passed", "open"), detail).alias("detail"),
        error.alias("error"),
    )


def split_by_permission(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): overrides are for keys of the full tier."""
    bad = F.col("overrides").isNotNull() & (F.col("key_tier") != "full")
    return requests.where(~bad), requests.where(bad)
