"""Scalar text functions: normalisation, folding, keywords, patterns, prompts and verdicts."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ASCII = "".join(map(chr, range(0x21, 0x7F)))
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
SPACES = r"(?U)[\s\x1c-\x1f]+"
PUNCTUATION = r"(?U)[\s\p{Z}\x1c-\x1f\-_.,;:!?'\"()\[\]{}<>/\\|@#$%^&*=~`·・。，、；：！？“”‘’（）【】《》…—]"
#: What a word for the lexicon is compared without, beside white space.
DEDUP_PUNCTUATION = r"(?U)[\s\x1c-\x1f，。！？：；、（）()【】\[\]《》〈〉“”\"'.,!?:;]"
#: Simplified forms and their traditional ones, in pairs.
SIMPLIFIED = "赌卖网线钱约药门开关发龙飞车号电话视频买币台湾独传统联恋爱会员银戏补课楼盘贷诈骗汇妈证书节图码录"
TRADITIONAL = "賭賣網線錢約藥門開關發龍飛車號電話視頻買幣臺灣獨傳統聯戀愛會員銀戲補課樓盤貸詐騙匯媽證書節圖碼錄"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t else t)


def normalize_text(text: Column) -> Column:
    """NFKC, trimmed, runs of white space as one space; null gives an empty text.

    Texts of ASCII alone are NFKC already and never leave the JVM: the function sees null for them.
    """
    plain = text.rlike(r"\A\p{ASCII}*\z")
    folded = F.coalesce(F.when(plain, text), nfkc(F.when(~plain, text)), F.lit(""))
    return F.trim(F.regexp_replace(folded, SPACES, " "))


def text_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def audit_key(normalized: Column, frames: Column, context: Column, key_tier: Column, knowledge: Column, settings: Column, skip_llm: Column | None = None, overrides: Column | None = None) -> Column:
    """Key under which a request's answer may be used again.

    Of the text, the frames' hashes in any order, the context, and all that an answer depends on besides: the tier of the key (answers of the
    full tier hold details), the version of words and rules, the thresholds (``settings``, a map or struct), whether the
    judging model is left out, and thresholds of the request's own. Maps count in any order of their keys.
    """
    none = F.lit(None).cast("string")
    ordered = lambda c: none if c is None else F.to_json(c)
    params = F.struct(ordered(settings).alias("decision"), knowledge.alias("knowledge"), ordered(overrides).alias("overrides"), F.coalesce(skip_llm if skip_llm is not None else F.lit(False), F.lit(False)).alias("skip_llm"), key_tier.alias("tier"))
    return F.sha2(F.to_json(F.struct(F.coalesce(context, F.lit("")).alias("context"), F.array_sort(frames).alias("frames"), params.alias("params"), F.coalesce(normalized, F.lit("")).alias("text"))), 256)


def to_broad(text: str) -> str:
    return text.translate(str.maketrans(ASCII, WIDE))


def to_wide(text: Column) -> Column:
    return F.translate(text, ASCII, WIDE)


def to_narrow(text: Column) -> Column:
    return F.translate(text, "　" + WIDE, " " + ASCII)


def simplify(text: Column) -> Column:
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def normalize_keyword(word: Column) -> Column:
    """Narrow, simplified, without white space and punctuation (plus signs stay), in lower case."""
    return F.lower(F.regexp_replace(simplify(to_narrow(word)), PUNCTUATION, ""))


def dedup_form(word: Column) -> Column:
    return F.regexp_replace(to_narrow(word), DEDUP_PUNCTUATION, "")


def keyword_terms(line: Column) -> Column:
    """The terms of a line, parted by plus signs; empty for a blank line or plus signs alone."""
    return F.filter(F.transform(F.split(line, r"\+"), lambda x: F.trim(x)), lambda x: x != "")


def match_type(line: Column) -> Column:
    return F.when(F.size(keyword_terms(line)) > 1, "and").when(F.size(keyword_terms(line)) == 1, "word")


_EARLIER = r"(?:all|any|every|the|your|these|those|of|my|our|\s)*(?:previous|prior|preceding|earlier|above|former|foregoing|original|initial)"
_ORDERS = r"(?:instruction|direction|order|command|prompt|rule|guideline|message|context|policy|policies)s?"
_VOID = r"(?:ignore|disregard|forget|override|bypass|skip|drop|discard|cancel|neglect)"
_SAY = r"(?:reveal|show|print|repeat|output|leak|tell|give|display|disclose)"
#: What a text may say to command the model that judges it, kind by kind.
INJECTIONS = {
    "override": rf"(?i)\b{_VOID}\b\s+{_EARLIER}\s+{_ORDERS}\b|\b{_VOID}\s+(?:everything|anything)\s+(?:above|before|said)\b|\b(?:do\s+not|don't|never|stop)\s+(?:follow|obey|apply)(?:ing)?\s+(?:the|your|any|these)?\s*(?:{_EARLIER}\s+)?{_ORDERS}\b",
    "new orders": rf"(?i)\b(?:new|updated|real|actual)\s+{_ORDERS}\s*[:：]|\bfollow\s+(?:only\s+)?(?:these|the\s+following|my)\s+(?:new\s+)?{_ORDERS}\b|\bfrom\s+(?:now|here|this\s+point)\s+on(?:wards?)?,?\s+(?:you|your)\b",
    "role": r"(?i)\byou\s+(?:are|will\s+be)\s+now\s+(?:an?\s+|the\s+)?|\b(?:pretend|imagine)\s+(?:to\s+be|that\s+you\s+are|you\s+are|you're)\b|\b(?:act|behave|respond|answer)\s+(?:as|like)\s+(?:if|though|an?|the|my)\b|\b(?:enter|enable|activate|switch\s+to)\s+(?:developer|debug|admin|god|unrestricted|dan)\s+mode\b",
    "disclosure": rf"(?i)\b{_SAY}\s+(?:me\s+|us\s+)?(?:the\s+|your\s+)?(?:hidden|system|secret|initial|internal|full)\s+{_ORDERS}\b|\b(?:system|developer)\s+(?:prompt|message)\b",
    "escape": r"(?i)\bjail\s?-?break(?:ing|s|ed)?\b|\b(?:without|no)\s+(?:any\s+)?(?:safety|content|ethical)\s+(?:filters?|limits?|restrictions?|rules)\b",
    "verdict": r"(?i)\b(?:mark|label|rate|classify|treat|judge)\s+(?:this|it|the\s+text)\s+(?:as\s+)?(?:safe|harmless|allowed|compliant)\b|\\?[\"']is_violation\\?[\"']\s*:\s*(?:true|false)",
    "delimiter": r"(?i)</?\s*(?:text|context|system|assistant|user)\s*>|<\|[^|<>]{1,20}\|>",
    "override, Chinese": r"(?:忽略|无视|忘记|忘掉|抛开|跳过|推翻|不用管|不要管|别管)(?:掉|你)?(?:以上|上面|之前|前面|先前|此前|上述|所有|全部|一切|任何|原来|原先)(?:的)*(?:所有|全部|一切)?(?:的)?(?:内容|指令|指示|命令|规则|要求|提示词?|设定|消息|对话)?|(?:不要|别|无需|不必|停止)(?:再)?(?:遵守|遵循|服从|执行|理会|按照)(?:以上|上面|之前|前面|上述|任何|你的)?(?:的)?(?:内容|指令|指示|命令|规则|要求|提示|设定)?",
    "new orders, Chinese": r"(?:请|你(?:必须|要|应该)?|现在)?(?:只)?(?:遵循|遵守|执行|服从|按照)(?:以下|下面|下列|我的|新的)(?:的)?(?:新)?(?:指令|指示|命令|规则|要求|提示)|(?:新的?)(?:指令|命令|规则)\s*[:：]",
    "role, Chinese": r"(?:从现在(?:起|开始)|现在)[，,]?\s*你(?:就)?(?:是|要扮演|将扮演|变成)|(?:请)?(?:你)?(?:假装|扮演|假设)(?:你|成)?(?:是|为|一个|一名)|(?:进入|开启|打开|切换到)(?:开发者|管理员|调试|越狱|无限制)模式",
    "disclosure, Chinese": r"(?:输出|显示|告诉我|说出|打印|重复|泄露|透露)(?:你的|一下|出)?(?:系统|隐藏|内部|初始|完整)(?:的)?(?:提示词?|指令|设定|规则)|系统提示词",
    "verdict, Chinese": r"(?:请)?(?:把|将)?(?:本|此|这)(?:条|段|篇)?(?:文本|内容|消息|话)?(?:直接)?(?:判定?|标记|视|归类)(?:为|成)(?:安全|合规|正常|无害|不违规)",
}


_ORDER_WORDS = "instruction direction order command prompt rule guideline message context polic"
#: What a text must hold, in any case, for a kind of ``INJECTIONS`` to match: of one choice a string of each list. No string holds
#: white space, so that none arises where another kind's wording has become a space. Kinds that aren't named need a Han character.
NEEDED = {
    "override": [["ignore disregard forget override bypass skip drop discard cancel neglect follow obey apply"]],
    "new orders": [[_ORDER_WORDS], ["from", "you", "now here point"]],
    "role": [["you", "now"], ["pretend imagine mode"], ["act behave respond answer", "as like"]],
    "disclosure": [["hidden system secret initial internal full developer", _ORDER_WORDS]],
    "escape": [["jail filter limit restriction rules"]],
    "verdict": [["safe harmless allowed compliant is_violation"]],
    "delimiter": [["<"]],
}


def may_match(kind: str, text: Column) -> Column:
    """Whether a text holds what a wording of that kind needs; null for null."""
    if kind not in NEEDED:
        return text.rlike(r"[\u4e00-\u9fff]")
    low = F.lower(text)
    some = lambda words: reduce(lambda x, y: x | y, (F.contains(low, F.lit(w)) for w in words.split()))
    return reduce(lambda x, y: x | y, (reduce(lambda x, y: x & y, map(some, lists)) for lists in NEEDED[kind]))


def sanitize(text: Column) -> Column:
    """Every wording of ``INJECTIONS`` replaced by a space, runs of white space as one, trimmed; null stays null.

    An expression runs only over texts that hold what it needs; over others one that ends at once stands for it.
    """
    out = text
    for kind, pattern in INJECTIONS.items():
        out = F.regexp_replace(out, F.when(may_match(kind, text), pattern).otherwise(r"\A(?!)"), F.lit(" "))
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def animated(frames: Column, inputs: Column) -> Column:
    """Whether frames were taken out of moving images: there are more of them than images were given."""
    return frames > inputs


def user_block(text: Column, context: Column, animated: Column) -> Column:
    """What the judging model is given: sanitised text and context between delimiters, and a word before them if frames are of one animation."""
    clean = lambda x: F.regexp_replace(F.coalesce(sanitize(x), F.lit("")), r"\A\z", "(none)")
    part = lambda name, x: F.concat(F.lit(f"<{name}>\n"), clean(x), F.lit(f"\n</{name}>"))
    return F.concat(F.when(animated, "Several frames of one animation.\n").otherwise(""), part("text", text), F.lit("\n"), part("context", context))


def parse_verdict(reply: Column) -> Column:
    """struct(is_violation, category, confidence, reason) of a model's reply; null where it holds no verdict.

    The whole reply is read as JSON, else what lies between its first and last brace. is_violation must be a
    boolean; confidence is kept within 0 and 1; a category or reason that isn't text is null.
    """
    whole = F.try_parse_json(reply)
    inner = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    v = F.when(is_object(whole), whole).when(is_object(inner), inner)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string"))
    number = F.try_variant_get(v, "$.confidence", "double")
    return F.when(
        kind("$.is_violation") == "BOOLEAN",
        F.struct(
            F.try_variant_get(v, "$.is_violation", "boolean").alias("is_violation"),
            text("$.category").alias("category"),
            F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).alias("confidence"),
            text("$.reason").alias("reason"),
        ),
    )


def recover_text(detail: Column, keys: tuple[str, ...] = ("text", "content", "normalized", "原文")) -> Column:
    """The first of the keys that holds a text which isn't blank."""
    v = F.try_parse_json(detail)
    held = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$['{k}']", "variant")) == "STRING", F.try_variant_get(v, f"$['{k}']", "string")) for k in keys]
    return F.coalesce(*(F.when(F.trim(x) != "", x) for x in held))


def mask_key(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 8), F.lit("…"))
