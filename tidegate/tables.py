"""The moderation tables as they lie on the generic tables: requests, pools, logs, verdicts, whitelist, and small inline ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEXICON = [("contact", "token"), ("contact", "@mail"), ("abuse", "idiot"), ("abuse", "moron"), ("abuse", "the idiot"), ("abuse", "scum"), ("licence", "MIT License"), ("licence", "License"), ("pair", "idiot+moron"), ("pair", "clown+trash"), ("abuse", "clown"), ("spam", "idiot")]
RULES = [
    (1, "", "MIT License", "exempt", "short notice", True),
    (2, "abuse", "idiot[a-z ]{0,3}the", "exempt", None, True),
    (3, "contact", "[a-z0-9]+@mail", "violate", None, True),
    (4, "", "[0-9]{13,16}", "violate", "card number", True),
    (5, "abuse", "scum of", "exempt", None, True),
    (6, "", "version 3", "violate", None, False),
    (7, "licence", "Public License, version 3", "violate", None, True),
]
RULE_SCHEMA = "id long, category string, pattern string, action string, note string, is_active boolean"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("request_id"), "text", F.when(F.col("doc_id") % 2 == 0, "full").otherwise("standard").alias("key_tier"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, c, w, "inline") for i, (c, w) in enumerate(LEXICON)], "id long, category string, word string, source string")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, word): the distinct words of the documents of each language, as a lexicon of the tables' own; ß, whose capital is moot, as ss."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.coalesce("lang", F.lit("")).alias("category"), F.explode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("ss")), "[ \n]+")).alias("word")).where("word <> ''").distinct()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, line, category): turns of conversations as lines of a keyword file; in some the words are parted by plus signs."""
    c = load(spark, sf_dir, "conversations")
    start = F.substring_index(F.coalesce("text", F.lit("")), " ", 3)
    k = F.col("turn") % 4
    line = F.when(k == 0, F.replace(start, F.lit(" "), F.lit(" + "))).when(k == 1, F.concat(F.lit(" "), start, F.lit(" "))).when(k == 2, F.concat(F.replace(start, F.lit(" "), F.lit("+")), F.lit("++"))).otherwise(F.when(F.col("conv_id") % 3 == 0, F.lit(" + ")).otherwise(start))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), line.alias("line"), F.col("role").alias("category"))


def table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the tables' own: expressions of several shapes over the first three words of each benchmark item."""
    w = F.split(F.regexp_replace("text", r"[^A-Za-z ]+", " "), " +")
    k = F.col("item_id") % 5
    a, b, c = (F.get(w, F.lit(n)) for n in range(3))
    x = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    pattern = F.when(k == 0, x(a, "[ \n]+", b)).when(k == 1, x("(?:", a, "|", b, ") ", c)).when(k == 2, x(a, "[a-z ]{0,3}", b)).when(k == 3, x(a, " ", b, "(?: ", c, ")?")).otherwise(x(a, "(?:ly|ing)? ", b, ".{1,3}"))
    action = F.when(F.col("item_id") % 3 == 0, "exempt").otherwise("violate")
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "").otherwise("own").alias("category"), pattern.alias("pattern"), action.alias("action"), F.lit(None).cast("string").alias("note"), (F.col("item_id") % 7 != 0).alias("is_active"))


def light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, violation): what a light model says of labelled documents."""
    return load(spark, sf_dir, "labels").select(F.col("doc_id").alias("request_id"), (F.col("quality") == 0).alias("violation"))


def request_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, frame, whitelisted, distance, hash): each page is the one frame of the request of its number."""
    known = F.col("page_id") % 9 != 0
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("request_id"), F.lit(0).alias("frame"), known.alias("whitelisted"), F.when(known, (F.col("page_id") % 5).cast("int")).alias("distance"), F.md5("url").alias("hash"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, reply): what a judging model answers, in several forms, some of them no verdict."""
    i = F.col("doc_id")
    yes = F.when(F.col("toxic") == 1, "true").otherwise("false")
    said = F.concat(F.lit('{"is_violation": '), yes, F.lit(', "category": '), F.when(F.col("toxic") == 1, F.lit('"abuse"')).otherwise(F.lit("null")), F.lit(', "confidence": '), F.when(F.col("quality") == 1, "0.9").otherwise("1.5"), F.lit("}"))
    reply = F.when(i % 13 == 0, F.lit("no idea")).when(i % 11 == 0, F.concat(F.lit("Sure: "), said, F.lit(" done"))).when(i % 17 == 0, F.lit('{"is_violation": "yes"}')).when(i % 19 == 0, F.lit("[1]")).when(i % 23 == 0, F.lit(None)).otherwise(said)
    return load(spark, sf_dir, "labels").select(i.alias("request_id"), reply.alias("reply"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, pool, category, embedding): members of the violating and the safe pool."""
    v = load(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.when(F.col("label") < 5, "black").otherwise("white").alias("pool"), F.col("label").cast("string").alias("category"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks for its nearest among the others."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("query"))


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("request_id"),
        "ts",
        F.sha2(F.col("user_id").cast("string"), 256).alias("text_hash"),
        (F.col("event_type") == "error").alias("has_violation"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))).alias("category"),
        F.col("event_type").alias("source"),
        F.col("props").alias("detail_json"),
        F.when(F.col("user_id") % 2 == 0, "full").otherwise("standard").alias("key_tier"),
        "user_id",
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, is_violation, category, confidence): a model's verdicts; requests without a row have none."""
    labels = load(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("request_id"), (F.col("toxic") == 1).alias("is_violation"), F.when(F.col("toxic") == 1, "abuse").alias("category"), (0.5 + 0.4 * F.col("quality")).alias("confidence"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, md5, phash): pages stand for image frames, hashed from their urls, with 0, 2, 5 or 7 bits turned."""
    digits, h, k = "0123456789abcdef", F.sha2("url", 256), F.col("page_id") % 4
    first, last = F.substring(h, 1, 1), F.substring(h, 64, 1)
    head = F.when(k >= 2, F.translate(first, digits, "76543210fedcba98")).otherwise(first)
    tail = F.when(k == 0, last).when(k == 3, F.translate(last, digits, "fedcba9876543210")).otherwise(F.translate(last, digits, "32107654ba98fedc"))
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("frame_id"), F.md5(F.concat("url", k.cast("string"))).alias("md5"), F.concat(head, F.substring(h, 2, 62), tail).alias("phash"))


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages").where("page_id % 3 <> 1")
    return p.select(F.col("page_id").alias("white_id"), F.md5(F.concat("url", F.lit("0"))).alias("white_md5"), F.sha2("url", 256).alias("white_phash"))
