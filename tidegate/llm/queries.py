"""The queries of the training-data operators, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import centroid_clusters, decontaminate, html_extract, license_scan, line_dedup, packing, quality, simhash_dedup, source_audit, substring_dedup, token_store, topk_search, url_filter
from tidegate.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.search(vectors, vectors.where("vec_id % 20 = 0"))


#: (verdict, host, path), fixed by the query's contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels of the documents whose numbers stand in the urls; bad is low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"^/[a-z]+/([0-9]{1,18})", 1)
    cited = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")
    outcomes = cited.join(labels.select("doc_id", "quality", "toxic"), "doc_id").select("url", bad)
    out = url_filter.judge(pages, outcomes, RULES)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bound", 6).alias("bound"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item: how often the item is aligned in the document, and the best alignment."""
    rows = decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max_by(F.struct("start_word", "end_word"), F.struct("similarity", -F.col("start_word")))
    out = rows.groupBy("id", "item_id").agg(F.count("*").alias("n_passages"), F.max("similarity").alias("similarity"), best.alias("at"))
    return out.select(F.col("id").alias("doc_id"), "item_id", "n_passages", "similarity", "at.start_word", "at.end_word")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No bin holds two documents of one source, or of one component of near duplicates."""
    docs = table(spark, sf_dir, "documents")
    clusters = simhash_dedup.near_duplicates(docs).select("id", "component")
    out = packing.pack(packing.document_sizes(docs, clusters=clusters))
    return out.select(F.col("id").alias("doc_id"), "piece", F.col("start").alias("start_word"), F.col("length").alias("n_words"), "bin")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_extract.extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are drawn."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("rep").alias("rep_doc_id"), F.col("rep_start").alias("rep_start_word"), F.col("rep_end").alias("rep_end_word"), "similarity"
    )


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the shard files of a new folder hold them."""
    import public_tokenizers

    folder = token_store.new_folder(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_documents(spark, folder)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_topk_search": op3_topk_search,
    "op4_url_filter": op4_url_filter,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_packing": op7_packing,
    "op8_html_extract": op8_html_extract,
    "op9_quality_resample": op9_quality_resample,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_store": op11_token_store,
    "op12_source_audit": op12_source_audit,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op4_url_filter": r"""
        WITH p AS (
            SELECT page_id, url,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        q AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
                     list_extract(string_split(host, '.'), -1) AS suffix FROM p),
        o AS (SELECT q.host, q.domain, q.suffix, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS bad
              FROM q JOIN labels l ON l.doc_id = try_cast(regexp_extract(q.path, '^/[a-z]+/([0-9]{1,18})', 1) AS BIGINT)),
        s AS (SELECT suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM o GROUP BY suffix),
        d AS (SELECT domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM o GROUP BY domain, suffix),
        h AS (SELECT host, domain, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM o GROUP BY host, domain),
        t AS (SELECT coalesce((sum(bad) + 0.5) / (sum(n) + 1.0), 0.5) AS rate FROM s),
        r0 AS (SELECT (sum(n * power(bad / n - rate, 2) / (rate * (1 - rate))) - (count(*) - 1))
                      / nullif(greatest(sum(n) - sum(n * n) / sum(n) - (count(*) - 1), 0), 0) AS r FROM s, t),
        m0 AS (SELECT CASE WHEN r > 0 THEN least(1000.0, greatest(5.0, (1 - r) / r)) ELSE 1000.0 END AS m FROM r0),
        s2 AS (SELECT suffix, (bad + m * rate) / (n + m) AS suffix_rate FROM s, m0, t),
        r1 AS (SELECT (sum(n * power(bad / n - suffix_rate, 2) / (suffix_rate * (1 - suffix_rate))) - (count(*) - 1))
                      / nullif(greatest(sum(n) - sum(n * n) / sum(n) - (count(*) - 1), 0), 0) AS r FROM d JOIN s2 USING (suffix)),
        m1 AS (SELECT CASE WHEN r > 0 THEN least(1000.0, greatest(5.0, (1 - r) / r)) ELSE 1000.0 END AS m FROM r1),
        d2 AS (SELECT domain, (bad + m * suffix_rate) / (n + m) AS domain_rate FROM d JOIN s2 USING (suffix), m1),
        r2 AS (SELECT (sum(n * power(bad / n - domain_rate, 2) / (domain_rate * (1 - domain_rate))) - (count(*) - 1))
                      / nullif(greatest(sum(n) - sum(n * n) / sum(n) - (count(*) - 1), 0), 0) AS r FROM h JOIN d2 USING (domain)),
        m2 AS (SELECT CASE WHEN r > 0 THEN least(1000.0, greatest(5.0, (1 - r) / r)) ELSE 1000.0 END AS m FROM r2),
        h2 AS (SELECT host, (bad + m * domain_rate) / (n + m) AS host_rate, n + m AS size FROM h JOIN d2 USING (domain), m2),
        j AS (SELECT q.*, coalesce(host_rate, domain_rate, suffix_rate, t.rate) AS bad_rate, coalesce(h2.size, m2.m) AS size
              FROM q LEFT JOIN h2 USING (host) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix), t, m2),
        f AS (SELECT *, bad_rate - 1.645 * sqrt(bad_rate * (1 - bad_rate) / (size + 1)) AS bound,
                     CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                          WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                          WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                          WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                          WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
              FROM j)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
               round(bad_rate, 6) AS bad_rate, round(bound, 6) AS bound
        FROM f""",
    "op5_line_dedup": r"""
        WITH lines AS (
            SELECT d.doc_id, u.k, u.line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
                 LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS k) u),
        keyed AS (
            SELECT doc_id, k, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        many AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT keyed.*, many.key IS NOT NULL AND keyed.doc_id <> many.last AS gone
            FROM keyed LEFT JOIN many ON keyed.key = many.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op12_source_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
        w AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
        s AS (SELECT lang, source, term, n, v, sum(n) OVER (PARTITION BY lang, source) AS total,
                     sum(n) OVER (PARTITION BY lang, term) AS m, sum(n) OVER (PARTITION BY lang) AS whole FROM w JOIN v USING (lang)),
        p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (total + 5 * v) AS p,
                     1 + (1000000000 * (m + 5)::HUGEINT) // (whole + 5 * v) AS q FROM s),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                        coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
                                  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
        term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
              FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_centroid_clusters": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c AS (
            SELECT 0 AS round, (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS cluster, x AS c
            FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < 16
            UNION ALL
            (WITH near AS (SELECT v.x, arg_min(cluster, (list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), cluster)) AS cluster
                           FROM v, c WHERE c.round < 3 GROUP BY vec_id, x),
             part AS (SELECT cluster, j, sum(x[j]) AS s, count(*) AS n FROM near, range(1, 65) t(j) GROUP BY cluster, j),
             mean AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM part GROUP BY cluster)
             SELECT c.round + 1, c.cluster, coalesce(mean.c, c.c) FROM c LEFT JOIN mean USING (cluster) WHERE c.round < 3)),
        f AS (
            SELECT vec_id, min((list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), cluster)) AS best
            FROM v, c WHERE c.round = 3 GROUP BY vec_id, x),
        g AS (SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance FROM f)
        SELECT vec_id, g.cluster, distance, sum(distance) OVER (PARTITION BY g.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(list_transform(c.c, lambda x: x::VARCHAR), ',')) AS centroid_sha256
        FROM g JOIN c ON c.round = 3 AND c.cluster = g.cluster""",
}
