"""Retrieval from a violating and a safe pool of vectors, and the confidence that comes of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.config import DEFAULTS, Defaults
from tidegate.functions import vectors as V

BLOCK = 2048
TILE = 2048  # rows of a pool that a block of queries meets at once


def add_vectors(pool: DataFrame, new: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows of ``new`` to append: the first of each (pool, id) that the pool lacks, normalised. Vectors of another length than ``dim`` raise an error."""
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit(f"a vector has not {dim} components: "), F.col("id").cast("string"))).cast(dict(new.dtypes)["embedding"])
        new = new.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong))
    first = Window.partitionBy("pool", "id").orderBy("seq")
    fresh = new.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return fresh.join(pool.select("pool", "id"), ["pool", "id"], "left_anti").withColumn("embedding", V.l2_normalize(F.col("embedding")))


SMALL = 64_000_000  # bytes of a pool that are broadcast
MOST_PARTS = 1000  # into which larger pools are dealt


def _unit_rows(ids, vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows normalised, which were kept): vectors of no length, or none that is finite, are left out."""
    m = np.stack([np.asarray(x, dtype=np.float64) for x in vectors]) if len(vectors) else np.empty((0, 0))
    length = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(length) & (length >= V.EPS)
    return np.asarray(ids, dtype="<i8")[good], m[good] / length[good, None], good


def _nearest(q_ids: np.ndarray, q: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, place in the pool, score, rank) of each query's k nearest, equal scores in order of falling id.

    The pool is met ``TILE`` rows at a time, so that memory doesn't grow with it. Of a tile only what reaches a query's k-th score
    so far is rounded and put in order.
    """
    least = np.full(len(q_ids), -np.inf)
    row, col, place, score = *(np.empty(0, np.int64) for _ in range(3)), np.empty(0)
    for at in range(0, len(p_ids), TILE):
        s = q @ p[at : at + TILE].T
        if others:
            s[q_ids[:, None] == p_ids[None, at : at + TILE]] = -np.inf
        if s.shape[1] > k:
            # at least k scores of the tile reach the least of the k best of as many slices of it
            edges = np.arange(k) * s.shape[1] // k
            least = np.maximum(least, np.maximum.reduceat(s, edges, axis=1).min(axis=1))
        new_row, new_col = np.nonzero((s >= (least - 2e-9)[:, None]) & (s > -np.inf))  # what rounds to as much is no further off
        row, col, score = np.append(row, new_row), np.append(col, at + new_col), np.append(score, s[new_row, new_col])
        near = score.round(9)
        order = np.lexsort((-p_ids[col], -near, row))
        row, col, score, near = row[order], col[order], score[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, score, near, place = (x[place < k] for x in (row, col, score, near, place))
        last = place == k - 1
        least[row[last]] = np.maximum(least[row[last]], near[last])
    return row, col, score, place + 1


def vector_topk(queries: DataFrame, pools: DataFrame, k: int = DEFAULTS.top_k, others: bool = False, small: int = SMALL) -> DataFrame:
    """(request_id, pool, rank, vec_id, category, score): each query's k nearest by cosine in each pool.

    Equal scores go to the larger vec_id. Queries and vectors of no length have no neighbours. With ``others``, a vector whose
    vec_id is the request_id is no neighbour of it. Pools of at most ``small`` bytes, which are counted first, are broadcast
    and each block of queries meets them where it lies; only queries are shuffled, so that all cores have some. Larger pools are
    packed in blocks of ``BLOCK`` rows as the queries are and dealt in parts of about ``small`` bytes; every block of the one meets
    every block of the other once, and each part hands on k rows a query. The work is the number of pairs, queries times vectors.
    """
    rows = pools.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), "pool", F.col("embedding").alias("v"), F.col("category").alias("kind"))
    asked = queries.where("query IS NOT NULL").select(F.col("request_id").cast("long").alias("id"), F.col("query").alias("v"))
    held = rows.agg(F.sum(F.size("v") * 8 + F.coalesce(F.length("kind"), F.lit(0)) + F.lit(64))).first()[0] or 0
    asked = asked.repartition(3 * asked.sparkSession.sparkContext.defaultParallelism)
    return _topk_of_small(asked, rows, k, others) if held <= small else _topk_of_blocks(asked, rows, k, others, 1 + held // max(1_000_000, small))


RESULT = "request_id long, pool string, rank int, vec_id long, category string, score double"


def _topk_of_small(asked: DataFrame, rows: DataFrame, k: int, others: bool) -> DataFrame:
    pdf = rows.toArrow().to_pandas()
    parts = []
    for pool, part in pdf.groupby("pool", sort=True):
        ids, m, good = _unit_rows(part["id"], part["v"].tolist())
        if len(ids):
            parts.append((pool, ids, m, part["kind"].to_numpy(dtype=object)[good]))
    shared = asked.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                some = pdf.iloc[at : at + BLOCK]
                q_ids, q, _ = _unit_rows(some["id"], some["v"].tolist())
                for pool, ids, m, kinds in shared.value if len(q_ids) else ():
                    row, col, score, rank = _nearest(q_ids, q, ids, m, k, others)
                    yield pd.DataFrame({"request_id": q_ids[row], "pool": pool, "rank": rank, "vec_id": ids[col], "category": kinds[col], "score": score})

    return asked.mapInPandas(run, RESULT)


def _topk_of_blocks(asked: DataFrame, rows: DataFrame, k: int, others: bool, parts: int) -> DataFrame:
    def packed(rows: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for group, part in pdf.groupby("pool", sort=False):
                    for at in range(0, len(part), BLOCK):
                        some = part.iloc[at : at + BLOCK]
                        ids, m, good = _unit_rows(some["id"], some["v"].tolist())
                        yield pd.DataFrame({"pool": [group], "n": [len(ids)], f"{name}_ids": [ids.tobytes()], f"{name}_vecs": [m.astype("<f8").tobytes()], f"{name}_kinds": [some["kind"][good].tolist()]})

        return rows.mapInPandas(run, f"pool string, n int, {name}_ids binary, {name}_vecs binary, {name}_kinds array<string>").where("n > 0")

    q = packed(asked.select("id", "v", F.lit("").alias("pool"), F.lit(None).cast("string").alias("kind")), "q").select("q_ids", "q_vecs")
    p = packed(rows, "p").select("pool", "p_ids", "p_vecs", "p_kinds").repartition(min(parts, MOST_PARTS))

    def best_of(q_ids: np.ndarray, pool: str, found: list) -> pd.DataFrame:
        row, ids, kinds, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-ids, -score.round(9), row))
        row, ids, kinds, score = (x[order] for x in (row, ids, kinds, score))
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"request_id": q_ids[row[first]], "pool": pool, "vec_id": ids[first], "category": kinds[first], "score": score[first]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block of queries meets the blocks of a part one after the other; its k best of each pool go on when the next one comes."""
        last, q_ids, q, held = None, np.empty(0, "<i8"), np.empty((0, 0)), {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.q_ids != last:
                    yield from (best_of(q_ids, pool, found) for pool, found in held.items())
                    last, q_ids, held = r.q_ids, np.frombuffer(r.q_ids, "<i8"), {}
                    q = np.frombuffer(r.q_vecs, "<f8").reshape(len(q_ids), -1)
                p_ids = np.frombuffer(r.p_ids, "<i8")
                row, col, score, _ = _nearest(q_ids, q, p_ids, np.frombuffer(r.p_vecs, "<f8").reshape(len(p_ids), -1), k, others)
                held.setdefault(r.pool, []).append((row, p_ids[col], np.array(r.p_kinds, dtype=object)[col], score))
        yield from (best_of(q_ids, pool, found) for pool, found in held.items())

    met = q.join(p.hint("shuffle_replicate_nl")).mapInPandas(compare, "request_id long, pool string, vec_id long, category string, score double")
    best = Window.partitionBy("request_id", "pool").orderBy(F.desc(F.round("score", 9)), F.desc("vec_id"))
    top = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("request_id", "pool", "rank", "vec_id", "category", "score")


def own_ranks(top: DataFrame, wanted: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """Neighbours within each request's own numbers, of (request_id, top_k, black_top_k, white_top_k): a pool's own, else top_k, else the default.

    ``top`` has to hold as many neighbours as any request may want.
    """
    rows = top.join(wanted.select("request_id", "top_k", "black_top_k", "white_top_k"), "request_id", "left")
    own = F.when(F.col("pool") == "black", F.col("black_top_k")).otherwise(F.col("white_top_k"))
    general = F.coalesce(F.when(F.col("top_k") >= 1, F.col("top_k").cast("int")), F.lit(d.top_k))
    most = F.when(own >= 1, own.cast("int")).otherwise(general)
    return rows.where(F.col("rank") <= most).select(*top.columns)


def pool_stats(pools: DataFrame) -> DataFrame:
    return pools.groupBy("pool").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))


def clip01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def semantic_signals(top: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """(request_id, black_top, white_top, black_avg, white_avg, margin, category): both pools' signals of each query.

    The category is that of the nearest violating vector, triggered or not; a pool without neighbours gives nulls.
    """
    black, white = F.col("pool") == "black", F.col("pool") == "white"
    s = top.groupBy("request_id").agg(
        F.max(F.when(black, F.col("score"))).alias("black_top"),
        F.max(F.when(white, F.col("score"))).alias("white_top"),
        F.avg(F.when(black, F.col("score"))).alias("black_avg"),
        F.avg(F.when(white, F.col("score"))).alias("white_avg"),
        F.max(F.when(black & (F.col("rank") == 1), F.col("category"))).alias("category"),
    )
    return s.withColumn("margin", F.greatest(F.lit(0.0), F.col("black_avg") - F.col("white_avg") - d.margin_w))


def semantic_confidence(signals: DataFrame, d: Defaults = DEFAULTS, margin_norm: float | None = None) -> DataFrame:
    """Signals with ``confidence`` of three signals and ``triggered``."""
    n = margin_norm if margin_norm and margin_norm > 0 else d.margin_norm
    near = (F.col("black_top") >= d.semantic_threshold) & (F.col("black_top") - F.col("white_top") >= d.black_white_gap)
    return signals.withColumn("confidence", clip01(d.w_top * F.col("black_top") + d.w_margin * F.col("margin") / n)).withColumn("triggered", near | (F.col("margin") > 0))


def rerank_confidence(signals: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """Signals with a ``rerank_max`` column (null where reranking failed), as a confidence of four signals."""
    c = d.rerank_w_top * F.col("black_top") + d.rerank_w_margin * F.col("margin") / d.margin_norm + d.rerank_w_rerank * F.coalesce("rerank_max", F.lit(0.0))
    return signals.withColumn("confidence", clip01(c))


def rerank_local(top: DataFrame, queries: DataFrame, encoded: DataFrame) -> DataFrame:
    """Candidates by cosine of the query with ``encoded`` (vec_id, again); those not encoded keep their score."""
    rows = top.join(encoded, "vec_id", "left").join(queries, "request_id")
    score = F.coalesce(V.cosine(F.col("query"), F.col("again")), F.col("score"))
    best = Window.partitionBy("request_id", "pool").orderBy(F.desc(F.round("rerank_score", 9)), F.desc("vec_id"))
    return rows.withColumn("rerank_score", score).withColumn("rerank", F.row_number().over(best)).select("request_id", "pool", "rank", "vec_id", "score", "rerank_score", "rerank")


def rerank_responses(top: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates with what a rerank service answered: (request_id, pool, index, relevance), where index counts from 0 by rank.

    A candidate that the answer lacks has no score; relevance is kept within 0 and 1. Indexes beyond the candidates are passed over.
    """
    answers = responses.groupBy("request_id", "pool", (F.col("index") + 1).alias("rank")).agg(F.max(clip01(F.col("relevance"))).alias("rerank_score"))
    return top.join(answers, ["request_id", "pool", "rank"], "left")


def rerank_max(reranked: DataFrame, k: int = DEFAULTS.rerank_top_k) -> DataFrame:
    """(request_id, rerank_max): the best rerank score among the first k violating candidates by rank; null where none has one."""
    return reranked.where((F.col("pool") == "black") & (F.col("rank") <= k)).groupBy("request_id").agg(F.max("rerank_score").alias("rerank_max"))


def degraded_reasons(rows: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """(request_id, reason): why retrieval has no answer for rows of (request_id, text_hash, image_whitelist, query, wrong), or null.

    empty_input: neither text nor frame; semantic_exception: a vector that can't be compared; embedding_error: no vector;
    empty_black_pool and empty_white_pool: nothing to compare with. A vector of no length finds nothing, as in an empty pool.
    """
    empty = lambda pool: F.lit(not sizes.get(pool, (0, 0))[0])
    reason = (
        F.when(F.col("text_hash").isNull() & (F.size("image_whitelist") <= 0), "empty_input")
        .when(F.col("wrong").isNotNull(), "semantic_exception")
        .when(F.col("query").isNull(), "embedding_error")
        .when(empty("black") | ~(V.norm(F.col("query")) >= V.EPS), "empty_black_pool")
        .when(empty("white"), "empty_white_pool")
    )
    return rows.select("request_id", reason.alias("reason"))


def degraded(requests: DataFrame, pools: DataFrame) -> DataFrame:
    """(request_id, reason): why retrieval has no answer: empty_input, embedding_error, empty_black_pool, empty_white_pool, or null."""
    n = pools.agg(F.count_if(F.col("pool") == "black").alias("black"), F.count_if(F.col("pool") == "white").alias("white")).first()
    bad = F.col("query").isNull()
    zero = ~(V.norm(F.col("query")) >= V.EPS)
    reason = (
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_input")
        .when(bad, "embedding_error")
        .when(F.lit(n["black"] == 0) | zero, "empty_black_pool")
        .when(F.lit(n["white"] == 0), "empty_white_pool")
    )
    return requests.select("request_id", reason.alias("reason"))


def characters(text: Column) -> Column:
    return F.split(text, "")


def light_model(texts: DataFrame, weights: DataFrame, linear: list[list[float]], bias: list[float], n_buckets: int, violation: int = 1, cut: Callable[[Column], Column] = characters) -> DataFrame:
    """(request_id, label, score, violation): mean of the buckets' vectors, a linear layer and softmax.

    ``weights`` is (bucket, embedding); ``cut`` parts a text into tokens, characters unless a segmenter of words is given (a
    column function, such as a pandas UDF around one). An empty text has the bias alone.
    """
    from tidegate.functions.hashing import buckets, ngrams

    dim = len(linear[0])
    tokens = texts.select("request_id", F.explode(F.filter(cut(F.col("text")), lambda c: c != "")).alias("token")).groupBy("request_id", "token").agg(F.count("*").alias("times"))
    # each distinct token is hashed and looked up once
    rows = tokens.select("token").distinct().select("token", F.explode(buckets(ngrams(F.col("token")), n_buckets)).alias("bucket")).join(weights, "bucket")
    per = rows.groupBy("token").agg(F.count("*").alias("n"), *(F.sum(F.col("embedding")[k]).alias(f"s{k}") for k in range(dim)))
    held = tokens.join(per, "token")
    mean = held.groupBy("request_id").agg(*((F.sum(F.col(f"s{k}") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias(f"d{k}") for k in range(dim)))
    mean = texts.select("request_id").join(mean, "request_id", "left").fillna(0.0)
    z = [sum((F.col(f"d{k}") * w for k, w in enumerate(row)), F.lit(b)) for row, b in zip(linear, bias, strict=True)]
    e = [F.exp(x - F.greatest(*z)) for x in z] if len(z) > 1 else [F.lit(1.0)]
    total = sum(e[1:], e[0])
    label = F.array_position(F.array(*z), F.greatest(*z)).cast("int") - 1
    return mean.select("request_id", label.alias("label"), (e[violation] / total).alias("score"), (label == violation).alias("violation"))
