"""Rows that a stage can't take, set aside with what is wrong, so that the rest of the batch runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "request_id long, stage string, error string"


def split_rows(rows: DataFrame, stage: str, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, (request_id, stage, error) of the others): the error is the first test that is true; null counts as false.

    ``tests`` go from what is said of a row to the column that tells whether it is so.
    """
    said = reduce(lambda c, t: c.when(F.coalesce(t[1], F.lit(False)), F.lit(t[0])), tests.items(), F)
    marked = rows.withColumn("error_", said)
    return marked.where("error_ IS NULL").drop("error_"), marked.where("error_ IS NOT NULL").select("request_id", F.lit(stage).alias("stage"), F.col("error_").alias("error"))


def wrong_vectors(vectors: DataFrame, column: str, dim: int | None) -> tuple[DataFrame, DataFrame]:
    """Vectors that can be compared with those of ``dim`` components, and the others: another length, a null, or one that isn't finite.

    A vector that is null altogether is no error: there is none.
    """
    v = F.col(column)
    tests = {"a component is null": F.exists(v, lambda x: x.isNull()), "a component is not finite": F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))}
    if dim is not None:
        tests = {f"not {dim} components": v.isNotNull() & (F.size(v) != dim)} | tests
    return split_rows(vectors, "semantic", tests)


def wrong_replies(replies: DataFrame, parsed: str = "verdict") -> tuple[DataFrame, DataFrame]:
    """Replies of a judging model that hold a verdict, and the others; a null reply is one that wasn't given."""
    return split_rows(replies, "llm", {"no verdict in the reply": F.col("reply").isNotNull() & F.col(parsed).isNull()})
