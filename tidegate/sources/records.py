"""Delimited files of any encoding, width and quoting, read in splits: bytes first, then lines, quotes, records, cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARK = b"\xef\xbb\xbf"


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, block, k, data): the lines of files as bytes without their ends, ``k`` from 0 in each block of a file that a task reads.

    Nothing is decoded here, so splits fall where they like. ``pattern`` is a glob that files' names have to match, at any depth.
    """
    reader = spark.read.option("lineSep", "\n")
    if pattern is not None:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"), F.monotonically_increasing_id().alias("at"))
    k = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    end = F.when(F.substring("data", -1, 1) == F.lit(b"\r"), F.expr("substring(data, 1, length(data) - 1)")).otherwise(F.col("data"))
    return lines.withColumn("k", k).select("path", "block", "k", end.alias("data"))


def _before(per: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the blocks of a file before each; one row a block is all that meets."""
    earlier = F.sum(value).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return per.select("path", "block", F.coalesce(earlier, F.lit(0)).alias(name))


def decoded_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, block, line_no, line): lines as text, numbered from 0 in each file without gaps.

    A file that is UTF-8 as a whole, with or without a mark, is read so; else it is GBK (read as its superset GB18030), and one
    that is neither raises an error.
    """
    lines = numbered_lines(spark, path, pattern)
    per = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.bool_and(F.is_valid_utf8(F.col("data").cast("string"))).alias("utf8"))
    whole = per.groupBy("path").agg(F.bool_and("utf8").alias("whole"))
    first = _before(per, "n", "first").join(whole, "path")

    @F.pandas_udf("string")
    def gbk(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else b.decode("gb18030"))

    rows = lines.join(first, ["path", "block"]).withColumn("line_no", F.col("first") + F.col("k"))
    marked = (F.col("line_no") == 0) & (F.substring("data", 1, 3) == F.lit(MARK))
    data = F.when(marked, F.expr("substring(data, 4)")).otherwise(F.col("data"))
    text = F.coalesce(gbk(F.when(~F.col("whole"), data)), F.when(F.col("whole"), data.cast("string")), F.lit(""))
    return rows.select("path", "block", "line_no", text.alias("line"))


def records(spark: SparkSession, path: str, pattern: str | None = None, quote: str = '"') -> DataFrame:
    """(path, record_no, text): the records of delimited files: lines, those joined by their line feeds that a quoted cell spans.

    A line begins inside quotes if an odd number of them stands before it in the file, so quotes are counted by block, the
    counts summed in order of the blocks, and the lines of a block numbered by record from there.
    """
    lines = decoded_lines(spark, path, pattern)
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit(""))))
    within = Window.partitionBy("path", "block").orderBy("line_no")
    lines = lines.withColumn("so_far", F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = lines.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"))
    lines = lines.join(_before(per, "quotes", "earlier"), ["path", "block"])
    begins = ((F.col("earlier") + F.col("so_far")) % 2 == 0).cast("int")
    lines = lines.withColumn("begins", begins)
    starts = _before(lines.groupBy("path", "block").agg(F.sum("begins").alias("n")), "n", "records")
    lines = lines.withColumn("own", F.sum("begins").over(within)).join(starts, ["path", "block"])
    number = F.col("records") + F.col("own") - 1
    grouped = lines.groupBy("path", number.alias("record_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return grouped.select("path", "record_no", F.array_join(F.transform("x", lambda p: p["line"]), "\n").alias("text"))


def cells(text: str, separator: str = ",", quote: str = '"') -> list[str]:
    """A record's cells. A quoted cell may hold separators and line feeds; a doubled quote in it is one."""
    out, at, n = [], 0, len(text)
    while True:
        if text[at : at + 1] == quote:
            parts, begin = [], at + 1
            while True:
                end = text.find(quote, begin)
                if end < 0:
                    parts.append(text[begin:])
                    at = n
                    break
                parts.append(text[begin:end])
                if text[end + 1 : end + 2] == quote:
                    parts.append(quote)
                    begin = end + 2
                else:
                    at = end + 1
                    break
            stop = text.find(separator, at)
            rest = text[at : stop if stop >= 0 else n]
            out.append("".join(parts) + rest)
        else:
            stop = text.find(separator, at)
            out.append(text[at : stop if stop >= 0 else n])
        if stop < 0:
            return out
        at = stop + 1


def read_cells(spark: SparkSession, path: str, pattern: str | None = None, separator: str = ",") -> DataFrame:
    """(path, record_no, cells) of the records of which one cell at least isn't blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "record_no": pdf["record_no"], "cells": [cells(t, separator) for t in pdf["text"]]})

    rows = records(spark, path, pattern).mapInPandas(run, "path string, record_no long, cells array<string>")
    return rows.where(F.exists("cells", lambda c: F.trim(c) != ""))


def read_table(spark: SparkSession, path: str, columns: list[str], pattern: str | None = None, separator: str = ",", required: tuple[str, ...] = ()) -> DataFrame:
    """(path, record_no, *columns): cells under the names that each file's first record gives, in any case and order.

    Files may have any other columns and as many as they like; a column that a file lacks is null, and one of ``required``
    raises an error for such a file. Cells that a short record lacks are null.
    """
    rows = read_cells(spark, path, pattern, separator)
    first = rows.groupBy("path").agg(F.min_by("cells", "record_no").alias("head"), F.min("record_no").alias("top"))
    names = F.transform("head", lambda c: F.lower(F.trim(c)))
    places = [F.array_position(names, F.lit(c.strip().lower())).cast("int") for c in columns]
    found = first.select("path", "top", *(F.when(p > 0, p - 1).alias(f"at{k}") for k, p in enumerate(places)))
    rows = rows.join(found, "path").where(F.col("record_no") > F.col("top"))

    def cell(k: int, name: str):
        missing = F.raise_error(F.concat(F.lit(f"no column {name} in "), F.col("path"))).cast("string") if name in required else F.lit(None).cast("string")
        return F.when(F.col(f"at{k}").isNull(), missing).otherwise(F.get("cells", F.col(f"at{k}"))).alias(name)

    return rows.select("path", "record_no", *(cell(k, c) for k, c in enumerate(columns)))
