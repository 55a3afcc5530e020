"""As-of joins without a range join: both sides lie in one order of key and time, dealt by key and slice of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str = "found", slices: int = 256, strict: bool = False) -> DataFrame:
    """Rows of ``left`` with ``value``, the struct of the last row of ``right`` of the same key at or before their time; null if there is none.

    ``at`` names the time of both, a timestamp or a number; with ``strict`` only rows before it count. Of right rows of one
    key and time the largest struct is the last. Null times and keys find nothing.

    A key with a third of all rows is dealt by slices of time: what holds when a slice begins is found first, of one row
    a key and slice that has rows on the left, and then stands at the slice's beginning among the right rows of that slice.
    """
    timed = dict(left.dtypes)[at].startswith("timestamp")
    seconds = lambda c: F.col(c).cast("timestamp").cast("double") if timed else F.col(c).cast("double")
    low, high = left.agg(F.min(seconds(at)), F.max(seconds(at))).first()
    width = (high - low) / slices if low is not None and high > low else 1.0
    # a slice's number never falls as time goes on, whatever rounding does
    number: Column = F.greatest(F.lit(-1), F.least(F.lit(slices), F.floor((seconds(at) - F.lit(low or 0.0)) / F.lit(width)))).cast("int")
    if not on:
        left, right, on = left.withColumn("key_", F.lit(0)), right.withColumn("key_", F.lit(0)), ["key_"]
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in [*on, at]))
    marks = right.where(known).select(*on, F.col(at).alias("at_"), number.alias("slice_"), F.struct(*(c for c in right.columns if c != "key_")).alias("mark_"))
    rows = left.withColumn("slice_", F.when(known, number))
    # what each slice of a key that has rows begins with: the last mark of the slices before
    per = marks.groupBy(*on, "slice_").agg(F.max(F.struct("at_", "mark_")).alias("last_"))
    begins = rows.where(known).select(*on, "slice_").distinct()
    both = per.select(*on, "slice_", F.lit(1).alias("kind_"), "last_").unionByName(begins.select(*on, "slice_", F.lit(0).alias("kind_"), F.lit(None).cast(dict(per.dtypes)["last_"]).alias("last_")))
    before = F.last("last_", ignorenulls=True).over(Window.partitionBy(*on).orderBy("slice_", "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = both.withColumn("last_", before).where("kind_ = 0 AND last_ IS NOT NULL").select(*on, "slice_", F.lit(None).cast(dict(marks.dtypes)["at_"]).alias("at_"), "last_.mark_")
    # one order of marks and rows within a key's slice; a mark goes before rows of its time, or after them if it has to lie before
    first = F.lit(2 if strict else 0)
    marked = start.unionByName(marks).select(*on, "slice_", "at_", first.alias("kind_"), "mark_", F.lit(None).cast(rows.select(F.struct(*left.columns)).schema[0].dataType).alias("row_"))
    asked = rows.where(known).select(*on, "slice_", F.col(at).alias("at_"), F.lit(1).alias("kind_"), F.lit(None).cast(dict(marks.dtypes)["mark_"]).alias("mark_"), F.struct(*left.columns).alias("row_"))
    order = Window.partitionBy(*on, "slice_").orderBy(F.col("at_").asc_nulls_first(), "kind_", "mark_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marked.unionByName(asked).withColumn("mark_", F.last("mark_", ignorenulls=True).over(order)).where("row_ IS NOT NULL").select("row_.*", F.col("mark_").alias(value))
    none = left.where(~F.coalesce(known, F.lit(False))).withColumn(value, F.lit(None).cast(dict(marks.dtypes)["mark_"]))
    return found.unionByName(none).drop("key_")


def permanent_list_at(requests: DataFrame, changes: DataFrame, key: str = "hash", at: str = "ts") -> DataFrame:
    """``requests`` (request_id, hash, ts) with ``verdict``: black or white by the lists as they stood at each request's time, or null.

    ``changes`` is the log of the lists, (ts, seq, op, hash, color): ``add`` puts a hash on a list, ``remove`` takes it off;
    rows of ``replace`` at one time are the whole new lists, so every hash that isn't among them is off; ``invalidate``
    empties them. A change holds from its time on; of several at one time that of the larger ``seq`` is the last, black
    stands before white among the rows of one ``replace``.
    """
    whole = changes.where("op IN ('replace', 'invalidate')").groupBy(at).agg(F.max("seq").alias("whole_seq")).withColumn("whole_at", F.col(at))
    own = changes.where("op <> 'invalidate'").select(at, "seq", F.when(F.col("op") != "remove", F.col("color")).alias("color"), (F.col("color") == "black").alias("strong"), key)
    state = asof(requests, own.select(at, "seq", "strong", "color", key), [key], at, "state")
    state = asof(state, whole.select(at, "whole_seq"), [], at, "emptied")
    gone = (F.col(f"emptied.{at}") > F.col(f"state.{at}")) | ((F.col(f"emptied.{at}") == F.col(f"state.{at}")) & (F.col("emptied.whole_seq") > F.col("state.seq")))
    return state.withColumn("verdict", F.when(~F.coalesce(gone, F.lit(False)), F.col("state.color"))).drop("state", "emptied")
