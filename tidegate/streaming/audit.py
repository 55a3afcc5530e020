"""Streaming forms: audit logs and decisions into a log sink, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.sources.log_sink import LogSink


def windowed_counts(logs: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and violations by window and source; rows later than the watermark are dropped."""
    counted = logs.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "source")
    return counted.agg(F.count("*").alias("n"), F.count_if("has_violation").alias("violations")).select(F.col("w.start").alias("start"), "source", "n", "violations")


def write_logs(logs: DataFrame, path: str, checkpoint: str, key: str = "request_id"):
    """Append each batch once under its number; a key that comes again is passed over if its row is the same, else the stream stops."""
    sink = LogSink(logs.sparkSession, path, key)
    return logs.writeStream.foreachBatch(lambda batch, number: sink.append(batch, number)).option("checkpointLocation", checkpoint)


def audited(requests: DataFrame, decide, path: str, checkpoint: str, key: str = "request_id"):
    """``decide`` (a batch plan such as the funnel) over each batch of requests, its decisions appended once."""
    sink = LogSink(requests.sparkSession, path, key)
    return requests.writeStream.foreachBatch(lambda batch, number: sink.append(decide(batch), number)).option("checkpointLocation", checkpoint)
