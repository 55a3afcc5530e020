"""An audit log in buckets of its key, written batch by batch exactly once; a batch reads only buckets that may hold its keys."""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.sources.versions import Published

HASHES = 4


class Conflict(ValueError):
    """A key that the log holds with other contents."""


def _bits(keys, size: int) -> np.ndarray:
    """(keys, HASHES) places in a filter of ``size`` bits."""
    two = np.array([(h & (2**64 - 1), (h >> 64) | 1) for h in (xxhash.xxh3_128_intdigest(k) for k in keys)], dtype=np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        return (two[:, :1] + two[:, 1:] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)


class LogSink:
    """Appends batches of rows to ``folder``/rows, parted by batch and bucket, with a filter of each bucket's keys in ``folder``/filters.

    A batch is numbered, as those of a stream are. It is written over what an attempt of the same number left, so a restart
    repeats no row. Rows whose key an earlier batch has are passed over if they are the same in all columns, else the
    batch raises ``Conflict`` and writes nothing; so it does for two unlike rows of one key within it. Only buckets whose filter has
    a key of the batch are read, of them the key and a hash of the row; filters are of a fixed size and a batch reads as many
    as it touches. They are published by version after the rows, so a filter never lacks a key that is in the log.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "request_id", buckets: int = 64, filter_bits: int = 1 << 20):
        self.spark, self.folder, self.key, self.buckets, self.size = spark, folder.rstrip("/"), key, buckets, filter_bits
        self.filters = Published(spark, f"{self.folder}/filters")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _filters(self) -> DataFrame:
        """(bucket, bits, batch) of the batches that are done."""
        if self.filters.current() is None:
            return self.spark.createDataFrame([], "bucket int, bits binary, batch long")
        return self.filters.read()

    def read(self) -> DataFrame:
        """The log: rows of the batches that are done."""
        done = self._filters().agg(F.max("batch")).first()[0]
        if done is None:
            raise FileNotFoundError(f"no batch is done in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/rows").where(F.col("batch") <= done).drop("bucket", "batch")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets whose filter has a key of the rows: those that may hold it already."""
        size = self.size

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            bits = pdf["bits"].dropna()
            if not len(bits):
                return pd.DataFrame({"bucket": [], "hit": []})
            held = np.unpackbits(np.frombuffer(bits.iloc[0], np.uint8), bitorder="little")
            keys = pdf["k"].dropna()
            return pd.DataFrame({"bucket": [key[0]], "hit": [bool(len(keys)) and bool(held[_bits(keys, size)].all(axis=1).any())]})

        keys = self._bucketed(rows).select("bucket", F.col(self.key).cast("string").alias("k"), F.lit(None).cast("binary").alias("bits"))
        both = keys.unionByName(self._filters().select("bucket", F.lit(None).cast("string").alias("k"), "bits"))
        # a bucket of a micro-batch and its filter meet in one task; both are bounded
        return sorted(r["bucket"] for r in both.groupBy("bucket").applyInPandas(run, "bucket int, hit boolean").where("hit").collect())

    def append(self, rows: DataFrame, batch: int) -> int:
        """How many rows of the batch were new. A batch that is done already adds nothing."""
        done = self._filters().agg(F.max("batch")).first()[0]
        if done is not None and batch <= done:
            return 0
        named = rows.columns
        marked = self._bucketed(rows).withColumn("same_", F.xxhash64(*(F.col(c) for c in named))).persist()
        try:
            twice = marked.groupBy(self.key).agg(F.count_distinct("same_").alias("n")).where("n > 1").select(self.key).limit(3).collect()
            if twice:
                raise Conflict(f"unlike rows of one key: {', '.join(str(r[0]) for r in twice)}")
            fresh = marked.dropDuplicates([self.key])
            buckets = self.touched(rows)
            if buckets:
                known = self.spark.read.parquet(f"{self.folder}/rows").where(F.col("bucket").isin(buckets) & (F.col("batch") < batch))
                known = known.select(F.col(self.key).alias("k_"), F.xxhash64(*(F.col(c) for c in named)).alias("was_"))
                met = fresh.join(known, F.col(self.key) == F.col("k_"))
                other = met.where("same_ <> was_").select(self.key).limit(3).collect()
                if other:
                    raise Conflict(f"already in the log with other contents: {', '.join(str(r[0]) for r in other)}")
                fresh = fresh.join(known, F.col(self.key) == F.col("k_"), "left_anti")
            at = f"{self.folder}/rows/batch={batch}"
            fresh.select(*named, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        finally:
            marked.unpersist()
        written = self.spark.read.schema(f"`{self.key}` {dict(rows.dtypes)[self.key]}, bucket int").parquet(at)
        self.filters.publish(self._merged(written, batch))
        return written.count()

    def _merged(self, written: DataFrame, batch: int) -> DataFrame:
        size = self.size

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            held = np.zeros(size, dtype=bool)
            for bits in pdf["bits"].dropna():
                held |= np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
            keys = pdf["k"].dropna()
            if len(keys):
                held[_bits(keys, size).ravel()] = True
            return pd.DataFrame({"bucket": [key[0]], "bits": [np.packbits(held, bitorder="little").tobytes()]})

        old = self._filters().select("bucket", F.lit(None).cast("string").alias("k"), "bits")
        none = self.spark.range(1).select(F.lit(0).alias("bucket"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("binary").alias("bits"))
        keys = written.select("bucket", F.col(self.key).cast("string").alias("k"), F.lit(None).cast("binary").alias("bits"))
        merged = keys.unionByName(old).unionByName(none).groupBy("bucket").applyInPandas(run, "bucket int, bits binary")
        return merged.withColumn("batch", F.lit(batch).cast("long"))
