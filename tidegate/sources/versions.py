"""Tables that are published by version: written aside, checked, and then named by a pointer in one step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import corpus, keywords


class Published:
    """A table in a folder: ``v=<n>`` holds version n, the file CURRENT its number. Readers always see a whole version.

    Files are handled by Hadoop's file systems, so any store that Spark writes to will do. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        """The number that readers see; None before the first publication."""
        at = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Versions that were written whole, in order."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        number = self.current() if version is None else version
        if number is None:
            raise FileNotFoundError(f"nothing is published in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v={number}")

    def write(self, rows: DataFrame) -> int:
        """Write a version that no reader sees yet; its number."""
        taken = [int(s.getPath().getName()[2:]) for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName().startswith("v=")] if self._fs.exists(self._path(self.folder)) else []
        number = max(taken, default=0) + 1
        rows.write.mode("errorifexists").parquet(f"{self.folder}/v={number}")
        return number

    def point(self, version: int) -> None:
        """Let readers see a version: the pointer is written aside and moved over the old one."""
        if version not in self.versions():
            raise ValueError(f"no version {version} in {self.folder}")
        aside, at = self._path(f"{self.folder}/.CURRENT.{version}"), self._path(f"{self.folder}/CURRENT")
        stream = self._fs.create(aside, True)
        stream.write(str(version).encode())
        stream.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(at), options)

    def publish(self, rows: DataFrame, check: Callable[[DataFrame], None] | None = None) -> int:
        """Write, check what was written, then point to it. Whatever fails before that leaves readers where they were."""
        version = self.write(rows)
        if check is not None:
            check(self.read(version))
        self.point(version)
        return version

    def roll_back(self) -> int:
        """Point to the version before the current one."""
        now = self.current()
        older = [v for v in self.versions() if now is not None and v < now]
        if not older:
            raise ValueError(f"no version before {now} in {self.folder}")
        self.point(older[-1])
        return older[-1]


def replace_after_backup(table: Published, backup: Published, change: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], None] | None = None) -> tuple[int, int]:
    """(backup's version, new version): the table is copied to ``backup``, and only then ``change`` of it published.

    A backup that fails, or doesn't hold as many rows as the table, stops the change.
    """
    now = table.read()
    rows = now.count()

    def whole(copy: DataFrame) -> None:
        if copy.count() != rows:
            raise ValueError("the backup isn't whole")

    kept = backup.publish(now, whole)
    return kept, table.publish(change(table.read()), check)


def merge_manifest(table: Published, new: DataFrame, check: Callable[[DataFrame], None] | None = None) -> int:
    """Publish the manifest with the lines of ``new`` behind its own, the first of each (pool, text); the version.

    Lines keep their order: those of ``new`` are numbered from behind the last.
    """
    now = table.read()
    last = now.agg(F.coalesce(F.max("line_no"), F.lit(0))).first()[0]
    merged = corpus.manifest_merge(now, new.withColumn("line_no", F.col("line_no") + last))
    return table.publish(merged.drop("file"), check)


def dedup_lexicon(table: Published, backup: Published) -> tuple[int, int]:
    """(backup's version, new version): of words of a category that read the same without width and punctuation the smallest id stays."""

    def first(words: DataFrame) -> DataFrame:
        kept = keywords.dedup_words(words).where("id = kept_id").select("id")
        return words.join(kept, "id", "left_semi")

    return replace_after_backup(table, backup, first)
