import pytest
from pyspark.sql import functions as F

from tidegate.sources.log_sink import Conflict, LogSink
from tidegate.sources.versions import Published, dedup_lexicon, merge_manifest, replace_after_backup
from tidegate.streaming import audit

ROW = "request_id string, v int, note string"


def test_readers_see_whole_versions_only(spark, tmp_path):
    p = Published(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        p.read()
    assert p.current() is None and p.versions() == []
    assert p.publish(spark.range(3)) == 1
    assert p.read().count() == 3

    def wrong(df):
        raise RuntimeError("checked and found wrong")

    with pytest.raises(RuntimeError):
        p.publish(spark.range(5), wrong)
    assert p.current() == 1 and p.read().count() == 3, "a failure before the swap leaves readers where they were"
    with pytest.raises(Exception, match="broke"):
        p.publish(spark.range(2).select(F.raise_error(F.lit("broke")).cast("int").alias("x")))
    assert p.current() == 1 and 3 not in p.versions(), "a version that wasn't written whole is none"
    assert p.publish(spark.range(7)) == 4 and p.read().count() == 7
    assert p.roll_back() == 2 and p.read().count() == 5 and p.roll_back() == 1
    with pytest.raises(ValueError):
        p.roll_back()
    with pytest.raises(ValueError):
        p.point(3)
    assert Published(spark, str(tmp_path / "t")).current() == 1


def test_a_change_waits_for_its_backup(spark, tmp_path, monkeypatch):
    words = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "b")], "category string, word string")
    table, backup = Published(spark, str(tmp_path / "t")), Published(spark, str(tmp_path / "b"))
    table.publish(words)
    kept, new = replace_after_backup(table, backup, lambda df: df.distinct())
    assert (kept, new) == (1, 2) and backup.read().count() == 3 and table.read().count() == 2
    monkeypatch.setattr(backup, "publish", lambda rows, check: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError):
        replace_after_backup(table, backup, lambda df: df.limit(0))
    assert table.current() == 2 and table.read().count() == 2


def test_manifests_are_merged_and_lexicons_cleared_by_version(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "line_no long, pool string, text string")
    table = Published(spark, str(tmp_path / "m"))
    table.publish(make((1, "black", "a"), (2, "white", "a"), (5, "black", "b")))
    new = make((1, "black", "b"), (2, "black", "c"), (3, "black", "c"))

    def wrong(df):
        assert df.count() > 100, "too few"

    with pytest.raises(AssertionError, match="too few"):
        merge_manifest(table, new, wrong)
    assert table.read().count() == 3
    merge_manifest(table, new)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "black", "a"), (2, "white", "a"), (5, "black", "b"), (7, "black", "c")]
    words = Published(spark, str(tmp_path / "w"))
    words.publish(spark.createDataFrame([(1, "c", "ab"), (2, "c", "ａｂ"), (3, "d", "ab"), (4, "c", "a, b!"), (5, "c", "AB")], "id long, category string, word string"))
    assert dedup_lexicon(words, Published(spark, str(tmp_path / "wb"))) == (1, 2)
    assert sorted(r.id for r in words.read().collect()) == [1, 3, 5]


def batch(spark, *rows):
    return spark.createDataFrame(rows, ROW)


def test_each_row_once_and_conflicts_raise(spark, tmp_path):
    sink = LogSink(spark, str(tmp_path / "log"), buckets=8)
    with pytest.raises(FileNotFoundError):
        sink.read()
    assert sink.append(batch(spark, ("a", 1, None), ("b", 2, "x"), ("b", 2, "x")), 0) == 2
    assert sink.append(batch(spark, ("a", 1, None), ("c", 3, "y")), 1) == 1, "an equal row of a known key is passed over"
    assert sink.append(batch(spark, ("z", 9, "")), 1) == 0, "a batch that is done adds nothing"
    for rows in ((("a", 5, None), ("d", 4, None)), (("e", 1, None), ("e", 2, None))):
        with pytest.raises(Conflict):
            sink.append(batch(spark, *rows), 2)
    assert sorted(r.request_id for r in sink.read().collect()) == ["a", "b", "c"]
    assert sink.append(batch(spark, ("d", 4, None), (None, 0, None)), 2) == 2
    assert LogSink(spark, str(tmp_path / "log"), buckets=8).read().count() == 5


def test_a_batch_that_broke_off_is_written_over(spark, tmp_path, monkeypatch):
    sink = LogSink(spark, str(tmp_path / "log"), buckets=4)
    sink.append(batch(spark, ("a", 1, None)), 0)
    monkeypatch.setattr(sink.filters, "publish", lambda rows: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sink.append(batch(spark, ("b", 2, None)), 1)
    again = LogSink(spark, str(tmp_path / "log"), buckets=4)
    assert [r.request_id for r in again.read().collect()] == ["a"], "rows without their filters aren't in the log yet"
    assert again.append(batch(spark, ("b", 2, None)), 1) == 1
    assert sorted(r.request_id for r in again.read().collect()) == ["a", "b"]


def test_a_batch_reads_only_buckets_that_may_hold_its_keys(spark, tmp_path):
    sink = LogSink(spark, str(tmp_path / "log"), buckets=16)
    for k in range(3):
        sink.append(spark.range(200).select(F.concat(F.lit(f"{k}-"), F.col("id").cast("string")).alias("request_id"), F.col("id").cast("int").alias("v"), F.lit(None).cast("string").alias("note")), k)
    assert sink.touched(batch(spark, ("new-1", 1, None), ("new-2", 1, None))) == []
    assert len(sink.touched(batch(spark, ("0-7", 7, None)))) == 1
    assert sink.append(batch(spark, ("0-7", 7, None), ("new", 1, None)), 3) == 1


def test_a_stream_of_logs_is_written_once_and_stops_at_a_conflict(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batch(spark, ("a", 1, "x"), ("b", 2, "y")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: audit.write_logs(spark.readStream.schema(ROW).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream().awaitTermination(60)
    batch(spark, ("a", 1, "x"), ("c", 3, "z")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream().awaitTermination(60)
    sink = LogSink(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in sink.read().collect()) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")]
    batch(spark, ("a", 9, "other")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = stream()
    with pytest.raises(Exception, match="other contents"):
        q.awaitTermination(60)
    assert sink.read().count() == 3
