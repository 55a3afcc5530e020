import pytest
from pyspark.sql import functions as F

from tidegate.config import DEFAULTS
from tidegate.operators import caches
from tidegate.sources import files, records
from tidegate.sources.log_sink import LogSink
from tidegate.streaming import audit, limits


def test_files(spark, tmp_path):
    (tmp_path / "lex" / "sub").mkdir(parents=True)
    (tmp_path / "lex" / "spam.txt").write_text("one\n# no\n\n two \n//no\n")
    (tmp_path / "lex" / "sub" / "abuse.txt").write_text("three\n")
    (tmp_path / "lex" / "kinds.csv").write_text("word,type\nfour,x\nfive,\n")
    assert {tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "lex")).collect()} == {("spam", "one"), ("spam", "two"), ("abuse", "three")}
    assert {tuple(r) for r in files.read_lexicon_csv(spark, str(tmp_path / "lex")).collect()} == {("x", "four"), ("kinds", "five")}
    (tmp_path / "c.csv").write_text('text,cat\n"a ""q"" b",x\n,\n  ,y\nz,\n')
    assert {tuple(r) for r in files.read_corpus(spark, str(tmp_path / "c.csv"), "text", "cat", "s").collect()} == {('a "q" b', "x", "s"), ("z", "", "s")}
    (tmp_path / "g.txt").write_bytes("赌博".encode("gbk"))
    assert files.read_lines(spark, str(tmp_path / "g.txt")).first().line == "赌博"
    (tmp_path / "k.csv").write_text("类别,关键词\nc,w\n")
    assert [tuple(r) for r in files.read_keyword_import(spark, str(tmp_path / "k.csv")).collect()] == [("c", "w", "admin_import")]
    (tmp_path / "r.csv").write_text("category,pattern,action\n,ab,\nc,cd,violate\nc,,exempt\n")
    assert [tuple(r) for r in files.read_rules(spark, str(tmp_path / "r.csv")).collect()] == [("", "ab", "exempt"), ("c", "cd", "violate")]
    (tmp_path / "m.jsonl").write_text('{"pool": "black", "text": "a"}\nbroken\n\n[1]\n{"pool": "white", "text": "b"}\n')
    rows = files.read_manifest(spark, str(tmp_path / "m.jsonl")).orderBy("line_no").collect()
    assert [(r.pool, r.text) for r in rows] == [("black", "a"), ("white", "b")]
    (tmp_path / "img" / "black").mkdir(parents=True)
    (tmp_path / "img" / "black" / "a.PNG").write_bytes(b"x")
    (tmp_path / "img" / "b.png").write_bytes(b"x")
    assert [r.pool for r in files.read_images(spark, str(tmp_path / "img")).collect()] == ["black"]


def test_records_of_split_files(spark, tmp_path):
    """Quoted line feeds and separators, doubled quotes, marks, GBK, wide rows; files cut anywhere."""
    import csv
    import io
    import random

    rng = random.Random(7)
    cells = ["a", "", "x, y", 'say "no"', "two\nlines", "\n", "赌博", " ", "é", '"', "long " * 40]
    written = {}
    for name, encoding in (("a.csv", "utf-8-sig"), ("b.csv", "gbk"), ("c.csv", "utf-8"), ("d.csv", "utf-8")):
        rows = [["Text", *(f"c{k}" for k in range(40))]] + [[rng.choice(cells if encoding != "gbk" else [c for c in cells if c != "é"]) for _ in range(41)] for _ in range(60)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n" if name == "c.csv" else "\n", quoting=csv.QUOTE_ALL if name == "d.csv" else csv.QUOTE_MINIMAL).writerows(rows)
        (tmp_path / name).write_bytes(out.getvalue().encode(encoding))
        written[name] = [r for r in rows if any(c.strip(" ") for c in r)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "2000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = records.numbered_lines(spark, str(tmp_path))
            blocks = lines.select("path", "block").distinct().count()
            assert blocks == 4 if size == old else blocks > 40
            got = {}
            for r in records.read_cells(spark, str(tmp_path)).orderBy("path", "record_no").collect():
                got.setdefault(r.path.rsplit("/", 1)[1], []).append(list(r.cells))
            assert got == written
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = records.read_table(spark, str(tmp_path / "a.csv"), ["c39", "TEXT", "none"]).orderBy("record_no").collect()
    assert [(r.c39, r.TEXT, r.none) for r in rows] == [(r[40], r[0], None) for r in written["a.csv"][1:]]
    with pytest.raises(Exception, match="no column none"):
        records.read_table(spark, str(tmp_path / "a.csv"), ["none"], required=("none",)).collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.txt").write_bytes(b"\xff\xff\xff\n")
    with pytest.raises(Exception, match="gb18030"):
        records.decoded_lines(spark, str(tmp_path / "bad")).collect()
    assert records.cells('a,"b""c",,"d') == ["a", 'b"c', "", "d"] and records.cells("") == [""]


def test_gbk_corpora_and_lexicons(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("正文,类别\n\"裸聊,\n加我\",色情\n正常,\n".encode("gbk"))
    assert {tuple(r) for r in files.read_corpus(spark, str(tmp_path / "c.csv"), "正文", "类别", "s").collect()} == {("裸聊,\n加我", "色情", "s"), ("正常", "", "s")}
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex" / "赌 博.txt").write_bytes("赌博\r\n// no\r\n老虎机\r\n".encode("gbk"))
    (tmp_path / "lex" / "utf.txt").write_bytes("\ufeff词\n".encode())
    assert {tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "lex")).collect()} == {("赌 博", "赌博"), ("赌 博", "老虎机"), ("utf", "词")}
    (tmp_path / "lex" / "k.csv").write_bytes("type,word\n甲,乙\n,丙\n".encode("gbk"))
    assert {tuple(r) for r in files.read_lexicon_csv(spark, str(tmp_path / "lex")).collect()} == {("甲", "乙"), ("k", "丙")}


def test_corpora_by_file_and_by_class(spark, tmp_path):
    (tmp_path / "safe.csv").write_text("t\nfine\n")
    (tmp_path / "bad.csv").write_text("t,k\nawful,abuse\nworse,\n")
    (tmp_path / "mixed.csv").write_text("text,label\nok,normal\nno,spam\n ,spam\n")
    at = lambda n: str(tmp_path / n)
    rows = files.read_corpora(spark, [(at("safe.csv"), "t")], [(at("bad.csv"), "t", "k")], [(at("mixed.csv"), "text", "label")]).collect()
    assert sorted(map(tuple, rows)) == [("awful", "abuse", "bad.csv", "black"), ("fine", "", "safe.csv", "white"), ("no", "spam", "mixed.csv", "black"), ("ok", "normal", "mixed.csv", "white"), ("worse", "", "bad.csv", "black")]
    assert files.read_corpora(spark).collect() == []


def test_manifest_lines_have_no_gaps_and_may_be_strict(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.jsonl").write_text('{"pool": "black", "text": "a"}\n\nbroken\n{"pool": "white", "text": "b"}\n')
    (tmp_path / "m" / "b.jsonl").write_text('{"pool": "white", "text": "c"}\n')
    assert [(r.line_no, r.text) for r in files.read_manifest(spark, str(tmp_path / "m")).orderBy("line_no").collect()] == [(1, "a"), (4, "b"), (5, "c")]
    with pytest.raises(Exception, match="line 3: not a JSON object"):
        files.read_manifest(spark, str(tmp_path / "m"), strict=True).collect()


def test_chats_of_many_columns(spark, tmp_path):
    head = ",".join([*(f"c{k}" for k in range(30)), "Sender", "CONTENT"])
    (tmp_path / "g.csv").write_text(head + "\n" + "," * 30 + 'a,"one\ntwo"\n' + "," * 31 + "\n")
    assert [tuple(r) for r in files.read_chats(spark, str(tmp_path / "g.csv"), text="Content").collect()] == [("one\ntwo", "a", None)]
    with pytest.raises(Exception, match="no column message"):
        files.read_chats(spark, str(tmp_path / "g.csv"), text="message").collect()


def test_import_files(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.csv").write_text("\n,\nCategory,Word\nc,w\ncategory,keyword\n")
    (tmp_path / "k" / "b.csv").write_text("d,x\n,y\n")
    rows = files.read_keyword_import(spark, str(tmp_path / "k")).collect()
    assert sorted(r[:2] for r in map(tuple, rows)) == [("c", "w"), ("category", "keyword"), ("d", "x")], "only the first filled row of a file can be its header"
    (tmp_path / "w.txt").write_text("one\n\n# no\n two \n")
    assert [r.word for r in files.read_keyword_lines(spark, str(tmp_path / "w.txt"), "c").collect()] == ["one", "two"]
    (tmp_path / "g.csv").write_bytes("time,sender,content\n1,a,你好\n2,b,  \n3,,\"x, y\"\n".encode("gbk"))
    assert sorted((tuple(r) for r in files.read_chats(spark, str(tmp_path / "g.csv")).collect()), key=lambda r: r[2]) == [("你好", "a", "1"), ("x, y", None, "3")]
    (tmp_path / "l.txt").write_bytes("甲\r\n乙".encode("gbk"))
    assert [(r.line_no, r.line) for r in files.read_lines(spark, str(tmp_path / "l.txt")).orderBy("line_no").collect()] == [(0, "甲"), (1, "乙")]
    (tmp_path / "r.json").write_text('[{"pattern": "a", "action": "VIOLATE"}, {"category": "c", "pattern": "b"}]')
    assert [tuple(r) for r in files.read_rules(spark, str(tmp_path / "r.json")).collect()] == [("", "a", "violate"), ("c", "b", "exempt")]
    for bad, text in (("allow", '{"pattern": "a", "action": "allow"}'), ("not a rule", "[1, 2]")):
        (tmp_path / "bad.jsonl").write_text(text)
        with pytest.raises(Exception, match=bad):
            files.read_rules(spark, str(tmp_path / "bad.jsonl")).collect()


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(1, "black", "a,b\n\"c\"", "x", "s", None), (2, "white", "d", "y", "s", None)], "line_no long, pool string, text string, category string, source string, image_path string")
    files.write_manifest(rows.drop("line_no"), str(tmp_path / "m"))
    assert {r.text for r in files.read_manifest(spark, str(tmp_path / "m")).collect()} == {'a,b\n"c"', "d"}
    files.write_corpus(rows, str(tmp_path / "c"))
    assert {(r.text, r.label) for r in files.read_csv(spark, str(tmp_path / "c")).collect()} == {('a,b\n"c"', "1"), ("d", "0")}
    pools = spark.createDataFrame([(1, "black", [1.0, 2.0])], "vec_id long, pool string, embedding array<float>")
    files.save_pools(pools, str(tmp_path / "p"))
    assert files.load_pools(spark, str(tmp_path / "p"), 2).first().embedding == [1.0, 2.0]
    assert files.load_pools(spark, str(tmp_path / "p"), rows={"black": 1}).count() == 1
    with pytest.raises(ValueError, match="vectors, not"):
        files.load_pools(spark, str(tmp_path / "p"), rows={"black": 2})
    with pytest.raises(Exception, match="has not 3 components"):
        files.load_pools(spark, str(tmp_path / "p"), 3).collect()


def test_log_export_file(spark, tmp_path):
    log = spark.createDataFrame([("r", None, "h", True, 0.5, None, "s", '{"a": "x, y"}', "full")], "request_id string, ts timestamp, text_hash string, has_violation boolean, confidence double, category string, source string, detail_json string, key_tier string")
    files.write_log_export(log.coalesce(1), str(tmp_path / "e"))
    (part,) = (tmp_path / "e").glob("part-*.csv")
    data = part.read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") or data.startswith('"\ufeff'.encode())
    import csv

    rows = list(csv.reader(data.decode("utf-8").replace("\ufeff", "").splitlines()))
    assert rows == [["request_id", "ts", "text_hash", "has_violation", "confidence", "category", "source", "detail_json", "key_tier"], ["r", "", "h", "true", "0.5", "", "s", '{"a": "x, y"}', "full"]]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    for k in range(2):
        events.where(f"event_id % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    named = stream.select(F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("source"), (F.col("event_type") == "error").alias("has_violation"))
    q = audit.write_logs(named, str(tmp_path / "out"), str(tmp_path / "cp1")).start()
    q.processAllAvailable()
    q.stop()
    assert LogSink(spark, str(tmp_path / "out")).read().count() == events.count()
    q = audit.windowed_counts(named, "1 day", "400 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.d, r.event_type): r["count"] for r in events.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").count().collect()}
    assert {(r.start, r.source): r.n for r in spark.table("counts").collect()} == want


def test_the_limit_on_a_stream_out_of_order(spark, tmp_path):
    """Rows come shuffled within the delay; late ones are dropped; the others are decided as a replay in order would, and state goes."""
    import random
    from dataclasses import replace
    from datetime import datetime, timedelta

    for k, v in limits.STATE_STORE.items():
        spark.conf.set(k, v)
    d = replace(DEFAULTS, rate_limit=3, rate_window_s=20.0)
    rng, zero = random.Random(3), datetime(2024, 1, 1)
    rows = sorted((round(rng.random() * 600, 3), k, rng.choice([1, 1, 2, 3])) for k in range(240))
    order = sorted(rows, key=lambda r: r[0] + rng.random() * 25)  # at most 25 s out of order
    schema = "user_id long, event_id long, ts timestamp"
    (tmp_path / "in").mkdir()

    def put(rows, name):
        spark.createDataFrame([(u, e, zero + timedelta(seconds=t)) for t, e, u in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = limits.rate_limited(stream, "30 seconds", d).writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k in range(4):
            put(order[60 * k : 60 * (k + 1)], f"a{k}")
            q.processAllAvailable()
        put([(1.0, 900, 1), (700.0, 901, 9)], "late")  # one far behind the watermark, one that moves it on
        q.processAllAvailable()
        put([(900.0, 902, 9)], "on")
        q.processAllAvailable()
        put([(1200.0, 903, 8)], "idle")
        q.processAllAvailable()
        got = {r.event_id: r.admitted for r in spark.table("limited").collect()}
        state = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    finally:
        q.stop()
    batch = spark.createDataFrame([(u, e, float(t)) for t, e, u in rows], "user_id long, event_id long, t double")
    want = {r.event_id: r.admitted for r in caches.rate_limit(batch, d).collect()}
    assert {e: a for e, a in got.items() if e < 900} == want
    assert 900 not in got and got[901] is True
    assert sum(want.values()) < len(want) and max(state) > state[-1] + 5, state
