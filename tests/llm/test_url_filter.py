import math

from pyspark.sql import functions as F

from tidegate.llm import url_filter as m

PAGES = "page_id long, url string, host string, bad int"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = {
    "https://WWW.Example.ORG/es/1?x#y": ("www.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://org/": ("org", "/", "org/", "allow"),
    "http://a.org": ("a.org", "", None, "allow"),
    "http://a.org?q=/x": ("a.org", "", None, "allow"),
    "ftp://a.com/fr/?://b.com/de/": ("a.com", "/fr/", "com/fr/", "allow"),
    "http://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
    "http://a.com:80/de/x": ("a.com:80", "/de/x", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://É.com/\n/x": ("É.com", "/\n/x", None, "allow"),
}


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "a", 1) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, PAGES)
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in m.judge(pages, spark.createDataFrame([], "url string, bad int"), RULES).collect()}
    assert got == {i: URLS[u] for i, u, *_ in rows}


def test_reputation_is_shrunk_and_blocks_by_its_bound(spark):
    outcomes = [(f"http://bad.spam.com/{k}", 1) for k in range(40)] + [(f"http://h{k % 30}.fine{k % 10}.com/", int(k % 25 == 0)) for k in range(300)]
    outcomes += [(f"http://one.spam.com/{k}", 1) for k in range(3)] + [("http://single.net/", 1), (None, 1), ("http://x.com/", None)]
    urls = ["http://bad.spam.com/q", "http://one.spam.com/q", "http://new.spam.com/q", "http://single.net/q", "http://h1.fine1.com/q", "http://unknown.xyz/q"]
    pages = spark.createDataFrame([(i, u, "a", 1) for i, u in enumerate(urls)] * 2, PAGES)
    rows = m.judge(pages, spark.createDataFrame(outcomes, "url string, bad int"), []).collect()
    assert len(rows) == 12
    got = {r.id: r for r in rows}
    assert got[0].verdict == "block" and got[0].bad_rate > 0.9
    assert got[0].bad_rate > got[1].bad_rate > got[4].bad_rate
    assert got[4].verdict == "allow" and got[4].bad_rate < 0.15
    assert got[3].verdict == "allow", "one bad page of an unknown domain is no proof"
    assert got[2].bad_rate > got[5].bad_rate
    assert all(r.bound < r.bad_rate for r in rows)


def test_a_host_equals_the_formula(spark):
    outcomes = [(f"http://h{k % 7}.d{k % 7 // 3}.com/", int(k * k % 5 < 2)) for k in range(200)]
    hosts, domains, suffixes, total, m2 = m.reputations(
        spark.createDataFrame(outcomes, "url string, bad int").select(m.host_of(F.col("url")).alias("host"), F.col("bad").cast("long")), 1.645, ()
    )
    rate = {r.domain: r.domain_rate for r in domains.collect()}
    for r in hosts.collect():
        own = [b for u, b in outcomes if u == f"http://{r.host}/"]
        mean = (sum(own) + m2 * rate[r.host.split(".", 1)[1]]) / (len(own) + m2)
        assert math.isclose(r.host_rate, mean)
        assert math.isclose(r.host_bound, mean - 1.645 * math.sqrt(mean * (1 - mean) / (len(own) + m2 + 1)))


def test_empty_and_very_long_urls(spark):
    long = "http://" + "a" * 100000 + ".com/fr/" + "b" * 100000
    none = spark.createDataFrame([], "url string, bad int")
    assert m.judge(spark.createDataFrame([], PAGES), none, RULES).count() == 0
    r = m.judge(spark.createDataFrame([(1, long, "a", 1), (None, long, "a", 1)], PAGES), none, RULES).collect()
    assert [x.rule for x in r] == ["com/fr/"] * 2


def test_ports_and_addresses(spark):
    hosts = ["a.b.com", "a.b.com:80", "10.0.0.1", "10.0.0.1:8080", "x.co.uk:443", "[::1]", "", "com"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.d, r.s) for r in df.select("host", m.domain_of(df["host"]).alias("d"), m.suffix_of(df["host"]).alias("s")).collect()}
    assert got == {"a.b.com": ("b.com", "com"), "a.b.com:80": ("b.com", "com"), "10.0.0.1": ("10.0.0.1", ""), "10.0.0.1:8080": ("10.0.0.1", ""), "x.co.uk:443": ("x.co.uk", "co.uk"), "[::1]": ("[::1]", ""), "": ("", ""), "com": ("com", "com")}
