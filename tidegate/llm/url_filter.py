"""URL filter: longest matching rule, else the posterior bound of an empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import checkpoint

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Suffixes of two labels below which names are registered; all others have one label. A parameter.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), AZ, az)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r":[0-9]*$", "")


def _address(host: Column) -> Column:
    """Whether a host is an IP address; such a host is its own domain, without a suffix."""
    return _bare(host).rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")


def suffix_of(host: Column, two: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    last = F.substring_index(_bare(host), ".", -2)
    return F.when(_address(host), "").when(last.isin(*two), last).otherwise(F.substring_index(_bare(host), ".", -1))


def domain_of(host: Column, two: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    last = F.substring_index(_bare(host), ".", -2)
    return F.when(_address(host), _bare(host)).when(last.isin(*two), F.substring_index(_bare(host), ".", -3)).otherwise(last)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Rules are a list in the code, not data."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return F.greatest(none, none, *fits) if fits else none


def _moments(groups: DataFrame, rate: Column) -> tuple[float, float]:
    """(overall rate, prior strength) of groups(n, bad) around expected rates, by the moments of a beta-binomial.

    Strength m = (1 - r) / r, where r is the correlation of outcomes within a group; kept within 5 and 1000.
    One row of sums reaches the driver.
    """
    s = groups.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - rate, 2) / (rate * (1 - rate))).alias("s"),
    ).first()
    if not s["n"]:
        return 0.5, 1000.0
    overall = (s["bad"] + 0.5) / (s["n"] + 1.0)
    free = s["n"] - s["nn"] / s["n"] - (s["k"] - 1)
    r = ((s["s"] or 0.0) - (s["k"] - 1)) / free if free > 0 else 0.0
    return overall, min(1000.0, max(5.0, (1 - r) / r)) if r > 0 else 1000.0


def reputations(outcomes: DataFrame, z: float, two: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """Posterior rates of bad outcomes: tables for hosts, registered domains and suffixes, and those above all."""
    hosts = checkpoint(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), two)).withColumn("suffix", suffix_of(F.col("host"), two))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total, _ = _moments(suffixes, F.lit(0.5))
    _, m0 = _moments(suffixes, F.lit(total))
    rate = lambda prior, m: (F.col("bad") + m * prior) / (F.col("n") + m)
    suffixes = suffixes.select("suffix", rate(F.lit(total), m0).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix", "left")
    _, m1 = _moments(domains, F.col("suffix_rate"))
    domains = domains.select("domain", "suffix", rate(F.col("suffix_rate"), m1).alias("domain_rate"))
    hosts = hosts.join(domains.select("domain", "domain_rate"), "domain", "left")
    _, m2 = _moments(hosts, F.col("domain_rate"))
    mean, size = rate(F.col("domain_rate"), m2), F.col("n") + m2
    hosts = hosts.select("host", mean.alias("host_rate"), (mean - z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("host_bound"))
    return hosts, domains.select("domain", "domain_rate"), suffixes, total, m2


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", limit: float = 0.5, z: float = 1.645, two: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, bad_rate, bound) of every page.

    ``outcomes`` is (url, bad) with bad 0 or 1; rows with a null in either count for nothing. A host's rate is
    shrunk towards its registered domain's, that towards its suffix's, and that towards the overall rate; the
    strengths are estimated at each level. A host is blocked if the lower bound of its rate (mean less ``z``
    posterior deviations) is over ``limit``; a host without outcomes has its domain's, suffix's or overall rate,
    with the spread of the prior. Where a rule fits, the longest decides. Null urls and those without ``://``
    have an empty host and path. Ports count for the host, not for its domain; IP addresses are domains of their own.
    Repeated rows are each judged; an empty table gives no rows. Other columns are not read.
    """
    seen = outcomes.where("url IS NOT NULL AND bad IS NOT NULL").select(host_of(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad"))
    hosts, domains, suffixes, total, m2 = reputations(seen, z, two)
    page = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    page = page.withColumn("domain", domain_of(F.col("host"), two)).withColumn("suffix", suffix_of(F.col("host"), two))
    # rates are joined to the distinct hosts; those with over a 2000th of all pages (2,000 at most) are broadcast, so
    # that a host with a third of them never meets in one task, and stand in no one's way in the other join
    names = checkpoint(page.groupBy("host", "domain", "suffix").agg(F.count("*").alias("pages")))
    rate = F.coalesce("host_rate", "domain_rate", "suffix_rate", F.lit(total))
    prior = rate - z * F.sqrt(rate * (1 - rate) / (m2 + 1))
    known = names.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    known = checkpoint(known.select(F.col("host").alias("h"), rate.alias("bad_rate"), F.coalesce("host_bound", prior).alias("bound"), "pages"))
    often = (known.agg(F.sum("pages")).first()[0] or 0) / 2000
    hot = known.where(F.col("pages") > often).select(F.col("h").alias("hot"), F.struct("bad_rate", "bound").alias("hot_rates"))
    rest = known.where(F.col("pages") <= often).select("h", F.struct("bad_rate", "bound").alias("rates"))
    page = page.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).join(F.broadcast(hot), F.col("host") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNull(), F.col("host")).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string")))
    out = page.join(rest, key == F.col("h"), "left").withColumn("r", F.coalesce("hot_rates", "rates"))
    method = F.when(F.col("r.bound") > limit, "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "r.bad_rate", "r.bound")
