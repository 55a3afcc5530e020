"""Order-dependent state replayed over event tables: caches, rate limits, circuit breakers, failover.

Each replay streams a key's events in order: rows are dealt by key, sorted, and read batch by batch, so no key is
held in memory whole; only the state that the rule itself keeps is.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.config import DEFAULTS, Defaults


def replay(events: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], result: str) -> DataFrame:
    """Events with ``result``, what ``step(state, row)`` gives for each in order, from a fresh state for each key."""
    name, kind = result.split()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = object(), None
        for pdf in batches:
            out = []
            for k, row in zip(pdf[key], pdf[columns].itertuples(index=False), strict=True):
                k = None if pd.isna(k) else k  # rows without a key share one state
                if k != here:
                    here, state = k, start()
                out.append(step(state, tuple(row)))
            yield pdf.assign(**{name: out})

    schema = ", ".join([*(f"`{c}` {t}" for c, t in events.dtypes), f"{name} {kind}"])
    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limit(events: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """(user_id, t, event_id) with ``admitted``: fewer than the limit were admitted in the window before; rejects don't count."""

    def step(seen: deque, row: tuple) -> bool:
        t = row[0]
        while seen and t - seen[0] > d.rate_window_s:
            seen.popleft()
        if len(seen) >= d.rate_limit:
            return False
        seen.append(t)
        return True

    return replay(events, "user_id", ["t", "event_id"], ["t"], deque, step, "admitted boolean")


def cache_replay(events: DataFrame, capacity: int, ttl: float) -> DataFrame:
    """(cache, seq, t, op, key) with ``hit``: get and put on a cache that evicts the least recently used.

    An entry older than ``ttl`` is gone (never, if that is 0 or less); a get renews its place, not its age.
    """

    def step(held: OrderedDict, row: tuple) -> bool:
        t, op, key = row
        if op == "get":
            if key in held and (ttl <= 0 or t - held[key] <= ttl):
                held.move_to_end(key)
                return True
            held.pop(key, None)
            return False
        held[key] = t
        held.move_to_end(key)
        if len(held) > capacity:
            held.popitem(last=False)
        return False

    return replay(events, "cache", ["seq"], ["t", "op", "key"], OrderedDict, step, "hit boolean")


def cache_stats(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("cache").agg(F.count_if("hit").alias("hits"), F.count_if((F.col("op") == "get") & ~F.col("hit")).alias("misses"), F.count_if(F.col("op") == "put").alias("writes"))


def circuit_replay(calls: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """(provider, t, ok) with ``state``: open after so many failures in a row, until the cool-down is over.

    A success sets the count back; the first call after the cool-down is let through and decides anew.
    """

    def step(s: list, row: tuple) -> str:
        t, ok = row
        if s[1] is not None and t < s[1]:
            return "open"
        trial = s[1] is not None
        s[0] = 0 if ok else s[0] + 1
        s[1] = t + d.breaker_cooldown_s if not ok and (trial or s[0] >= d.breaker_failures) else None
        return "half_open" if trial else "closed"

    return replay(calls, "provider", ["t", *[c for c in calls.columns if c not in ("provider", "t")]], ["t", "ok"], lambda: [0, None], step, "state string")


def failover_first(calls: DataFrame) -> DataFrame:
    """(request_id, provider): the first that succeeded: the active one first, then by priority; null if all failed."""
    rank = F.struct((~F.col("active")).cast("int").alias("a"), "priority", "provider")
    return calls.groupBy("request_id").agg(F.min_by(F.when(F.col("ok"), F.col("provider")), F.when(F.col("ok"), rank)).alias("provider"))


def first_within(requests: DataFrame, ttl: float) -> DataFrame:
    """(key, t, event_id) with ``cached``: whether an answer of the same key, at most ``ttl`` old, was there."""

    def step(s: list, row: tuple) -> bool:
        if s and row[0] - s[0] <= ttl:
            return True
        s[:] = [row[0]]
        return False

    return replay(requests, "key", ["t", "event_id"], ["t"], list, step, "cached boolean")


def auth_join(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """Calls whose key is known and enabled, with its tier."""
    return calls.join(keys.where("enabled").select("key", "tier"), "key")


def provider_order(providers: DataFrame) -> DataFrame:
    return providers.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("active"), "priority", "provider")))


def resolve_keys(references: DataFrame, keys: DataFrame, longest: int = 1024) -> DataFrame:
    """(ref, key, n): a key equal to the reference, else the one that begins with it; null if none or several do; ``n`` keys begin with it.

    What a reference holds besides letters, digits, ``_`` and ``-`` is left out of the prefix; a reference without any
    finds no key but its equal. For each length that references have, at most ``longest``, keys are counted by their
    first letters within the tasks that read them; what meets the references is one row a prefix, so a prefix of a third of all
    keys costs no more than another.
    """
    bare = references.select("ref", F.regexp_replace("ref", r"[^A-Za-z0-9_-]", "").alias("prefix")).distinct()
    lengths = sorted(r["n"] for r in bare.where(F.length("prefix").between(1, longest)).select(F.length("prefix").alias("n")).distinct().collect())
    begins = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.substring("key", 1, n).alias("prefix")) for n in lengths)), lambda x: F.length(x["prefix"]) == x["n"]) if lengths else F.array().cast("array<struct<n:int,prefix:string>>")
    counted = keys.select("key", F.explode(F.transform(begins, lambda x: x["prefix"])).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"), F.max("key").alias("one"))
    equal = keys.select(F.col("key").alias("exact")).distinct()
    rows = bare.join(equal, F.col("ref") == F.col("exact"), "left").join(counted, "prefix", "left")
    return rows.select("ref", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
