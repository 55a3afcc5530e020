"""Perceptual-hash matching of frames by Hamming distance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.hashing import hamming

BITS = 256


NARROWEST = 32  # bits of a band that hashes have to agree in, with or without turned bits
MOST_TURNED = 2


def _turned(width: int, n: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``n`` bits set."""
    return [sum(1 << b for b in bits) for k in range(n + 1) for bits in combinations(range(width), k)]


def near_hashes(frames: DataFrame, known: DataFrame, distance: int) -> DataFrame:
    """(frame_id, white_id, distance): every pair of hashes at most ``distance`` bits apart.

    Cut into distance + 1 bands, such hashes agree in one band at least, so an equi-join on (band, digits) finds all
    pairs. Where bands would be narrower than ``NARROWEST`` bits there are eight of that width, in one of which such hashes
    differ by an eighth of the distance at most: the known hashes are listed with so many bits turned in each band (33 values a
    band for one bit, 529 for two). Distances beyond 23 of 256 bits are half of all pairs' and compared whole.
    """
    bands = distance + 1
    if BITS // bands >= NARROWEST:
        digits, width = BITS // 4, BITS // 4 // bands
        cut = lambda h: F.array(*(F.struct(F.lit(b).alias("band"), F.substring(h, b * width + 1, width if b < bands - 1 else digits).alias("part")) for b in range(bands)))
        a, b = frames.select("*", F.inline(cut(F.col("phash")))), known.select("*", F.inline(cut(F.col("white_phash"))))
        pairs = a.join(b, ["band", "part"]).drop("band", "part")
    elif distance // (BITS // NARROWEST) <= MOST_TURNED:
        digits = NARROWEST // 4
        number = lambda h, b: F.conv(F.substring(h, b * digits + 1, digits), 16, 10).cast("long")
        cut = lambda h: F.array(*(F.struct(F.lit(b).alias("band"), number(h, b).alias("part")) for b in range(BITS // NARROWEST)))
        masks = F.array(*map(F.lit, _turned(NARROWEST, distance // (BITS // NARROWEST))))
        a, b = frames.select("*", F.inline(cut(F.col("phash")))), known.select("*", F.inline(cut(F.col("white_phash"))))
        b = b.select("*", F.explode(masks).alias("mask")).withColumn("part", F.col("part").bitwiseXOR(F.col("mask"))).drop("mask")
        pairs = a.join(b, ["band", "part"]).drop("band", "part")
    else:
        pairs = frames.crossJoin(known)
    rows = pairs.withColumn("distance", hamming(F.col("phash"), F.col("white_phash"))).where(F.col("distance") <= distance)
    return rows.select("frame_id", "white_id", "distance").distinct()


def whitelist_match(frames: DataFrame, known: DataFrame, distance: int = 5) -> DataFrame:
    """(frame_id, white_id, distance) of the nearest known hash, the smallest id if several are as near; null if none is near."""
    best = near_hashes(frames, known, distance).groupBy("frame_id").agg(F.min(F.struct("distance", "white_id")).alias("x"))
    return frames.select("frame_id").join(best, "frame_id", "left").select("frame_id", F.col("x.white_id").alias("white_id"), F.col("x.distance").alias("distance"))


def image_dedup(frames: DataFrame, known: DataFrame, distance: int = 3) -> DataFrame:
    """(frame_id, white_id, how): equal md5 first, else the nearest hash."""
    exact = frames.join(known, F.col("md5") == F.col("white_md5")).groupBy("frame_id").agg(F.min("white_id").alias("exact"))
    near = whitelist_match(frames, known, distance).select("frame_id", F.col("white_id").alias("near"))
    rows = near.join(exact, "frame_id", "left")
    return rows.select("frame_id", F.coalesce("exact", "near").alias("white_id"), F.when(F.col("exact").isNotNull(), "md5").when(F.col("near").isNotNull(), "phash").alias("how"))


def scan_stats(files: DataFrame) -> DataFrame:
    """One row of counts over (path, valid) of image files: scanned, unique, deduped, unclassified, invalid, valid, black, white.

    Paths that differ in case alone are one file, the first by path; files in no pool's folder are unclassified,
    whether or not they can be read. ``valid`` says whether a file could be decoded.
    """
    first = files.groupBy(F.lower("path").alias("key")).agg(F.min_by("valid", "path").alias("valid"), F.min("path").alias("path"), F.count("*").alias("n"))
    pool, good = image_pool(F.col("path")), F.coalesce("valid", F.lit(False))
    rows = first.select("n", pool.alias("pool"), good.alias("good"))
    known = F.col("pool").isNotNull()
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"),
        F.count("*").alias("unique"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("deduped"),
        F.count_if(~known).alias("unclassified"),
        F.count_if(known & ~F.col("good")).alias("invalid"),
        F.count_if(known & F.col("good")).alias("valid"),
        F.count_if((F.col("pool") == "black") & F.col("good")).alias("black"),
        F.count_if((F.col("pool") == "white") & F.col("good")).alias("white"),
    )


def collect_images(files: DataFrame) -> DataFrame:
    """(path, pool) of the images that are used, of (path, valid): of paths that differ in case alone the first, in a pool's folder, that can be decoded."""
    first = files.groupBy(F.lower("path").alias("key")).agg(F.min_by("valid", "path").alias("valid"), F.min("path").alias("path"))
    return first.select("path", image_pool(F.col("path")).alias("pool"), "valid").where("valid AND pool IS NOT NULL").select("path", "pool")


def image_pool(path):
    """black or white by the nearest folder whose name holds either (black first); null if none does."""
    folders = F.reverse(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1))
    named = F.filter(folders, lambda x: F.lower(x).rlike("black|white"))
    return F.when(F.size(named) > 0, F.when(F.lower(F.get(named, F.lit(0))).contains("black"), "black").otherwise("white"))
