"""64-bit FNV-1a, n-gram buckets and Hamming distance of hexadecimal hashes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the public FNV-1a definition.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _fnv(data: list[bytes]) -> np.ndarray:
    """All strings at once, a byte place at a time; 64-bit wrap-around.

    Strings stand end to end in order of length, so memory grows with their bytes and no long one makes the others wide.
    """
    size = np.array([len(d) for d in data], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    text = np.frombuffer(b"".join(data[k] for k in order), np.uint8)
    size = size[order]
    begin = np.cumsum(size) - size
    h = np.full(len(data), FNV_OFFSET, dtype=np.uint64)
    longer = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")  # how many strings have that place
    for j, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] ^ text[begin[:n] + j]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(StringType())
def fnv1a64(texts: pd.Series) -> pd.Series:
    """Sixteen hexadecimal digits; null for null."""
    h = _fnv([(t or "").encode() for t in texts])
    return pd.Series([None if t is None else f"{x:016x}" for t, x in zip(texts, h.tolist(), strict=True)], dtype=object)


def ngrams(token: Column, low: int = 3, high: int = 6, pad: str = "<", end: str = ">") -> Column:
    """The token as ``w:token`` and all character n-grams of the padded token."""
    padded = F.concat(F.lit(pad), token, F.lit(end))

    def of_length(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1)))
        return F.when(F.length(padded) >= n, F.transform(places, lambda i: F.substr(padded, i, F.lit(n)))).otherwise(F.array())

    return F.concat(F.array(F.concat(F.lit("w:"), token)), *map(of_length, range(low, high + 1)))


def buckets(grams: Column, n_buckets: int) -> Column:
    """The FNV bucket of each n-gram of an array."""

    @F.pandas_udf("array<int>")
    def run(lists: pd.Series) -> pd.Series:
        sizes = [0 if g is None else len(g) for g in lists]
        h = (_fnv([x.encode() for g in lists if g is not None for x in g]) % np.uint64(n_buckets)).astype(np.int32)
        parts = np.split(h, np.cumsum(sizes)[:-1]) if sizes else []
        return pd.Series([None if g is None else x.tolist() for g, x in zip(lists, parts, strict=True)], dtype=object)

    return run(grams)


def hamming(a: Column, b: Column, chunks: int = 4) -> Column:
    """Differing bits of two hexadecimal hashes of 16 digits a chunk."""
    word = lambda x, k: F.conv(F.substring(x, 16 * k + 1, 16), 16, -10).cast("long")
    return reduce(lambda x, y: x + y, [F.bit_count(word(a, k).bitwiseXOR(word(b, k))) for k in range(chunks)])
