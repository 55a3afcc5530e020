"""Lexicon matching by sound: pinyin, initials and near sounds, from a table of readings that the caller gives."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

HAN = re.compile(r"[一-鿿]+")
#: Whole syllables that are taken for each other.
NEAR = {"an": "ang", "ang": "an", "en": "eng", "eng": "en"}
MOST_READINGS = 100_000


def readings(table: DataFrame) -> dict[str, str]:
    """Character to syllable, from (char, syllable); one reading each, and no more than there are Han characters."""
    rows = table.groupBy("char").agg(F.min("syllable").alias("syllable")).limit(MOST_READINGS + 1).collect()
    if len(rows) > MOST_READINGS:
        raise ValueError(f"more than {MOST_READINGS} readings")
    return {r["char"]: r["syllable"] for r in rows}


def syllables(word: str, known: dict[str, str]) -> list[str]:
    """A character's reading, itself if it has none."""
    return [known.get(c, c) for c in word]


def spoken(known: dict[str, str]):
    """A function of a column of lists of words: how each sounds, its syllables joined by apostrophes, in lower case."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda words: None if words is None else ["'".join(syllables(w, known)).lower() for w in words])

    return run


def variants(word: str, known: dict[str, str]) -> list[tuple[str, str]]:
    """(variant, kind) of a word of two Han characters or more: full, near in one syllable, and initials of three or more."""
    n = sum(len(x) for x in HAN.findall(word))
    if n < 2:
        return []
    said = syllables(word, known)
    out = [("".join(said), "pinyin_full"), ("'".join(said), "pinyin_full")]
    out += [("'".join([*said[:k], NEAR[s], *said[k + 1 :]]), "pinyin_fuzzy") for k, s in enumerate(said) if s in NEAR]
    if n >= 3:
        first = [s[0] for s in said]
        out += [("".join(first), "pinyin_init"), ("'".join(first), "pinyin_init")]
    return list({v: k for v, k in reversed(out)}.items())[::-1]


def expand(text: str, known: dict[str, str]) -> tuple[str, list[int]]:
    """The text with its Han runs as syllables joined by apostrophes, and the place in the text of each character."""
    out, place, at = [], [], 0
    for m in [*HAN.finditer(text), None]:
        rest = text[at : m.start() if m else len(text)]
        out.append(rest)
        place += range(at, at + len(rest))
        if m:
            for k, s in enumerate(syllables(m[0], known)):
                part = s if k == 0 else "'" + s
                out.append(part)
                place += [m.start() + k] * len(part)
            at = m.end()
    return "".join(out), place
