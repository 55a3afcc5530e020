"""Licence scan: winnowed fingerprints of templates pick candidates, a banded alignment reports coverage and spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import WORD, align, gram_codes
from tidegate.llm.license_templates import TEMPLATES

HITS = "array<struct<license:string,coverage:double,matched_words:int,start_char:int,end_char:int>>"


def winnow(grams: np.ndarray, window: int) -> list[int]:
    """Places of the selected fingerprints: the least of every ``window`` in a row, the rightmost if tied."""
    if not len(grams):
        return []
    w = min(window, len(grams))
    return sorted({k + w - 1 - int(grams[k : k + w][::-1].argmin()) for k in range(len(grams) - w + 1)})


def diagonals(starts: list[int], band: int) -> list[tuple[int, int]]:
    """(first, last) of the starts that seeds imply, in groups no wider than ``band``: an alignment stays banded however many seeds there are."""
    out: list[list[int]] = []
    for s in sorted(set(starts)):
        if out and s - out[-1][0] <= band:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [(a, b) for a, b in out]


class TemplateIndex:
    """Inverted index from a template's winnowed word n-grams to (template, place)."""

    def __init__(self, templates: list[tuple[str, str]], n: int = 3, window: int = 2):
        self.n, self.vocabulary, self.templates = n, {}, []
        places: dict[int, list[tuple[int, int]]] = {}
        for name, text in templates:
            words = WORD.findall(text.lower())
            if len(words) < n:
                raise ValueError(f"a template needs at least {n} words: {name}")
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint64)
            grams = gram_codes(codes, n)
            for p in winnow(grams, window):
                places.setdefault(int(grams[p]), []).append((len(self.templates), p))
            self.templates.append((name, codes))
        self.keys = np.array(sorted(places), dtype=np.uint64)
        self.places = [places[k] for k in sorted(places)]

    def words_of(self, text: str) -> tuple[np.ndarray, list | None]:
        """(codes of a text's words, their spans in the text if they had to be found).

        Where lowering changes a text's length, words are parted first and lowered then.
        """
        get, lower = self.vocabulary.get, text.lower()
        if len(lower) == len(text):
            return np.array([get(w, 0) for w in WORD.findall(lower)], dtype=np.uint64), None
        found = list(WORD.finditer(text))
        return np.array([get(m[0].lower(), 0) for m in found], dtype=np.uint64), [m.span() for m in found]

    def scan(self, text: str | None, least: float) -> list[dict]:
        """The stretches of the text that match at least ``least`` of a template, in order of place."""
        text = text or ""
        codes, spans = self.words_of(text)
        if len(codes) < self.n:
            return []
        at = np.nonzero(np.convolve(codes > 0, np.ones(self.n, dtype=np.int32), "valid") == self.n)[0]
        if not len(at):
            return []
        grams = gram_codes(codes, self.n)[at]
        k = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        starts: dict[int, list[int]] = {}
        for pos, i in zip(at[self.keys[k] == grams].tolist(), k[self.keys[k] == grams].tolist(), strict=True):
            for t, p in self.places[i]:
                starts.setdefault(t, []).append(pos - p)
        if not starts:
            return []
        spans = spans or [m.span() for m in WORD.finditer(text)]
        out = []
        for t, begun in starts.items():
            name, words = self.templates[t]
            band = max(3, len(words) // 5)
            for first, last in diagonals(begun, band):
                reach = band + (last - first)
                lo, hi = max(0, first - band), min(len(codes), last + len(words) + band)
                if lo >= hi:
                    continue
                _, matches, _, _, a, b = align(words, codes[lo:hi], (first + last) // 2 - lo, reach)
                if matches >= least * max(len(words), b - a):
                    out.append({"license": name, "coverage": matches / max(len(words), b - a), "matched_words": matches, "start_char": spans[lo + a][0], "end_char": spans[lo + b - 1][1]})
        kept: list[dict] = []
        for x in sorted(out, key=lambda x: (-x["matched_words"], -x["coverage"], x["start_char"], x["license"])):
            if all(x["end_char"] <= y["start_char"] or y["end_char"] <= x["start_char"] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x["start_char"])


def licenses(text: Column, templates: list[tuple[str, str]] = TEMPLATES, n: int = 3, window: int = 2, least: float = 0.5) -> Column:
    """The licence wordings that a text holds: name, coverage (matched words in order as a share of the longer of template and span), span.

    Every aligned wording of at least the low coverage ``least`` is reported, cut and edited ones too; what counts as
    the licence is for the reader of the coverage to say. ``start_char`` and ``end_char`` are code points of the text.
    A wording of fewer than ``n + window - 1`` words may be missed if it is edited. Null and empty texts hold none; of
    wordings that overlap, the one with the most matched words is reported. The index is as large as the templates,
    which are a fixed list, and travels with the function; texts never move, other columns are not read.
    """
    index = TemplateIndex(templates, n, window)

    @F.pandas_udf(HITS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([index.scan(t, least) for t in texts])

    return scan(text)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id, license, coverage, matched_words, start_char, end_char): a row for each wording found.

    Rows that repeat an id each report theirs; a null id is kept. An empty table gives no rows. Columns of ``docs``
    of any name do not meet these.
    """
    return docs.select(F.col(id_col).alias("id"), F.explode(licenses(F.col(text_col), **more)).alias("x")).select("id", "x.*")
