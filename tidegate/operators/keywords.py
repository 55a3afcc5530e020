"""Lexicon operators: variants, multi-pattern scan, AND rules, regular-expression rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import patterns
from tidegate.functions import text as T
from tidegate.operators import pinyin

TEXTS_AT_ONCE, HITS_AT_ONCE = 500, 20_000  # rows that a scan holds beside its batch
SEPARATORS = ["@", "·", "・", "*"]
#: Of hits of one word and span the first of these stands: how a word is written goes before how it sounds.
KINDS = ["literal", "case", "fullwidth", "traditional", "simplified", "symbol", "pinyin_full", "pinyin_fuzzy", "pinyin_init"]
KIND_ORDER = {k: n for n, k in enumerate(KINDS)}


def generate_variants(words: DataFrame) -> DataFrame:
    """(category, word, variant, kind, ord): spellings of each word. Of equal spellings the first kind stands.

    Kinds in order: literal, case (upper, then lower), fullwidth (of the word, its upper and lower form),
    traditional, simplified, symbol (characters parted by each separator; words of one character have none).
    """
    w = F.col("word")
    forms = [("literal", w), ("case", F.upper(w)), ("case", F.lower(w)), ("fullwidth", T.to_wide(w)), ("fullwidth", T.to_wide(F.upper(w))), ("fullwidth", T.to_wide(F.lower(w)))]
    forms += [("traditional", F.translate(w, T.SIMPLIFIED, T.TRADITIONAL)), ("simplified", T.simplify(w))]
    forms += [("symbol", F.when(F.length(w) > 1, F.array_join(F.split(w, ""), s))) for s in SEPARATORS]
    cells = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("variant")) for k, v in forms))
    rows = words.select("category", "word", F.posexplode(cells).alias("ord", "x")).select("category", "word", "ord", "x.kind", "x.variant").where("variant IS NOT NULL AND variant <> ''")
    first = Window.partitionBy("category", "word", "variant").orderBy("ord")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def automaton_rows(words: DataFrame) -> DataFrame:
    """Variants of every word, and of every term of a word with plus signs (rule and term numbered).

    Blank and repeated (category, word) rows count once.
    """
    clean = words.select("category", F.trim("word").alias("line")).where("line <> ''").distinct()
    terms = clean.withColumn("terms", T.keyword_terms(F.col("line"))).where(F.size("terms") > 0)
    plain = generate_variants(terms.where(F.size("terms") == 1).select("category", F.col("terms")[0].alias("word")))
    plain = plain.select("category", "word", "variant", "kind", F.lit(None).cast("long").alias("rule"), F.col("word").alias("term"))
    rules = terms.where(F.size("terms") > 1).select(F.col("category").alias("rule_category"), "line", F.xxhash64("category", "line").alias("rule"), F.explode("terms").alias("word"))
    ruled = generate_variants(rules.select(F.col("rule").cast("string").alias("category"), "word").distinct())
    names = rules.select(F.col("rule").cast("string").alias("category"), "rule_category", "line").distinct()
    ruled = ruled.join(names, "category").select(F.col("rule_category").alias("category"), F.col("line").alias("word"), "variant", "kind", F.col("category").cast("long").alias("rule"), F.col("word").alias("term"))
    return plain.unionByName(ruled)


class Lexicon:
    """All variants in one automaton, with the sound variants in another; built in a worker from broadcast rows."""

    def __init__(self, rows: list[tuple], sounds: list[tuple], known: dict[str, str]):
        self.known = known
        self.direct, self.said = self._machine(rows), self._machine(sounds)

    @staticmethod
    def _machine(rows: list[tuple]):
        table: dict[str, list] = {}
        for variant, *own in rows:
            table.setdefault(variant, []).append(own)
        if not table:
            return None
        machine = ahocorasick.Automaton()
        for variant, own in table.items():
            machine.add_word(variant, (variant, own))
        machine.make_automaton()
        return machine

    def occurrences(self, text: str) -> Iterator[tuple]:
        """(word, category, kind, rule, term, terms, matched, start, end) of every occurrence, overlaps included.

        Terms of AND rules count where they stand in the text itself, not where Han characters only sound like them.
        """
        if self.direct is not None:
            for last, (variant, own) in self.direct.iter(text):
                for o in own:
                    yield *o, variant, last - len(variant) + 1, last + 1
        if self.said is None:
            return
        said, place = pinyin.expand(text, self.known)
        for heard, where in [(text, None)] + ([(said, place)] if said != text else []):
            for last, (variant, own) in self.said.iter(heard):
                start = last - len(variant) + 1
                for o in own:
                    if where is None:
                        yield *o, variant, start, last + 1
                    elif o[3] is None:
                        yield *o, variant, where[start], where[last] + 1

    def hits(self, text: str) -> list[tuple]:
        """(start, end, category, word, kind): one for each word and span, the first kind; AND rules whose terms are all there.

        A rule hit goes from the first start to the last end. One that names a term twice has fewer distinct terms than it names, and never fires.
        """
        found: dict[tuple, str] = {}
        rules: dict[tuple, list] = {}

        def put(key: tuple, kind: str) -> None:
            if key not in found or KIND_ORDER[kind] < KIND_ORDER[found[key]]:
                found[key] = kind

        for word, category, kind, rule, term, terms, _, start, end in self.occurrences(text):
            if rule is None:
                put((start, end, category, word), kind)
            else:
                r = rules.setdefault((rule, category, word), [set(), terms, start, end])
                r[0].add(term)
                r[2], r[3] = min(r[2], start), max(r[3], end)
        for (_, category, word), (own, terms, start, end) in rules.items():
            if len(own) == terms:
                put((start, end, category, word), "literal")
        return [(*key, kind) for key, kind in sorted(found.items())]


class Rules:
    """Rules of one action in order of id, found by what a text must hold for them to match; built in a worker.

    A row is (id, category, pattern, clauses): every clause has a string that the text holds (``patterns.required``). A rule
    is posted under the strings of one clause, that which the fewest texts hold by ``weights``, else the longest; only
    where one of them is found are its other clauses looked at, and only then the expression runs.
    """

    def __init__(self, rows: list[tuple], weights: dict[str, int] | None = None):
        self.rows, self.always, self.machine = rows, [], None
        self.compiled: dict[int, re.Pattern] = {}
        self.rest: list[list] = []
        posted: dict[str, list[int]] = {}
        for k, (*_, clauses) in enumerate(rows):
            order = sorted(clauses, key=lambda c: (sum((weights or {}).get(s, 0) for s in c), -min(map(len, c)), len(c)))
            self.rest.append(order[1:])
            for s in order[0] if order else ():
                posted.setdefault(s, []).append(k)
            if not order:
                self.always.append(k)
        if posted:
            self.machine = ahocorasick.Automaton()
            for n, s in enumerate(posted):
                self.machine.add_word(s, n)
            self.machine.make_automaton()
        self.posted = list(posted.values())

    def candidates(self, text: str) -> list[int]:
        """Places of the rules whose every clause the text meets, and of those without clauses."""
        if self.machine is None:
            return self.always
        folded = patterns.fold(text)
        found = {k for n in {n for _, n in self.machine.iter(folded)} for k in self.posted[n]}
        return sorted([*self.always, *(k for k in found if patterns.holds(folded, self.rest[k]))])

    def search(self, k: int, text: str) -> re.Match | None:
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.rows[k][2])
        return self.compiled[k].search(text)

    def first(self, around: str, category: str) -> int | None:
        """Id of the first rule for the category, or for all, that matches."""
        for k in self.candidates(around):
            if self.rows[k][1] in ("", None, category) and self.search(k, around):
                return self.rows[k][0]
        return None

    def matches(self, text: str) -> Iterator[tuple]:
        """(id, category, pattern, start, end) of the first match of each rule that matches."""
        for k in self.candidates(text):
            m = self.search(k, text)
            if m is not None:
                yield self.rows[k][0], self.rows[k][1] or "", self.rows[k][2], m.start(), m.end()


def rule_errors(rules: DataFrame) -> DataFrame:
    """(id, error): rules whose action isn't violate or exempt, or whose pattern isn't a Python regular expression."""
    action = F.concat(F.lit("action: "), F.coalesce("action", F.lit("none")))
    pattern = F.concat(F.lit("pattern: "), patterns.analysed("pattern")["error"])
    bad = F.when(~F.coalesce(F.col("action").isin("violate", "exempt"), F.lit(False)), action).otherwise(pattern)
    return rules.select("id", bad.alias("error")).where("error IS NOT NULL")


def active_rules(rules: DataFrame, *actions: str, most_chars: int = 64_000_000) -> list[list[tuple]]:
    """For each action the (id, category, pattern, clauses) of its active rules, in order of id.

    Rules are settings that people write; their expressions are read on the executors. More of them than a broadcast of
    ``most_chars`` holds, or any that ``rule_errors`` names, raise an error before a text is read.
    """
    known = F.coalesce(F.col("action").isin("violate", "exempt"), F.lit(False))
    own = rules.where("is_active").where(F.col("action").isin(*actions) | ~known)
    chars = own.agg(F.sum(F.length("pattern") + F.lit(64))).first()[0] or 0
    if chars > most_chars:
        raise ValueError(f"rules of {chars} characters, over {most_chars}")
    found = own.select("id", F.coalesce("category", F.lit("")).alias("category"), "pattern", "action", patterns.analysed("pattern").alias("x")).orderBy("id").collect()
    out: dict[str, list[tuple]] = {a: [] for a in actions}
    for r in found:
        if r["action"] not in out:
            raise ValueError(f"rule {r['id']}: action {r['action']!r}")
        if r["x"]["error"] is not None:
            raise ValueError(f"rule {r['id']}: {r['x']['error']}")
        out[r["action"]].append((r["id"], r["category"], r["pattern"], [frozenset(c) for c in r["x"]["clauses"]]))
    return [out[a] for a in actions]


def literal_weights(texts: DataFrame, rows: list[tuple], most: int = 1000) -> dict[str, int]:
    """In how many of some texts each string of rules with a choice of clauses stands; decides where rules are posted, not what they find."""
    wanted = sorted({s for *_, clauses in rows if len(clauses) > 1 for c in clauses for s in c})
    if not wanted:
        return {}
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for n, s in enumerate(shared.value):
            machine.add_word(s, n)
        machine.make_automaton()
        for pdf in batches:
            yield pd.DataFrame({"n": [n for t in pdf["text"] if t for n in {n for _, n in machine.iter(patterns.fold(t))}]}, dtype="int64")

    found = texts.select("text").limit(most).mapInPandas(run, "n long").groupBy("n").agg(F.count("*").alias("texts")).collect()
    return {wanted[r["n"]]: r["texts"] for r in found}


def lexicon_parts(variants: DataFrame, most_chars: int = 64_000_000) -> Iterator[list[tuple]]:
    """The variants as rows for automata, in parts of about so many characters, the bound on what is broadcast.

    All variants of a word, and all terms of an AND rule, come in one part.
    """
    rows = variants.select("variant", "word", "category", "kind", "rule", "term", F.size(T.keyword_terms(F.col("word"))).alias("terms"))
    chars = rows.agg(F.sum(F.length("variant") + F.length("word") + F.lit(32))).first()[0] or 0
    parts = max(1, -(-chars // most_chars))
    for k in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("category", "word"), F.lit(parts)) == k).collect()]


def sound_rows(rows: list[tuple], known: dict[str, str]) -> list[tuple]:
    """Sound variants of the words and terms among variant rows."""
    terms = {(word, category, rule, term, n) for _, word, category, _, rule, term, n in rows}
    return [(v, word, category, kind, rule, term, n) for word, category, rule, term, n in terms for v, kind in pinyin.variants(term or "", known)]


def _scanner(make, each, schema: str):
    """What ``_scan`` runs in a task. A batch holds as many texts as Spark likes; of them and of what is found only a piece is held as rows."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, out = make(), []
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                piece = batch.slice(at, TEXTS_AT_ONCE)
                for i, text in zip(piece["request_id"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    for row in each(made, i, text) if text else ():
                        out.append(row)
                        if len(out) >= HITS_AT_ONCE:
                            yield packed(out)
                            out = []
        if out:
            yield packed(out)

    return run


def _scan(texts: DataFrame, make, each, schema: str) -> DataFrame:
    """Rows that ``each(made, id, text)`` yields, one pass over (request_id, text); ``make`` builds what it needs once in a worker."""
    return texts.select("request_id", "text").mapInArrow(_scanner(make, each, schema), schema)


def keyword_scan(texts: DataFrame, variants: DataFrame, most_chars: int = 64_000_000) -> DataFrame:
    """(request_id, word, category, kind, rule, term, matched, start, end): every occurrence, overlaps included."""
    found = []
    for rows in lexicon_parts(variants, most_chars):
        shared = texts.sparkSession.sparkContext.broadcast(rows)
        each = lambda lexicon, i, text: ((i, *o[:5], *o[6:]) for o in lexicon.occurrences(text))
        found.append(_scan(texts, lambda shared=shared: Lexicon(shared.value, [], {}), each, "request_id long, word string, category string, kind string, rule long, term string, matched string, start int, end int"))
    return reduce(DataFrame.unionByName, found)


def and_hits(hits: DataFrame, variants: DataFrame) -> DataFrame:
    """One literal hit for each AND rule whose terms are all there, from the first start to the last end.

    A rule that names a term twice has fewer distinct terms than it names, and never fires.
    """
    named = F.size(T.keyword_terms(F.col("word")))
    own = hits.where("rule IS NOT NULL").groupBy("request_id", "rule", "word", "category").agg(F.countDistinct("term").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return own.where(F.col("n") == named).select("request_id", "word", "category", F.lit("literal").alias("kind"), "start", "end")


def _judges(texts: DataFrame, words: DataFrame, rules: DataFrame | None, known: dict[str, str] | None, most_chars: int) -> Iterator:
    """For each part of the lexicon what builds (lexicon, exempting rules, violating rules) in a worker; the latter come with the first part."""
    exempt, violate = active_rules(rules, "exempt", "violate") if rules is not None else ([], [])
    weights = literal_weights(texts, [*exempt, *violate])
    for part, rows in enumerate(lexicon_parts(automaton_rows(words), most_chars)):
        shared = texts.sparkSession.sparkContext.broadcast((rows, known or {}, exempt, violate if part == 0 else [], weights))

        def make(shared=shared):
            rows, known, exempt, violate, weights = shared.value
            return Lexicon(rows, sound_rows(rows, known) if known else [], known), Rules(exempt, weights), Rules(violate, weights)

        yield make


HIT = "category string, word string, kind string, start int, end int, rule_id long, violates boolean"


def _judged(made, text: str, window: int) -> Iterator[tuple]:
    """Rows of ``HIT`` of one text."""
    lexicon, exempt, violate = made
    for start, end, category, word, kind in lexicon.hits(text):
        around = text[max(0, start - window) : end + window]
        yield category, word, kind, start, end, exempt.first(around, category) if exempt.rows else None, False
    for rule, category, pattern, start, end in violate.matches(text):
        yield category, pattern, "literal", start, end, rule, True


def judged_hits(texts: DataFrame, words: DataFrame, rules: DataFrame | None = None, known: dict[str, str] | None = None, window: int = 8, most_chars: int = 64_000_000) -> DataFrame:
    """(request_id, category, word, kind, start, end, rule_id, violates): all that lexicon and rules find, in one pass over the texts.

    Hits of words and AND rules, one for each word and span; of several kinds the first stands (``KINDS``). With
    ``known`` readings, words are found by their sound too. ``rule_id`` is the first active exempting rule, of the
    hit's category or of all, that matches within ``window`` characters around it, or null. The first match of each
    active violating rule is a hit of its own, with its rule and ``violates`` true. A lexicon of over ``most_chars``
    is scanned in parts; texts are never shuffled.
    """
    each = lambda made, i, text: ((i, *hit) for hit in _judged(made, text, window))
    found = [_scan(texts, make, each, f"request_id long, {HIT}") for make in _judges(texts, words, rules, known, most_chars)]
    return reduce(DataFrame.unionByName, found)


def judged_texts(texts: DataFrame, words: DataFrame, rules: DataFrame | None = None, known: dict[str, str] | None = None, window: int = 8, most_chars: int = 64_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, *carry, hits, error): a row a text with what ``judged_hits`` finds in it, in order of place; the text itself stays behind.

    A text on which the scan breaks off has no hits and the error. ``carry`` names columns of text or whole type that
    pass through. Texts are read once for each part of the lexicon.
    """
    names = [c.split()[0] for c in HIT.split(", ")]
    kinds = dict(texts.dtypes)

    def run_with(make):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made = make()
            for pdf in (pdf.iloc[at : at + TEXTS_AT_ONCE] for pdf in batches for at in range(0, len(pdf), TEXTS_AT_ONCE)):
                hits, errors = [], []
                for text in pdf["text"]:
                    own, error = [], None
                    try:
                        own = sorted(_judged(made, text, window), key=lambda h: (h[3], h[4], h[0] or "", h[1], h[6])) if text else []
                    except Exception as broke:
                        error = f"{type(broke).__name__}: {broke}"
                    hits.append([dict(zip(names, h, strict=True)) for h in own])
                    errors.append(error)
                yield pdf.drop(columns="text").assign(hits=hits, error=errors)

        return run

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("request_id", *carry)]) + f", hits array<struct<{', '.join(f'`{n}`:' + c.split()[1] for n, c in zip(names, HIT.split(', '), strict=True))}>>, error string"
    parts = [texts.select("request_id", *carry, "text").mapInPandas(run_with(make), schema) for make in _judges(texts, words, rules, known, most_chars)]
    if len(parts) == 1:
        return parts[0]
    whole = reduce(DataFrame.unionByName, parts).groupBy("request_id", *carry).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.max("error").alias("error"))
    return whole.withColumn("hits", F.array_sort("hits", lambda a, b: F.when(_place(a) < _place(b), -1).when(_place(a) > _place(b), 1).otherwise(0)))


def _place(hit):
    return F.struct(hit["start"], hit["end"], F.coalesce(hit["category"], F.lit("")), hit["word"], hit["violates"])


def keyword_hits(texts: DataFrame, words: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """(request_id, category, word, kind, start, end): hits of words and AND rules, one for each word and span."""
    return judged_hits(texts, words, known=known).select("request_id", "category", "word", "kind", "start", "end")


def regex_exempt(texts: DataFrame, words: DataFrame, rules: DataFrame, known: dict[str, str] | None = None, window: int = 8) -> DataFrame:
    """Keyword hits with ``rule_id``, the first active exempting rule that matches around them, or null."""
    return judged_hits(texts, words, rules.where("action = 'exempt'"), known, window).drop("violates")


def rule_candidates(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, rule_id, pattern): rules that may match a text: those whose every clause it meets, and all without clauses."""
    exempt, violate = active_rules(rules.withColumn("is_active", F.lit(True)), "exempt", "violate")
    rows = sorted([*exempt, *violate])
    shared = texts.sparkSession.sparkContext.broadcast((rows, literal_weights(texts, rows)))
    each = lambda made, i, text: ((i, made.rows[k][0], made.rows[k][2]) for k in made.candidates(text))
    blank = texts.select("request_id", F.when(F.coalesce("text", F.lit("")) == "", " ").otherwise(F.col("text")).alias("text"))
    return _scan(blank, lambda: Rules(*shared.value), each, "request_id long, rule_id long, pattern string")


def regex_violate(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, rule_id, category, word, start, end): the first match of each active violating rule in each text.

    A rule is looked at only in texts that hold the rarest string it needs, and its expression runs only where they hold all
    it needs. Expressions are Python's; places count code points.
    """
    (rows,) = active_rules(rules.where("action IS DISTINCT FROM 'exempt'"), "violate")
    shared = texts.sparkSession.sparkContext.broadcast((rows, literal_weights(texts, rows)))
    each = lambda made, i, text: ((i, *m) for m in made.matches(text))
    return _scan(texts, lambda: Rules(*shared.value), each, "request_id long, rule_id long, category string, word string, start int, end int")


def phrase_index(rules: DataFrame) -> DataFrame:
    """(phrase, rule_ids): the rules that each of the strings they need points to."""
    rows = rules.select(F.col("id"), F.explode(patterns.literals(F.col("pattern"))).alias("phrase"))
    return rows.groupBy("phrase").agg(F.sort_array(F.collect_set("id")).alias("rule_ids"))


def rules_for_phrases(rules: DataFrame, phrases: DataFrame) -> DataFrame:
    """Other columns of (phrase, ...) with the rules that need one of a row's phrases, each once: (..., rule_id)."""
    rows = rules.select(F.col("id").alias("rule_id"), F.explode(patterns.literals(F.col("pattern"))).alias("phrase"))
    return phrases.join(rows, "phrase").drop("phrase").distinct()


def preprocess_keywords(items: DataFrame, spoken: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines as (category, word, match_type, line_no), the first of those that sound alike in a category.

    ``spoken`` (such as ``pinyin.spoken`` gives) maps a list of terms in their normal form to how they sound; without it
    that is the normal form. Blank lines and lines of plus signs alone are left out.
    """
    rows = items.withColumn("terms", T.keyword_terms(F.col("line"))).where(F.size("terms") > 0)
    normal = rows.withColumn("normal", F.transform("terms", T.normalize_keyword))
    keyed = normal.withColumn("key", F.array_join(spoken(F.col("normal")) if spoken else F.col("normal"), "+"))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("category", "key").orderBy("line_no"))).where("n = 1")
    return first.select("category", F.array_join("terms", "+").alias("word"), T.match_type(F.col("line")).alias("match_type"), "line_no")


def dedup_words(words: DataFrame) -> DataFrame:
    """(id, kept_id): each word and the smallest id of its category that reads the same without width and punctuation."""
    rows = words.select("id", "category", T.dedup_form(F.col("word")).alias("form"))
    first = rows.groupBy("category", "form").agg(F.min("id").alias("kept_id")).select(F.col("category").alias("c"), F.col("form").alias("f"), "kept_id")
    return rows.join(first, F.col("category").eqNullSafe(F.col("c")) & F.col("form").eqNullSafe(F.col("f")), "left").select("id", "kept_id")


def search(words: DataFrame, part: str | None = None, category: str | None = None) -> DataFrame:
    """Words of a category, or of all, that hold a part in any case."""
    rows = words if category is None else words.where(F.col("category") == category)
    return rows if not part else rows.where(F.contains(F.lower("word"), F.lit(part.lower())))


def rules_filter(rules: DataFrame, category: str | None = None, action: str | None = None, active: bool = True) -> DataFrame:
    """Rules of a category and an action, or of all; those that aren't active only if asked for."""
    for name, value in (("category", category), ("action", action)):
        rules = rules if value is None else rules.where(F.col(name) == value)
    return rules.where("is_active") if active else rules
