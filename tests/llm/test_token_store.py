import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidegate.llm import token_store as m

PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part long, ids string, name string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def brute(rows, plain, end=2):
    at, out = 0, []
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain(t), end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def stored(spark, rows, tmp_path, **more):
    folder = f"file://{tmp_path}/x"
    m.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, PATH, **more)
    return folder


TEXTS = [
    "plain words, don't  they?", " a", "a ", "  two  \n spaces\t\there \n\n x", "x\n <|endoftext|> y", "<|endoftext|>", "　wide gap \x1c odd \x85 y", "café \U0001f600 " + "赌博" * 50, " ", "\n", "'s 't 're I'll", "1 22 333-4444",
    "a​b   c", "x" * 3000, "\t tab", "end \n", "no\r\n  yes", "퟿  ￿",
]


def test_words_give_the_ids_of_the_whole_text(plain):
    e = m.Encoder(PATH)
    assert e.by_word
    rng = np.random.default_rng(3)
    odd = ["".join(rng.choice(list("ab'1 \n\t é\x1c  .<"), size=30)) for _ in range(600)]
    for t in [*TEXTS, *odd, *TEXTS]:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == plain(t), repr(t)
    assert e.ids(None) == e.ids("") == b""


def test_texts_encoded_together_have_the_ids_of_each(plain, monkeypatch):
    """New words of all texts are joined and each encoded once, whatever is remembered or forgotten between them."""
    monkeypatch.setattr(m, "JOINED", 7)
    rng = np.random.default_rng(5)
    odd = ["".join(rng.choice(list("ab'1 \n\t\u00e9\x1c .<\u0120"), size=30)) for _ in range(900)]
    texts = [None, "", *TEXTS, *odd, *(" ".join(rng.choice(["these", "don't", "x.\nY", "\u0120b", "it's!", "\u8d4c\u535a", "#" * 60], 20)) for _ in range(50)), *TEXTS]
    want = [plain(t) for t in texts]
    for most in (600_000, 5):
        monkeypatch.setattr(m, "MOST_KNOWN", most)
        e = m.Encoder(PATH)
        asked = []
        inner = e.plain
        e.plain = lambda of: asked.extend(of) or inner(of)  # noqa: B023
        got = [np.frombuffer(x, "<u4").tolist() for x in e.ids_of(texts)]
        assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
        assert sum(t.count(" these") for t in asked) <= 2, "a word of many texts is encoded once"
        for k in range(0, len(texts), 10):
            assert [np.frombuffer(x, "<u4").tolist() for x in e.ids_of(texts[k : k + 10])] == want[k : k + 10]


def test_other_tokenizers_are_given_whole_texts():
    e = m.Encoder(P.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert not e.by_word
    assert np.frombuffer(e.ids("Two  Words here"), "<u4").tolist() == t.encode("Two  Words here", add_special_tokens=False).ids


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (9, 2), (5000, 3), (70_000, 50_256), (20_000, 200_000)])
def test_shard_round_trip_access_rank_select(n, top, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 1 << 10)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.001, n) if n > 5000 else rng.integers(0, top, n), top - 1).astype("<u4")
    s = m.Shard(m.build_shard([(7, n // 2), (None, n - n // 2)], ids, 1, 2, 3))
    assert s.all_ids().tolist() == ids.tolist()
    assert s.doc_ids == [7, None] and s.sizes.tolist() == [n // 2, n - n // 2]
    for i in rng.integers(0, n, 60) if n else []:
        assert s.access(int(i)) == ids[i]
        t = int(ids[i])
        assert s.rank(t, int(i)) == int((ids[:i] == t).sum())
        places = np.flatnonzero(ids == t)
        assert s.count(t) == len(places)
        k = int(rng.integers(len(places)))
        assert s.select(t, k) == places[k]
    absent = int(ids.max(initial=0)) + 1
    assert s.count(absent) == s.count(-1) == s.count(1 << 40) == 0
    with pytest.raises(IndexError):
        s.select(absent, 0)
    with pytest.raises(IndexError):
        s.access(n)


def test_whole_table_equals_brute_force(spark, plain, tmp_path):
    rows = [(r.doc_id, r.text, 1, "i", "n") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    folder = stored(spark, rows, tmp_path, shard=20_000)
    got = sorted(tuple(r) for r in m.read_documents(spark, folder).collect())
    assert got == brute(rows, plain)
    assert spark.read.parquet(f"{folder}/manifest").count() > 5
    whole = {i: [*plain(t), 2] for i, t, *_ in rows}
    assert {r.doc_id: list(r.ids) for r in m.read_documents(spark, folder, ids=True).collect()} == whole
    word = plain(" the")[0]
    counts = {r.token: r.n for r in m.count_tokens(spark, folder, [word, 2, 50_000_000]).collect()}
    assert counts == {word: sum(x.count(word) for x in whole.values()), 2: sum(x.count(2) for x in whole.values()), 50_000_000: 0}
    assert {tuple(r) for r in m.find_token(spark, folder, word).collect()} == {(i, k) for i, x in whole.items() for k, t in enumerate(x) if t == word}


def test_nulls_empty_long_repeats_and_clashing_names(spark, plain, tmp_path):
    rows = [(k, t, 1, "i", "n") for k, t in enumerate(TEXTS[:-1])]
    rows += [(None, "no id", 1, "i", "n"), (50, None, 1, "i", "n"), (51, "", 1, "i", "n"), (52, "word " * 60_000, 1, "i", "n"), (-5, "below", 1, "i", "n"), (2**60 + 1, "large", 1, "i", "n")]
    rows += [(60, "repeated row", 1, "i", "n")] * 40
    folder = stored(spark, rows, tmp_path, shard=1000)
    key = lambda r: (r[1], r[2])
    assert sorted((tuple(r) for r in m.read_documents(spark, folder).collect()), key=key) == sorted(brute(rows, plain), key=key)
    assert any(r.doc_id is None for r in m.read_documents(spark, folder).collect())


def test_an_empty_table_and_other_ends(spark, plain, tmp_path):
    folder = stored(spark, [], tmp_path)
    assert m.read_documents(spark, folder).collect() == []
    assert [tuple(r) for r in m.count_tokens(spark, folder, [2]).collect()] == [(2, 0)]
    assert m.find_token(spark, folder, 2).collect() == []
    other = stored(spark, [(1, "a b", 0, "", ""), (2, None, 0, "", "")], tmp_path / "y", end_id=None)
    assert [(r.doc_id, r.n_tokens) for r in m.read_documents(spark, other).orderBy("doc_id").collect()] == [(1, len(plain("a b"))), (2, 0)]
