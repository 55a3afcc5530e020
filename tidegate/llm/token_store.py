"""Token ids in shard files, each a wavelet matrix: bit-planes with rank directories, compressed in chunks."""

from __future__ import annotations

import json
import os
import re
import struct
import tempfile
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"TGWM"
CHUNK = 1 << 16  # bytes of a plane that are compressed together
BLOCK = 1 << 12  # bits between two entries of a rank directory
SHARD = 1 << 20  # a shard ends with the document that brings it to so many ids
MOST_KNOWN, LONGEST_KNOWN = 600_000, 48  # words whose ids are remembered, and their length
AT_ONCE = 1 << 23  # characters of the texts that are encoded together
JOINED = 1000  # new words that are one text for the library
ODD_SPACE = re.compile(r" (?:\s|\Z)")
BEFORE_WORD = re.compile(r"(?= \S)")


class Remembered:
    """Values of twice ``most`` keys and those asked for at once: what wasn't asked for since it was last full is forgotten."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def find(self, keys: list[str]) -> tuple[list[bytes | None], list[int]]:
        """The values of keys, and the places of those that aren't known."""
        values = list(map(self.now.get, keys))
        if None not in values:
            return values, []
        gone, again = [], []
        for k in [k for k, x in enumerate(values) if x is None]:
            x = values[k] = self.before.get(keys[k])
            (gone if x is None else again).append(k)
        self.keep([keys[k] for k in again], [values[k] for k in again])
        return values, gone

    def keep(self, keys: list[str], values: list[bytes]) -> None:
        if len(self.now) >= self.most:
            self.now, self.before = {}, self.now
        self.now.update((k, x) for k, x in zip(keys, values, strict=True) if len(k) <= LONGEST_KNOWN)


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library, as 32-bit integers in bytes.

    A byte-level tokenizer never joins what stands before a space with the word after it, so texts are cut there, each word
    of several texts is looked up once, and the ids of words are remembered. New words are encoded as one text: a word's ids
    begin with the only one of them that has a space. Texts that hold the string of an added token are encoded whole, as all
    are if the tokenizer isn't of that kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in made.get("added_tokens") or ()]
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer") and not made["model"].get("dropout") and not any(" " in t for t in self.added)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[k for t, k in vocabulary.items() if t.startswith("\u0120")]] = True  # how a byte-level token spells a space
        self.words = Remembered(MOST_KNOWN)

    def plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def after_space(self, words: list[str]) -> list[bytes]:
        """Ids of different words with a space before each; a word holds no space and begins with no white space."""
        values, gone = self.words.find(words)
        for at in range(0, len(gone), JOINED):
            part = gone[at : at + JOINED]
            new = [words[k] for k in part]
            data = self.plain([" " + " ".join(new)])[0]
            begins = (4 * np.flatnonzero(self.spaced[np.frombuffer(data, "<u4")])).tolist()
            if len(begins) == len(new) and begins[0] == 0:
                found = [data[a:b] for a, b in zip(begins, [*begins[1:], len(data)], strict=True)]
            else:
                found = self.plain([" " + w for w in new])
            for k, x in zip(part, found, strict=True):
                values[k] = x
            self.words.keep(new, found)
        return values

    def ids(self, text: str | None) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        out, kinds = [b""] * len(texts), ([], [], [])
        for k, text in enumerate(texts):
            if text:
                whole = not self.by_word or any(t in text for t in self.added)
                kinds[0 if whole else 1 if ODD_SPACE.search(text) else 2].append(k)
        for at, encode in zip(kinds, (self._whole, self._odd, self._even), strict=True):
            for k, x in zip(at, encode([texts[k] for k in at]), strict=True):
                out[k] = x
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self.plain([t])[0] for t in texts]

    def _odd(self, texts: list[str]) -> list[bytes]:
        """Of texts with spaces that no word follows."""
        pieces = [[p for p in BEFORE_WORD.split(t) if p] for t in texts]
        other = {p for own in pieces for p in own}
        words = [p for p in other if p[0] == " " and " " not in p[1:] and not p[1:2].isspace() and len(p) > 1]
        other = list(other.difference(words))
        ids = dict(zip(other, self.plain(other), strict=True)) | dict(zip(words, self.after_space([w[1:] for w in words]), strict=True))
        return [b"".join([ids[p] for p in own]) for own in pieces]

    def _even(self, texts: list[str]) -> list[bytes]:
        """Of texts in which a word follows each space."""
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = np.asarray(cut.offsets)[:-1]
        words = cut.flatten().dictionary_encode()
        which = np.array(words.indices)
        firsts = [t.split(" ", 1)[0] for t in texts]
        alone = dict.fromkeys(firsts)  # no space stands before the first word
        known = words.dictionary.to_pylist()
        which[first] = np.array([*map({w: len(known) + k for k, w in enumerate(alone)}.get, firsts)], dtype=which.dtype)
        used = np.zeros(len(known) + len(alone), bool)
        used[which] = True  # a word that is only ever first isn't asked for
        asked = np.flatnonzero(used[: len(known)]).tolist()
        values = [b""] * len(known)
        for k, x in zip(asked, self.after_space([known[k] for k in asked]), strict=True):
            values[k] = x
        values += self.plain(list(alone))
        size = np.array([len(x) // 4 for x in values], dtype=np.int64)
        begin, own = np.cumsum(size) - size, size[which]
        end = np.cumsum(own)
        ids = np.frombuffer(b"".join(values), "<u4")[np.repeat(begin[which] - end + own, own) + np.arange(int(end[-1]))]
        cuts = [*(end[first] - own[first]).tolist(), len(ids)]
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a worker: tasks that run in it one after the other share what it remembers."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _packed(data: bytes) -> bytes:
    """Compressed, unless the beginning shows that it doesn't pay: the lower planes of common ids are as good as noise."""
    some = data[:4096]
    return zlib.compress(data, 1 if len(zlib.compress(some, 1)) < 0.9 * len(some) else 0)


def build_shard(docs: list[tuple[int | None, int]], ids: np.ndarray, part: int, place: int, start: int) -> bytes:
    """A shard file: header, (doc_id, number of ids) of its documents, and the planes of its ids from the highest bit.

    The plane of a bit holds that bit of every id in the plane's order; the next plane has those with a 0 first, then
    those with a 1, each in the order they had. ``zeros`` counts the former. Beside a plane lies how many ones stand before
    each ``BLOCK`` bits. ``start`` counts the ids of the partition before this shard.
    """
    levels = max(1, int(ids.max(initial=0)).bit_length())
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    planes, body = [], []
    for level in range(levels):
        ones = (now >> np.asarray(levels - 1 - level, now.dtype) & np.asarray(1, now.dtype)).astype(bool)
        bits = np.packbits(ones, bitorder="little")
        filled = np.zeros(-(-max(1, len(ones)) // BLOCK) * BLOCK, dtype=bool)
        filled[: len(ones)] = ones
        per = np.count_nonzero(filled.reshape(-1, BLOCK), axis=1)
        ranks = _packed((np.cumsum(per) - per).astype("<u4").tobytes())
        chunks = [_packed(bits[at : at + CHUNK].tobytes()) for at in range(0, max(1, len(bits)), CHUNK)]
        planes.append({"zeros": int(len(ones) - per.sum()), "ranks": len(ranks), "chunks": [len(c) for c in chunks]})
        body += [ranks, *chunks]
        now = np.concatenate((now[~ones], now[ones]))
    held = np.array([i is not None for i, _ in docs], dtype="u1")
    names = _packed(held.tobytes() + np.array([i or 0 for i, _ in docs], dtype="<i8").tobytes() + np.array([n for _, n in docs], dtype="<u8").tobytes())
    header = json.dumps({"levels": levels, "ids": len(ids), "docs": len(docs), "part": part, "place": place, "start": start, "names": len(names), "planes": planes}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + names + b"".join(body)


class Shard:
    """A shard file's content. Chunks are unpacked as they are asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        size = struct.unpack("<I", data[4:8])[0]
        self.header = json.loads(data[8 : 8 + size])
        self.levels, self.n = self.header["levels"], self.header["ids"]
        at, docs = 8 + size, self.header["docs"]
        names = zlib.decompress(data[at : at + self.header["names"]])
        at += self.header["names"]
        held = np.frombuffer(names[:docs], "u1")
        self.doc_ids = [int(i) if h else None for h, i in zip(held, np.frombuffer(names[docs : 9 * docs], "<i8"), strict=True)]
        self.sizes = np.frombuffer(names[9 * docs :], "<u8").astype(np.int64)
        self.zeros, self.places, self._ranks, self._chunks = [], [], {}, {}
        for p in self.header["planes"]:
            self.zeros.append(p["zeros"])
            ends = np.cumsum([at, p["ranks"], *p["chunks"]]).tolist()
            self.places.append(list(zip(ends[:-1], ends[1:], strict=True)))
            at = ends[-1]
        self.data = data

    def _ranks_of(self, level: int) -> np.ndarray:
        if level not in self._ranks:
            a, b = self.places[level][0]
            self._ranks[level] = np.frombuffer(zlib.decompress(self.data[a:b]), "<u4")
        return self._ranks[level]

    def _chunk(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._chunks:
            a, b = self.places[level][1 + k]
            self._chunks[level, k] = np.frombuffer(zlib.decompress(self.data[a:b]), "u1")
        return self._chunks[level, k]

    def _plane(self, level: int) -> np.ndarray:
        bits = np.concatenate([self._chunk(level, k) for k in range(len(self.places[level]) - 1)])
        return np.unpackbits(bits, count=self.n, bitorder="little").astype(bool)

    def _bits(self, level: int, begin: int, end: int) -> np.ndarray:
        """Bits of one block of a plane, ``begin`` a multiple of ``BLOCK``."""
        k = begin // 8 // CHUNK
        got = self._chunk(level, k)[begin // 8 - k * CHUNK :][: BLOCK // 8]
        return np.unpackbits(got, bitorder="little")[: end - begin]

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i <= 0:
            return 0
        if i >= self.n:
            return self.n - self.zeros[level]
        block = i // BLOCK
        return int(self._ranks_of(level)[block]) + int(self._bits(level, block * BLOCK, i).sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th bit of that kind, k from 0."""
        ranks = self._ranks_of(level).astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        begin = block * BLOCK
        bits = self._bits(level, begin, min(self.n, begin + BLOCK))
        return begin + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            block = i // BLOCK * BLOCK
            bit = int(self._bits(level, block, i + 1)[-1])
            ones = self.ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where those of the first i places that hold the id lie below the last plane."""
        if token < 0 or token >> self.levels:
            return 0, 0
        a, b = 0, min(max(0, i), self.n)
        for level in range(self.levels):
            x, y = self.ones(level, a), self.ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if token >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often an id stands among the first i places."""
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of an id, k from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] * bit)
        return i

    def all_ids(self) -> np.ndarray:
        """Every id in order: the planes are undone from the last to the first."""
        now = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            ones, z = self._plane(level), self.zeros[level]
            out = np.empty_like(now)
            out[~ones] = now[:z]
            out[ones] = now[z:] | np.asarray(1 << (self.levels - 1 - level), now.dtype)
            now = out
        return now

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the partition, ids)."""
        ids, at = self.all_ids(), 0
        for i, n in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            yield i, self.header["start"] + at, ids[at : at + n]
            at += n


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused folder in the shared one that the session names; on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="tidegate-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else re.sub(r"^file:/*", "/", folder))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> None:
    """Encode every whole text, append ``end_id``, and write the ids as shard files in ascending order of id.

    Documents are dealt by ranges of id (null ids first, repeated ids by a hash of their texts), each task encodes its range
    and closes a shard with the document that brings it to ``shard`` ids, so a shard of a very long document is longer and
    no document is cut. Null and empty texts are the end id alone. A file is written aside and moved to a name that depends on
    its range and place alone, so a task that is run again leaves the same files. ``folder`` must be new, on a file system
    that pyarrow opens (local, HDFS, S3, GCS); ``folder``/manifest lists (part, place, name, ids, docs, bytes). An empty
    table gives an empty manifest and no shard. Other columns of the table don't matter, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("from")]
    # rows of one id and text are dealt by where they were read, so that no repeated row makes a range of its own size
    rows = rows.withColumn("from", F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    where, path = _open(folder)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (files, base) = encoder(tokenizer), _open(folder)
        task = TaskContext.get()
        part, last = task.partitionId(), b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        held, data, size, place, start = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            name = f"{part:07d}-{place:07d}.tgwm"
            content = build_shard(held, ids, part, place, start)
            aside = f"{base}/{name}.{task.taskAttemptId()}.aside"
            with files.open_output_stream(aside) as out:
                out.write(content)
            files.move(aside, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"part": [part], "place": [place], "name": [name], "ids": [len(ids)], "docs": [len(held)], "bytes": [len(content)]})

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            """(id, ids) of documents in their order, some at once."""
            names, texts, n = [], [], 0
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    names.append(i)
                    texts.append(text)
                    n += len(text or "")
                    if n >= AT_ONCE:
                        yield from zip(names, known.ids_of(texts), strict=True)
                        names, texts, n = [], [], 0
            yield from zip(names, known.ids_of(texts), strict=True)

        for i, own in encoded():
            own += last
            held.append((i, len(own) // 4))
            data.append(own)
            size += len(own) // 4
            if size >= shard:
                yield close()
                start, place = start + size, place + 1
                held, data, size = [], [], 0
        if held:
            yield close()

    rows.mapInArrow(run, "part long, place long, name string, ids long, docs long, bytes long").write.parquet(os.path.join(folder, "manifest"))


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the shards that the manifest lists."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tgwm").load(folder)
    listed = spark.read.parquet(os.path.join(folder, "manifest")).select("name")
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content").join(listed, "name", "left_semi")


def _none(spark: SparkSession, folder: str) -> bool:
    return spark.read.parquet(os.path.join(folder, "manifest")).isEmpty()


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, before): ids of all ranges before each; one row a range of the table is all that meets here."""
    per = spark.read.parquet(os.path.join(folder, "manifest")).groupBy("part").agg(F.sum("ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return per.select("part", F.coalesce(before, F.lit(0)).alias("before"))


def read_documents(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, with ``ids`` its ids as well.

    ``start`` counts the ids of all documents before it; ids_crc32 is over the ids as little-endian 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    if _none(spark, folder):
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                rows = [(i, at, len(x), zlib.crc32(x.astype("<u4").tobytes()), x.astype(np.int32) if ids else None) for i, at, x in shard.documents()]
                cols = list(zip(*rows, strict=True))
                out = {"part": pa.array([shard.header["part"]] * len(rows), pa.int64())}
                out |= {n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "at", "n_tokens", "ids_crc32"), cols, strict=False)}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(list(cols[4]), pa.list_(pa.int32()))} if ids else {}))

    read = _shards(spark, folder).select("content").mapInArrow(run, "part long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
    rows = read.join(_starts(spark, folder), "part")
    return rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def count_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the ids stands in all files, by rank alone; only planes' ends are looked at."""
    if _none(spark, folder):
        return spark.createDataFrame([(t, 0) for t in dict.fromkeys(tokens)], "token long, n long")
    wanted = list(dict.fromkeys(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                yield pa.RecordBatch.from_pydict({"token": pa.array(wanted, pa.int64()), "n": pa.array([shard.count(t) for t in wanted], pa.int64())})

    return _shards(spark, folder).select("content").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of an id, ``place`` from 0 within its document; found by select, the rest isn't decoded."""
    schema = "doc_id long, place long"
    if _none(spark, folder):
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                at = np.array([shard.select(token, k) for k in range(shard.count(token))], dtype=np.int64)
                ends = np.cumsum(shard.sizes)
                doc = np.searchsorted(ends, at, "right")
                place = at - (ends - shard.sizes)[doc] if len(at) else at
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([shard.doc_ids[d] for d in doc], pa.int64()), "place": pa.array(place, pa.int64())})

    return _shards(spark, folder).select("content").mapInArrow(run, schema)
