"""Token-ID output: files of directly addressable codes, written and read by Spark.

A file holds the ids of whole documents, one behind the other, in segments.
The ids of a segment are split into chunks of eight bits: level 0 has the lowest
chunk of every id, each next level the next chunk of those ids that have one. A
bitmap beside each level says which ids continue, and a directory gives the
number of continuing ids before each block of the bitmap. So any id is read by
following its place from level to level, without decoding those before it.

    file      magic, segments, index (JSON), its length in 8 bytes, magic
    segment   document keys (8 bytes each), 1 byte each for a null key,
              ends of documents (8 bytes each); then for each level: chunks
              (1 byte each), bitmap (1 bit each, filled up to whole blocks),
              directory (8 bytes a block)

``manifest.json`` lists the files in order; what it does not list is no part of
the table. All numbers are little-endian.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lexigrid.llm.common import pieces, shared_folder, table

MAGIC = b"DACTOK01"
CHUNK_BITS, BLOCK = 8, 512
#: Tokens of a segment, which ends with the document that fills it; bytes of text sorted into one file.
SEGMENT_TOKENS, FILE_BYTES = 1 << 20, 32 << 20
#: Bytes of text that Spark hands to Python at once, and of those encoded together.
BATCH_BYTES, PIECE_BYTES = 8 << 20, 4 << 20
#: Words whose ids a task remembers, and the longest of them.
REMEMBERED, LONGEST = 3 << 18, 64
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


# the code


def split_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level of unsigned ids."""
    rest, out = ids.astype(np.uint64), []
    while not out or len(rest):
        more = rest >> np.uint64(CHUNK_BITS) > 0
        bits = np.zeros(-(-max(len(rest), 1) // BLOCK) * BLOCK, dtype=bool)
        bits[: len(rest)] = more
        counts = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        out.append(((rest & np.uint64(255)).astype(np.uint8), np.packbits(bits, bitorder="little"), np.cumsum(counts, dtype=np.uint64) - counts))
        rest = rest[more] >> np.uint64(CHUNK_BITS)
    return out


class Levels:
    """Ids of one segment by their places; ``fetch`` gives (bytes of) a part of the file.

    places: (chunks, bitmap, directory, ids) of each level, the first three as offsets.
    """

    def __init__(self, places: list[tuple[int, int, int, int]], fetch: Callable[[int, int], bytes]):
        self.places, self.fetch = places, fetch

    def _bits(self, level: int, block: int) -> tuple[int, np.ndarray]:
        """The rank before a block of the bitmap, and its bits."""
        _, bitmap, directory, _ = self.places[level]
        rank = int.from_bytes(self.fetch(directory + 8 * block, 8), "little")
        return rank, np.unpackbits(np.frombuffer(self.fetch(bitmap + block * BLOCK // 8, BLOCK // 8), np.uint8), bitorder="little")

    def rank(self, level: int, at: int) -> int:
        """How many of the level's ids before ``at`` continue."""
        if at >= self.places[level][3]:
            return self.places[level + 1][3] if level + 1 < len(self.places) else 0
        before, bits = self._bits(level, at // BLOCK)
        return before + int(bits[: at % BLOCK].sum())

    def one(self, at: int) -> int:
        """The id at a place: for each of its levels a chunk, a block of the bitmap and an entry of the directory are read."""
        value = 0
        for level, (chunks, _, _, _) in enumerate(self.places):
            value |= self.fetch(chunks + at, 1)[0] << (CHUNK_BITS * level)
            before, bits = self._bits(level, at // BLOCK)
            if not bits[at % BLOCK]:
                return value
            at = before + int(bits[: at % BLOCK].sum())
        raise ValueError("the last level continues")

    def some(self, begin: int, end: int) -> np.ndarray:
        """The ids of a range of places, reading only what belongs to them."""
        spans = [(begin, end)]
        while len(spans) < len(self.places) and spans[-1][0] < spans[-1][1]:
            spans.append(tuple(self.rank(len(spans) - 1, x) for x in spans[-1]))
        values = np.zeros(0, dtype=np.uint32)
        for level in range(len(spans) - 1, -1, -1):
            a, b = spans[level]
            chunks, bitmap, _, _ = self.places[level]
            here = np.frombuffer(self.fetch(chunks + a, b - a), np.uint8).astype(np.uint32)
            if len(values):
                first = a // 8
                bits = np.unpackbits(np.frombuffer(self.fetch(bitmap + first, -(-b // 8) - first), np.uint8), bitorder="little")[a - 8 * first : b - 8 * first]
                here[bits.astype(bool)] |= values << np.uint32(CHUNK_BITS)
            values = here
        return values


# files


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a path or URI."""
    return fs.FileSystem.from_uri(path)


class FileBuilder:
    """Writes one file; holds a segment, that is SEGMENT_TOKENS and the document that fills it."""

    def __init__(self, sink: pa.NativeFile, segment_tokens: int = SEGMENT_TOKENS):
        self.sink, self.least = sink, segment_tokens
        self.at, self.tokens, self.docs = len(MAGIC), 0, 0
        self.segments: list[dict] = []
        self.keys: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.held = 0
        sink.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.least:
            self.flush()

    def _write(self, data: np.ndarray) -> int:
        begin = self.at
        raw = data.tobytes()
        self.sink.write(raw)
        self.at += len(raw)
        return begin

    def flush(self) -> None:
        if not self.keys:
            return
        ends = np.cumsum([len(p) for p in self.parts]).astype("<i8")
        missing = np.array([k is None for k in self.keys], dtype=np.uint8)
        keys = np.array([k or 0 for k in self.keys], dtype="<i8")
        segment = {"token": self.tokens, "tokens": self.held, "doc": self.docs, "docs": len(keys), "keys": self._write(keys), "nulls": self._write(missing), "ends": self._write(ends)}
        segment["levels"] = [[self._write(c), self._write(b), self._write(d.astype("<u8")), len(c)] for c, b, d in split_levels(np.concatenate(self.parts))]
        self.segments.append(segment)
        self.tokens, self.docs = self.tokens + self.held, self.docs + len(keys)
        self.keys, self.parts, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        index = json.dumps(self.segments).encode()
        self.sink.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.sink.close()


class TokenFile:
    """One file, opened for reading; only the index is read at once."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        length = int.from_bytes(tail[:8], "little")
        self.segments = json.loads(self.file.read_at(length, size - 16 - length))
        self.firsts = [s["token"] for s in self.segments]

    def _fetch(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def levels(self, segment: dict) -> Levels:
        return Levels([tuple(x) for x in segment["levels"]], self._fetch)

    def token(self, at: int) -> int:
        """The id at a place in the file."""
        segment = self.segments[bisect.bisect_right(self.firsts, at) - 1]
        return self.levels(segment).one(at - segment["token"])

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each segment: keys, which of them are null, ends of the documents within it, ids."""
        for s in self.segments:
            keys = np.frombuffer(self._fetch(s["keys"], 8 * s["docs"]), "<i8")
            nulls = np.frombuffer(self._fetch(s["nulls"], s["docs"]), np.uint8).astype(bool)
            ends = np.frombuffer(self._fetch(s["ends"], 8 * s["docs"]), "<i8")
            yield keys, nulls, ends, self.levels(s).some(0, s["tokens"])


def read_manifest(place: str) -> list[dict]:
    """The files of a table in order: name, first token and number of tokens, number of documents."""
    system, path = _place(place)
    with system.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


# the data source


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str | None
    docs: int
    tokens: int
    first: int | None
    last: int | None


@dataclass
class FilePart(InputPartition):
    name: str
    token: int


class TokenWriter(DataSourceArrowWriter):
    """A file for each task's rows; the manifest lists those of the attempts that were committed.

    Rows are (key, ids) or, where a tokenizer is named, (key, text): then one
    Python worker encodes and writes, and ids do not pass through Spark.
    """

    def __init__(self, place: str, segment_tokens: int, tokenizer: str | None = None, end_id: int | None = None):
        self.place, self.segment_tokens = place, segment_tokens
        self.tokenizer, self.end_id = tokenizer, end_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _place(self.place)
        part = TaskContext.get().partitionId()
        name, builder, first, last, docs, tokens = f"part-{part:06d}-{uuid4().hex}.dac", None, None, None, 0, 0
        for batch in encoded(iterator, self.tokenizer, self.end_id) if self.tokenizer else iterator:
            if builder is None and batch.num_rows:
                system.create_dir(path, recursive=True)
                builder = FileBuilder(system.open_output_stream(f"{path}/{name}"), self.segment_tokens)
                first = batch.column(0)[0].as_py()
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(raw.as_buffer() or b"", "<u4")
                builder.add(key, ids)
                last, docs, tokens = key, docs + 1, tokens + len(ids)
        if builder is None:
            return Written(part, None, 0, 0, None, None)
        builder.close()
        return Written(part, name, docs, tokens, first, last)

    def commit(self, messages: list[Written | None]) -> None:
        """Puts the files in order and writes the manifest, which makes them a table."""
        files = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part)
        order = lambda key: (key is None, key or 0)
        if any(order(a.last) > order(b.first) for a, b in zip(files, files[1:], strict=False)):
            self.abort(messages)
            raise ValueError("the rows to write are not in ascending order of their keys")
        listed, token = [], 0
        for m in files:
            listed.append({"name": m.name, "token": token, "tokens": m.tokens, "docs": m.docs})
            token += m.tokens
        system, path = _place(self.place)
        system.create_dir(path, recursive=True)
        draft = f"{path}/manifest-{uuid4().hex}.tmp"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps(listed).encode())
        system.move(draft, f"{path}/manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _place(self.place)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{path}/{m.name}")


class TokenReader(DataSourceReader):
    """A task for each file, a segment at a time."""

    def __init__(self, place: str):
        self.place = place

    def partitions(self) -> list[FilePart]:
        return [FilePart(f["name"], f["token"]) for f in read_manifest(self.place)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, FilePart):  # a table without files
            return
        system, path = _place(self.place)
        token = partition.token
        for keys, nulls, ends, ids in TokenFile(system, f"{path}/{partition.name}").documents():
            starts = np.concatenate(([0], ends[:-1]))
            offsets = pa.py_buffer((np.append(0, ends) * 4).astype(np.int32))
            raw = pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(ids.astype("<u4"))])
            yield pa.record_batch([pa.array(keys, mask=nulls), pa.array(token + starts), pa.array(ends - starts), raw], ["doc_id", "start", "n_tokens", "ids"])
            token += int(ends[-1])


class TokenTable(DataSource):
    """``spark.read.format("dac_tokens").load(place)``: (doc_id, start, n_tokens, ids), ids as unsigned 32-bit integers.

    Written are (key, ids); with the option ``tokenizer``, a file, (key, text),
    and the id of the option ``endid``, if there is one, behind each text.
    """

    @classmethod
    def name(cls) -> str:
        return "dac_tokens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> TokenReader:
        return TokenReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> TokenWriter:
        end = self.options.get("endid")
        return TokenWriter(self.options["path"], int(self.options.get("segmenttokens", SEGMENT_TOKENS)), self.options.get("tokenizer"), None if end is None else int(end))


# encoding


#: Stands between words that are encoded together; a word with it is encoded alone.
MARK = "\x01"


class WordCoder:
    """Ids of words by the tokenizers library, remembered.

    The tokenizer drops white space and begins a piece at a mark that follows a
    letter or digit, so texts may be parted at both without a change of their ids.
    """

    def __init__(self, file: str, end_id: int | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.end = [] if end_id is None else [end_id.to_bytes(4, "little")]
        self.mark = self._library([MARK])[0]
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """The words' ids from one text, in which the mark's id, which nothing else has, parts them."""
        ids = self._library([f" {MARK} ".join(words)])[0]
        cuts = np.flatnonzero(ids == self.mark[0]).tolist() if len(self.mark) == 1 else []
        if len(cuts) != len(words) - 1:
            return [x.tobytes() for x in self._library(words)]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; short ones are remembered."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        missing = [w for w in words if w not in self.known]
        short = [w for w in missing if len(w) <= LONGEST and MARK not in w]
        for a in range(0, len(short), 4096):
            some = short[a : a + 4096]
            self.known.update(zip(some, self._together(some), strict=True))
        if len(short) == len(missing):
            return [self.known[w] for w in words]
        others = [w for w in missing if len(w) > LONGEST or MARK in w]
        passing = {w: self._library([w])[0].tobytes() for w in others}
        return [self.known[w] if w in self.known else passing[w] for w in words]

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, followed by the end id if there is one, as unsigned 32-bit integers."""
        parted = pc.replace_substring_regex(texts.fill_null(""), r"([A-Za-z0-9])([.,;:!?])", r"\1 \2")
        words = pc.ascii_split_whitespace(parted)
        coded = words.flatten().dictionary_encode()
        spelt = self._ids(coded.dictionary.to_pylist()) + self.end
        bounds = words.offsets.to_numpy()
        ends, order = bounds[1:] - bounds[0], coded.indices.to_numpy()
        if self.end:
            order, ends = np.insert(order, ends, len(spelt) - 1), ends + np.arange(1, len(ends) + 1)
        ids = pa.array(spelt, pa.binary()).take(pa.array(order))
        places = np.frombuffer(ids.buffers()[1], np.int32)[np.append(0, ends)]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places), ids.buffers()[2]])


@lru_cache(maxsize=2)
def _coder(file: str, end_id: int | None) -> WordCoder:
    return WordCoder(file, end_id)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int | None, budget: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) for batches of (key, text), in pieces of ``budget`` bytes of text."""
    coder = _coder(tokenizer, end_id)
    for batch in batches:
        for a, b in pieces(batch.column(1), budget):
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], coder.encode(batch.column(1)[a:b])], ["doc_id", "ids"])


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs meanwhile hands rows to Python in batches of about ``size`` bytes, a longer row alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def tokenizer_file(spark: SparkSession) -> str:
    """The tokenizer's place on every machine: ``lexigrid.tokens.tokenizer``, else the public one."""
    named = spark.conf.get("lexigrid.tokens.tokenizer", None)
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 1, budget: int = PIECE_BYTES) -> DataFrame:
    """(key, ids) of each row of docs, in its order: ids as unsigned 32-bit integers, null texts as empty ones, ``end_id`` behind each.

    tokenizer: the file of one that drops white space and begins a piece at a
    mark; texts are cut there, and the library encodes words it did not meet
    before, in pieces of ``budget`` bytes.
    Special tokens are found in texts as the library finds them, none is added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, tokenizer, end_id, budget)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id bigint, ids binary")


def write_tokens(docs: DataFrame, place: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 1, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of every row of docs to a new table of token files, in ascending order of the keys.

    Keys are whole numbers; null keys come last, rows with equal keys in the
    order of a hash of their texts. Texts are sorted by ranges of keys, some
    ``file_bytes`` in each; rows with one key may be of several ranges. The
    task that writes a file also encodes its texts. Null and empty texts have
    the end id alone; an empty table gives a manifest without files; other
    columns are not read.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenTable)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("row")]
    ranged = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(max(1, -(-size // file_bytes)), *order)
    options = {"tokenizer": tokenizer} | ({} if end_id is None else {"endid": end_id})
    with small_batches(spark):
        ranged.sortWithinPartitions(*order).select("doc_id", "text").write.format("dac_tokens").options(**options).mode("append").save(place)


def read_tokens(spark: SparkSession, place: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a table of token files: start is the number of ids of all documents before."""
    spark.dataSource.register(TokenTable)
    return spark.read.format("dac_tokens").load(place)


def tokens_at(positions: DataFrame, place: str, position: str = "position") -> DataFrame:
    """(position, id) for each row of positions: the id at a place counted over all documents; null where there is none.

    No shuffle; a batch's positions are taken file by file, and for each some
    hundred bytes are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _place(place)
        files = [f for f in read_manifest(place) if f["tokens"]]
        firsts = [f["token"] for f in files]
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            found: list[int | None] = [None] * len(wanted)
            number, opened = -1, None
            for i in sorted((i for i, p in enumerate(wanted) if p is not None), key=lambda i: wanted[i]):
                at = bisect.bisect_right(firsts, wanted[i]) - 1
                if at < 0 or wanted[i] >= firsts[at] + files[at]["tokens"]:
                    continue
                if at != number:
                    number, opened = at, TokenFile(system, f"{path}/{files[at]['name']}")
                found[i] = opened.token(wanted[i] - firsts[at])
            yield pa.record_batch([pa.array(wanted, pa.int64()), pa.array(found, pa.int64())], ["position", "id"])

    return positions.select(F.col(position).cast("bigint")).mapInArrow(run, "position bigint, id bigint")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), place, tokenizer_file(spark))
    return read_tokens(spark, place).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
