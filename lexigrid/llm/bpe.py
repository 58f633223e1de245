"""Byte-level BPE: text to token ids and offsets, and back to bytes."""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.llm.common import add_columns, lists, table

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct slices whose merges a Python worker remembers before it starts anew.
CACHE_SLICES = 600_000
#: Bytes of text, and as many token ids, that a worker has in hand at once, unless one text is larger.
PIECE_BYTES = 1 << 19

# Classes of code points, and what they become once their neighbours are known.
LETTER, NUMBER, OTHER, SPACE, BLANK, END = range(6)
#: Symbols 3 to 9: apostrophes before a one- or two-letter ending; a space that is
#: the last white space before more text, or not; other white space likewise; the end of a text.
SHORT, LONG, LAST_SPACE, MORE_SPACE, LAST_BLANK, MORE_BLANK, STOP = range(3, 10)
# States of the scan: what the current slice is; FRESH: whatever comes starts one.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, TWO_LEFT, ONE_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts at the symbol."""
    if symbol == STOP:
        return FRESH, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if symbol in (SHORT, LONG) and state not in (IN_OTHERS, AFTER_SPACE):
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol in (LETTER, NUMBER):
        inside = (IN_LETTERS, IN_NUMBERS)[symbol]
        return inside, state not in (inside, AFTER_SPACE)
    if symbol in (OTHER, SHORT, LONG):
        return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE)
    if symbol == LAST_SPACE:
        return AFTER_SPACE, True
    if symbol == LAST_BLANK:
        return FRESH, True
    return IN_BLANKS, state != IN_BLANKS


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The scan's transition functions, closed under composition.

    Of each symbol its function; of two functions their composition; of each
    function its image of FRESH; of state and symbol whether a slice starts.
    """
    states, symbols = range(8), range(10)
    of_symbol = [tuple(_step(s, y)[0] for s in states) for y in symbols]
    functions = [tuple(states)]
    known = {functions[0]: 0}
    for f in functions:  # grows meanwhile
        for g in of_symbol:
            both = tuple(g[s] for s in f)
            if both not in known:
                known[both] = len(functions)
                functions.append(both)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], dtype=np.uint16)
    starts = np.array([[_step(s, y)[1] for y in symbols] for s in states])
    return np.array([known[f] for f in of_symbol], dtype=np.uint16), compose, np.array([f[FRESH] for f in functions], dtype=np.uint8), starts


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point; white space is the Unicode property of that name."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = BLANK
    out[0x20] = SPACE
    return out


def _symbols(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Symbols of texts that lie behind each other, each closed by a stop."""
    kinds = _classes()[points]
    kinds[stops] = END
    out = kinds.copy()
    following = np.concatenate((kinds[1:], [END])).astype(np.uint8)
    last = following < SPACE
    out[kinds == SPACE] = MORE_SPACE
    out[(kinds == SPACE) & last] = LAST_SPACE
    out[kinds == BLANK] = MORE_BLANK
    out[(kinds == BLANK) & last] = LAST_BLANK
    out[stops] = STOP
    marks = np.flatnonzero(points[:-2] == 0x27)
    one, two = points[marks + 1], points[marks + 2]
    pair = one << np.uint32(8) | two
    out[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    out[marks[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    return out


def slice_starts(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where the pre-tokenisation pattern's matches begin, stops included.

    points: code points of several texts, each followed by one closing code
    point whose place is in stops. A scan over transition functions: columns of
    a matrix are composed in step, then columns among each other, which gives
    every column's state at its start and, in a second sweep, at every place.
    """
    symbol, compose, image, starts = _monoid()
    symbols = _symbols(points, stops)
    n = len(symbols)
    depth = max(1, int(np.sqrt(n)))
    width = -(-n // depth)
    padded = np.full(depth * width, STOP, dtype=np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(width, depth).T)
    steps = symbol[grid]
    whole = steps[0].copy()
    for row in steps[1:]:
        whole = compose[whole, row]
    before = np.zeros(width, dtype=np.uint16)
    for i in range(1, width):
        before[i] = compose[before[i - 1], whole[i - 1]]
    found = np.empty((depth, width), dtype=bool)
    for i in range(depth):
        found[i] = starts[image[before], grid[i]]
        before = compose[before, steps[i]]
    return np.flatnonzero(found.T.ravel()[:n])


class Merges(dict):
    """Slice -> its token ids as 32-bit integers; a missing one is merged and kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_SLICES:
            self.clear()
        ids = self[piece] = array("i", self.merge(piece)).tobytes()
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Joins the adjacent pair of least rank, the leftmost first, until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 64:
            return self.merge_long(piece)
        rank, none = ranks.get, 1 << 30
        cuts = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [ranks[piece[a:b]] for a, b in pairwise(cuts)]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked parts, for very long slices."""
        import heapq

        ranks, n = self.ranks, len(piece)
        ends, after, ahead = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def pair(i: int) -> None:
            if i >= 0 and after[i] < n:
                j = after[i]
                if (rank := ranks.get(piece[i : ends[j]])) is not None:
                    heapq.heappush(heap, (rank, i, ends[i], ends[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            pair(i)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if not alive[i] or ends[i] != mid or after[i] >= n or ends[after[i]] != end:
                continue
            j = after[i]
            alive[j] = False
            ends[i], after[i] = end, after[j]
            if after[j] < n:
                ahead[after[j]] = i
            pair(i)
            pair(ahead[i])
        return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class Tokenizer:
    """Encodes and decodes many texts at once by a file of base64 tokens and their ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.cache = Merges(ranks)
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.sizes = np.array([len(t) for t in by_id], dtype=np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids; each id's end, in bytes of its text; the number of ids of each text."""
        points = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le"), dtype=np.uint32)
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))) - 1
        starts = slice_starts(points, stops)
        data = "".join([t + "\n" for t in texts]).encode()
        place = np.append(np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80), len(data))
        real = np.ones(len(points), dtype=bool)
        real[stops] = False
        bounds = place[np.append(starts, len(points))]
        real = real[starts]
        cuts = zip(bounds[:-1][real].tolist(), bounds[1:][real].tolist(), strict=True)
        merged = list(map(self.cache.__getitem__, [data[a:b] for a, b in cuts]))
        ids = np.frombuffer(b"".join(merged), dtype=np.int32)
        held = np.cumsum(np.concatenate(([0], np.fromiter(map(len, merged), dtype=np.int64, count=len(merged)) // 4)))
        upto = held[np.searchsorted(starts[real], stops)]
        counts = np.diff(np.concatenate(([0], upto)))
        ends = np.cumsum(self.sizes[ids])
        base = np.concatenate(([0], ends))[upto - counts]
        return ids, ends - np.repeat(base, counts), counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one behind the other."""
        sizes = self.sizes[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        return self.bytes[shift + np.arange(len(shift), dtype=np.int32)]

    def decode_rows(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """A binary Arrow column of rows that have ``counts`` ids each."""
        byte_ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))[np.concatenate(([0], np.cumsum(counts)))]
        buffers = [None, pa.py_buffer(byte_ends.astype(np.int32)), pa.py_buffer(self.decode(ids))]
        return pa.Array.from_buffers(pa.binary(), len(counts), buffers)


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids (array<int>) and ends (array<int>) of each whole text's tokens.

    path: a rank file that every executor has; it is a parameter, as tokenizers
    are never part of this library. ends[i] is where token i ends, in bytes of
    the text's UTF-8, so a run of tokens can be decoded or cut by itself. Null
    and empty texts have no tokens. Special tokens are ordinary text. Other
    columns stay; ones named ids or ends are replaced. Rows that repeat are
    encoded alike; an empty table gives an empty one.

    decoded: also adds decoded (binary), what the ids stand for, in the same
    pass. A worker has PIECE_BYTES of text in hand at once; a longer text is
    alone, and then its memory follows its length.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        tokenizer = _tokenizer(path)
        ids, ends, counts = tokenizer.encode([t or "" for t in texts.to_pylist()])
        out = [lists(ids, counts), lists(ends.astype(np.int32), counts)]
        return [*out, tokenizer.decode_rows(ids, counts)] if decoded else out

    return add_columns(docs, text, "ids array<int>, ends array<int>" + ", decoded binary" * decoded, compute, PIECE_BYTES)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """tokens with decoded (binary): the bytes that the ids stand for; null and empty ids give no bytes.

    Rows are taken together up to PIECE_BYTES ids. Other columns stay; one named
    decoded is replaced.
    """
    kept = [f for f in tokens.schema if f.name.lower() != "decoded"]
    width = len(kept)
    names = [f.name for f in kept] + ["decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum(pc.list_value_length(batch.column(width)).fill_null(0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                before = held[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(held, before + PIECE_BYTES, "right")))
                part = batch.column(width)[lo:hi]
                counts = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(i)[lo:hi] for i in range(width)] + [_tokenizer(path).decode_rows(flat, counts)], names)
                lo = hi

    columns = [tokens[f"`{f.name}`"] for f in kept] + [tokens[f"`{ids}`"].alias("__ids")]
    return tokens.select(*columns).mapInArrow(run, T.StructType([*kept, T.StructField("decoded", T.BinaryType())]))


def rank_file(spark: SparkSession) -> str:
    """Where the installed public rank file is, unless the session names another."""
    import public_tokenizers

    return spark.conf.get("lexigrid.bpe.ranks", None) or public_tokenizers.path(RANKS)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rank_file(spark)
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
