"""LM scoring: smoothed word n-grams as a weighted backoff automaton.

No process ever holds the whole model. Texts are taken in blocks; a block sends
its distinct n-grams to where all blocks' are counted, gets the counts back,
and is scored by the part of the automaton that its own n-grams reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.llm.common import crc_remainder, pieces, table
from lexigrid.llm.textbytes import WordTable, mix

ORDER = 3
#: Weight of the shorter history's estimate, in occurrences.
CONCENTRATION = 64.0
#: Bytes of text in a block, unless one text is larger, and bytes of n-grams that are counted together.
BLOCK_BYTES, COUNTED_BYTES = 8 << 20, 16 << 20
END, START = mix(np.array([1, 2], dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hash_bits(size: int) -> int:
    """Bits of an n-gram's hash for a corpus of so many bytes, whole bytes of them.

    Two n-grams share a hash by chance in less than one of 2**16 cases; 64 bits
    keep to that up to 2**48 bytes.
    """
    return min(64, 8 * -(-(max(size, 1).bit_length() + 16) // 8))


def _words(texts: pa.Array | pa.ChunkedArray) -> WordTable:
    return WordTable([(t or b"").lower() for t in texts.cast(pa.binary()).to_pylist()])


def count_words(texts: DataFrame, text: str = "t") -> DataFrame:
    """(h, n): of each word its 64-bit hash and count; hash 0 stands for the end of a text.

    Each piece of a batch is counted before it leaves Python, so what is
    shuffled are distinct words of pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(0), BLOCK_BYTES):
                found, n = np.unique(_words(batch.column(0)[a:b]).hashes(1), return_counts=True)
                yield pa.record_batch([pa.array(np.append(found, np.uint64(0)).view(np.int64)), pa.array(np.append(n, b - a))], ["h", "n"])

    return texts.select(text).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


class Block:
    """The n-grams of some texts, each text with START before and END behind it.

    For each order from 1 on: hashes of ``bits`` bits, sorted and distinct; at, a place where each
    occurs; number, for each place which n-gram ends there, -1 if its text has
    not so many words yet. Places of all texts lie behind each other.
    """

    def __init__(self, words: WordTable, order: int, bits: int = 64):
        shift = np.uint64(64 - bits)
        self.start = START >> shift
        self.sizes = np.diff(words.first)
        self.ends = np.cumsum(self.sizes + 2) - 1
        tokens = np.full(int((self.sizes + 2).sum()), END, dtype=np.uint64)
        inner = np.ones(len(tokens), dtype=bool)
        inner[self.ends] = inner[self.ends - self.sizes - 1] = False
        tokens[self.ends - self.sizes - 1] = START
        tokens[inner] = words.hashes(1)
        since = np.arange(len(tokens)) - np.repeat(self.ends - self.sizes - 1, self.sizes + 2)
        self.hashes, self.at, self.number = [], [], []
        codes = tokens
        for k in range(order):
            if k:
                codes = np.concatenate((codes[:1], mix(codes[:-1] * _STEP + tokens[1:])))
            places = np.flatnonzero(since >= k)
            found, first, inverse = np.unique(codes[places] >> shift, return_index=True, return_inverse=True)
            number = np.full(len(tokens), -1, dtype=np.int32)
            number[places] = inverse
            self.hashes.append(found)
            self.at.append(places[first])
            self.number.append(number)

    def counts(self, training: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram occurs in the block's training texts."""
        weight = np.repeat(training, self.sizes + 2)
        return [np.bincount(n[n >= 0], weights=weight[n >= 0], minlength=len(h)).astype(np.uint64) for n, h in zip(self.number, self.hashes, strict=True)]


@dataclass
class Automaton:
    """The states and arcs that a block's n-grams can reach; state 0 is the empty history.

    An arc is a state and a word of the block in one number; arcs are sorted by
    it and have a log10 weight and a state to go to. Where a state has no arc
    for a word, its failure arc leads, at a weight, to the state of the history
    without its first word; the empty state has an arc for every word.
    """

    arcs: np.ndarray
    weights: np.ndarray
    targets: np.ndarray
    failure: np.ndarray
    penalty: np.ndarray
    start: int
    words: int
    order: int

    def traverse(self, ids: np.ndarray, sizes: np.ndarray, stretch: int = 128) -> np.ndarray:
        """Log10 probabilities of texts, given as word numbers behind each other.

        One pass from left to right over all texts in step, each with its state
        and its sum. Long texts are walked as stretches side by side: a state is
        fixed by the last order - 1 words, so a stretch first reads those before
        it, at no weight, and then is where the whole walk would be.
        """
        if not len(ids):
            return np.zeros(len(sizes))
        parts = -(-sizes // stretch)
        text = np.repeat(np.arange(len(sizes)), parts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        warm = np.where(place > 0, self.order - 1, 0)
        begin = (np.cumsum(sizes) - sizes)[text] + place * stretch - warm
        lengths = np.minimum(stretch, sizes[text] - place * stretch) + warm
        order = np.argsort(-lengths, kind="stable")
        begin, lengths, warm = begin[order], lengths[order], warm[order]
        state = np.where(place[order] > 0, 0, self.start)
        total = np.zeros(len(order))
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        for step, n in enumerate(alive.tolist()):
            word = ids[begin[:n] + step]
            now = state[:n].copy()
            counts = (step >= warm[:n]).astype(np.float64)
            pending = np.arange(n)
            while len(pending):
                wanted = now[pending] * self.words + word[pending]
                at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
                hit = self.arcs[at] == wanted
                done = pending[hit]
                total[done] += self.weights[at[hit]] * counts[done]
                state[done] = self.targets[at[hit]]
                pending = pending[~hit]
                total[pending] += self.penalty[now[pending]] * counts[pending]
                now[pending] = self.failure[now[pending]]
        return np.bincount(text[order], weights=total, minlength=len(sizes))


def build(block: Block, counts: list[np.ndarray], denominator: float, concentration: float) -> Automaton:
    """The automaton for a block, given how often each of its n-grams occurs in all training texts.

    p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), with h' the history without
    its first word and m the concentration; without a history
    (c(w) + 1) / denominator, so an unseen word has the one share that is left
    for it. An n-gram that was not seen costs its history's failure arc
    m / (c(h) + m), which is the same number.
    """
    c = [n.astype(np.float64) for n in counts]
    width = len(block.hashes[0])
    p = (c[0] + 1) / denominator
    states = [np.zeros(1, dtype=np.int64)]  # of each order's n-grams, as histories
    failure, penalty = [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
    total = 1
    for k in range(len(c) - 1):
        some = c[k] > 0
        states.append(np.where(some, total + np.cumsum(some) - 1, 0))
        total += int(some.sum())
        failure.append(states[k][block.number[k - 1][block.at[k][some]]] if k else np.zeros(int(some.sum()), dtype=np.int64))
        penalty.append(np.log10(concentration / (c[k][some] + concentration)))
    goes = lambda k, n: states[k + 1][n] if k + 1 < len(states) else (states[k][block.number[k - 1][block.at[k][n]]] if k else np.zeros(len(n), dtype=np.int64))
    every = np.arange(width)
    arcs, weights, targets = [every], [np.log10(p)], [goes(0, every)]
    for k in range(1, len(c)):
        here = block.at[k]
        history = block.number[k - 1][here - 1]
        p = (c[k] + concentration * p[block.number[k - 1][here]]) / (c[k - 1][history] + concentration)
        seen = np.flatnonzero(c[k] > 0)
        arcs.append(states[k][history[seen]] * width + block.number[0][here[seen]])
        weights.append(np.log10(p[seen]))
        targets.append(goes(k, seen))
    keys = np.concatenate(arcs)
    order = np.argsort(keys)
    first = np.searchsorted(block.hashes[0], block.start)
    join = lambda x: np.concatenate(x)[order]
    return Automaton(keys[order], join(weights), join(targets), np.concatenate(failure), np.concatenate(penalty), int(states[1][first]) if len(c) > 1 else 0, width, len(c))


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, all lowest bytes first."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of (k, train, t) in blocks, each with a name: its task, its turn and its texts.

    The name is the same whenever the same rows are read in the same order.
    """
    part, turn = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a, b in pieces(batch.column(2), block_bytes):
            rows = batch.slice(a, b - a)
            digest = xxhash.xxh3_64(f"{part} {turn}")
            for value in rows.column(2).cast(pa.binary()).to_pylist():
                digest.update(value)
            turn += 1
            yield digest.intdigest() - (1 << 63), rows


def _n_grams(batches: Iterator[pa.RecordBatch], order: int, width: int, bits: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of each block, order and range of hashes: the n-grams as differences, and their training counts."""
    shift = np.uint64(width - bits)
    for name, rows in _blocks(batches, block_bytes):
        block = Block(_words(rows.column(2)), order, width)
        counts = block.counts(rows.column(1).to_numpy(zero_copy_only=False))
        for k, (hashes, n) in enumerate(zip(block.hashes, counts, strict=True)):
            if not len(hashes):  # no text of the block is so long
                continue
            ranges, cuts = np.unique(hashes >> shift if bits else np.zeros(len(hashes), dtype=np.uint64), return_index=True)
            parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(hashes)], strict=True))
            yield pa.record_batch(
                [
                    pa.array([name] * len(ranges), pa.int64()),
                    pa.array([k] * len(ranges), pa.int32()),
                    pa.array(ranges.astype(np.int64)),
                    pa.array([_pack(np.diff(hashes[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()),
                    pa.array([_pack(n[a:b]) for a, b in parts], pa.binary()),
                ],
                ["block", "k", "range", "grams", "counts"],
            )


def _totals(rows: pa.Table) -> pa.Table:
    """For each block's n-grams of one order and range how often they occur in all blocks."""
    grams = [np.cumsum(_unpack(x), dtype=np.uint64) for x in rows["grams"].to_pylist()]
    counts = np.concatenate([_unpack(x) for x in rows["counts"].to_pylist()])
    _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(inverse, weights=counts).astype(np.uint64)[inverse]
    cuts = np.cumsum([0, *map(len, grams)])
    packed = [_pack(total[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.table([rows["block"], rows["k"], rows["range"], pa.array(packed, pa.binary())], ["block", "k", "range", "totals"])


def _packed(rows: pa.RecordBatch) -> bytes:
    """A block's rows, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _scores(packed: pa.Table, answers: pa.Table, order: int, width: int, denominator: float, concentration: float) -> pa.Table:
    """The scores of a block's texts."""
    texts = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed["rows"]).combine_chunks()
    block = Block(_words(texts["t"]), order, width)
    parts: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.uint64)] for _ in range(order)]
    for row in answers.sort_by([("k", "ascending"), ("range", "ascending")]).select(["k", "totals"]).to_pylist():
        parts[row["k"]].append(_unpack(row["totals"]))
    counts = [np.concatenate(x) for x in parts]
    if [len(c) for c in counts] != [len(h) for h in block.hashes]:
        raise RuntimeError("the rows to score were read in another order the second time; write them as a table first")
    model = build(block, counts, denominator, concentration)
    predicted = np.ones(len(block.number[0]), dtype=bool)
    predicted[block.ends - block.sizes - 1] = False
    ids = block.number[0][predicted].astype(np.int64)
    sizes = block.sizes + 1
    firsts = np.cumsum(sizes) - sizes
    n = counts[0][ids].astype(np.float64)
    return pa.table(
        [
            texts["k"],
            texts["train"],
            pa.array(sizes),
            pa.array(np.add.reduceat((n > 0).astype(np.int64), firsts)),
            pa.array(np.add.reduceat(np.log10((n + 1) / denominator), firsts)),
            pa.array(model.traverse(ids, sizes)),
        ],
        ["k", "train", "n_tokens", "n_known", "base_score", "score"],
    )


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, concentration: float = CONCENTRATION, block_bytes: int = BLOCK_BYTES, counted_bytes: int = COUNTED_BYTES) -> DataFrame:
    """(key, training, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Texts where ``training`` is true are learned from; where it is null they are
    not. Tokens are words, lower case A to Z, then one end. Null and empty texts
    are an end alone. base_score: the sum of log10((c + 1) / (N + V + 1)) with c
    the token's count, N all and V the distinct training tokens. score: log10
    probability by the automaton of n-grams up to ``order``. Rows that repeat
    are scored alike, whatever their key; an empty table gives an empty one;
    other columns of docs are not read. Without training texts every token has
    probability 1.

    Every word and n-gram of every training text is in the model, so it grows
    with the corpus; words are told apart by 64-bit hashes, n-grams by
    ``hash_bits`` of them. A block
    sends each of its distinct n-grams once, with its training count, to the
    range of hashes it falls in, so no n-gram, however frequent, makes a range
    larger than the others; what comes back is a count for each, and meets the
    block's texts there, which travel compressed. docs is read three times and must give the same rows
    in the same order, as a table or a checkpoint does; otherwise it raises.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("k"), F.coalesce(training, F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    sums = count_words(rows.where("train")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    bits = max(0, int(2 * size // counted_bytes).bit_length())
    denominator = float(sums.n + sums.v + 1)

    width = hash_bits(size)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches, block_bytes):
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([_packed(part)], pa.binary())], ["block", "rows"])

    grams = rows.mapInArrow(lambda it: _n_grams(it, order, width, bits, block_bytes), "block bigint, k int, range bigint, grams binary, counts binary")
    answers = grams.groupBy("k", "range").applyInArrow(_totals, "block bigint, k int, range bigint, totals binary")
    texts = rows.mapInArrow(name, "block bigint, rows binary")
    shape = T.StructType([T.StructField("k", kind), *T.StructType.fromDDL("train boolean, n_tokens bigint, n_known bigint, base_score double, score double")])
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _scores(a, b, order, width, denominator, concentration), shape)
    return scored.select(F.col("k").alias(key), F.col("train").alias("training"), "n_tokens", "n_known", F.lit(sums.n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    scored = score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
