"""SimHash near-duplicates: exact comparison of fingerprints, tile against tile."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.shared import written
from lexigrid.llm.common import durable, meet, pieces, table
from lexigrid.llm.components import connected_components
from lexigrid.llm.textbytes import mix

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: A tile is meant for at least and at most so many fingerprints, and in between grows with their number. They are dealt by hash, so it can hold more.
TILE_MIN, TILE_MAX, TILES_WANTED = 4096, 65536, 64
#: Above so many fingerprints those that are close are met by equal parts, if these have at least so many bits.
PARTED, PART_BITS = 1 << 17, 10
#: Signs that are met in one task, runs of equal signs that are met in strips, and what rounding may add.
SIGNS, RUN, EPS = 1 << 21, 64, 1e-6
#: Texts in a block whose similarity is confirmed.
BLOCK = 256
#: Blocks whose fingerprints are compared together to find which of them meet, and pairs of blocks for which one copy of a block is sent.
TILE_BLOCKS, USES = 64, 16
#: What is known of a block's texts.
PACK = ("fps", "ends", "sets", "comps")
PACK_TYPES = ", ".join(f"{name} binary" for name in PACK)


def radius_for(similarity: float, bits: int, deviations: float = 3.0) -> int:
    """Differing bits of two sets with this Jaccard similarity, at most, but for chances beyond so many deviations.

    A bit differs with probability angle / pi, and the angle's cosine is the
    shared part of both, 2 s / (1 + s).
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _shingles(texts: list[bytes], words_per_shingle: int, repeats: bool = True) -> list[np.ndarray]:
    """The XXH64 of each text's shingles, in order, or the different ones by value."""
    digest, out = xxhash.xxh64_intdigest, []
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
        n = max(1, len(words) - words_per_shingle + 1) if words else 0
        joined = b" ".join(words)
        if n <= 1:
            hashes = [digest(joined, SEED)] * n
        else:
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = [0, *ends[: n - 1].tolist()]
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words_per_shingle - 1 :] - 1).tolist(), strict=True)]
        values = np.array(hashes, dtype=np.uint64)
        out.append(values if repeats else _different(values))
    return out


def _different(values: np.ndarray) -> np.ndarray:
    """The different values, rising."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _bit_counts(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each run of values, of which firsts are the places, how many have each of the 64 bits.

    A word counts one bit of each of its eight bytes, for up to 255 values.
    """
    sizes = np.diff(np.append(firsts, len(values)))
    words = -(-sizes // 255)
    first = np.cumsum(words) - words
    starts = np.repeat(firsts, words) + 255 * (np.arange(words.sum()) - np.repeat(first, words))
    out = np.empty((len(starts), 8, 8), dtype=np.int32)
    for bit in range(8):
        sums = np.add.reduceat((values >> np.uint64(bit)) & np.uint64(0x0101010101010101), starts)
        out[:, :, bit] = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(out.reshape(-1, 64), first, axis=0)


def _fingerprints(shingles: list[np.ndarray], lanes: int) -> np.ndarray:
    """For each text ``lanes`` words of 64 bits; all zero for a text without words.

    The first lane is of the shingles' XXH64, the others of bijections of it.
    """
    sizes = np.fromiter(map(len, shingles), dtype=np.int64, count=len(shingles))
    out = np.zeros((len(sizes), lanes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        values = np.concatenate(shingles)
        firsts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        for lane in range(lanes):
            lane_values = values if lane == 0 else mix(values ^ np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64)))
            over = (2 * _bit_counts(lane_values, firsts) > sizes[some, None]).astype(np.uint8)
            out[some, lane] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """An Arrow column with the bytes of each row, big-endian."""
    data, width = rows.astype(">u8").tobytes(), 8 * rows.shape[1]
    offsets = pa.array(np.arange(0, len(data) + 1, width, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(data)])


def _matrix(column: list[bytes] | pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=">u8").astype(np.uint64).reshape(-1, lanes)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = SHINGLE_WORDS, lanes: int = 1, similarity: float | None = None) -> DataFrame:
    """(key, fp binary, ones int): the SimHash of each whole text and its bit count, one row for each row of docs.

    similarity: with it, fingerprints are of the different shingles, and there
    are also size, how many 32-bit hashes these have, and head, see ``_head``.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "fp", "ones", "size", "head"][: 3 if similarity is None else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                texts = [x or b"" for x in batch.column(1)[a:b].cast(pa.binary()).to_pylist()]
                shingles = _shingles(texts, words_per_shingle, similarity is None)
                rows = _fingerprints(shingles, lanes)
                columns = [batch.column(0)[a:b], _binary(rows), pa.array(_ones(rows).astype(np.int32))]
                if similarity is not None:
                    sets = [_different(x.astype(np.uint32)) for x in shingles]
                    columns += [pa.array([len(x) for x in sets], pa.int32()), pa.array([_head(x, similarity).tobytes() for x in sets], pa.binary())]
                yield pa.record_batch(columns, names)

    shape = f"k {kind}, fp binary, ones int" + ", size int, head binary" * (similarity is not None)
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, shape).withColumnRenamed("k", key)


def _head(rising: np.ndarray, similarity: float) -> np.ndarray:
    """The first values of a set, so many that sets of this Jaccard similarity have one of them in common.

    They have at least ``similarity`` of either's values in common, so the least
    common one has that many less one behind it.
    """
    return rising[: len(rising) - max(1, math.ceil(similarity * len(rising) - EPS)) + 1]


def _ones(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows).sum(axis=1, dtype=np.int64)


def _centres(fps: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each fingerprint the position of the least, as bytes compare, of those with its label.

    A tree that is a star around its least member is a component as it stands.
    """
    order = np.lexsort(tuple(fps[:, lane] for lane in range(fps.shape[1] - 1, -1, -1)))
    names, first, inverse = np.unique(label[order], return_index=True, return_inverse=True)
    out = np.empty(len(fps), dtype=np.int64)
    out[order] = order[first][inverse]
    return out


def _close(a: np.ndarray, b: np.ndarray, radius: int, triangle: bool, sizes: tuple[np.ndarray, np.ndarray] | None = None, similarity: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within the radius, a strip of rows at a time.

    Both sides are ordered by bit count, so of each strip only the columns whose
    counts are within the radius are compared. With a similarity they are ordered
    by the sizes of their sets, and those of which it can be are compared.
    """
    counts_a, counts_b = sizes or (_ones(a), _ones(b))
    columns = [np.ascontiguousarray(b[:, lane]) for lane in range(b.shape[1])]
    lows = np.searchsorted(counts_b, counts_a - radius if similarity is None else counts_a * similarity - EPS, "left")
    highs = np.searchsorted(counts_b, _reach(counts_a, radius, similarity), "right")
    for r in range(0, len(a), 16):
        lo, hi = lows[r], highs[r : r + 16][-1]
        lo = max(lo, r) if triangle else lo
        if lo < hi:
            apart = np.bitwise_count(a[r : r + 16, 0, None] ^ columns[0][None, lo:hi])
            if len(columns) > 1:
                apart = apart.astype(np.uint16)
                for lane in range(1, len(columns)):
                    apart += np.bitwise_count(a[r : r + 16, lane, None] ^ columns[lane][None, lo:hi])
            x, y = np.nonzero(apart <= radius)
            if len(x):
                yield x + r, y + lo


def _reach(counts: np.ndarray, radius: int, similarity: float | None) -> np.ndarray:
    """Up to which bit count, or size of a set, others can be close."""
    return counts + radius if similarity is None else counts / similarity + EPS


def _tile(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints ordered by bit count, and for each the position of its component's centre."""
    fps = fps[np.lexsort((*fps.T, _ones(fps)))]
    label = np.arange(len(fps))
    for x, y in _close(fps, fps, radius, triangle=True):
        ends = np.stack((label[x], label[y]))
        ends = ends[:, ends[0] != ends[1]]  # the longer a dense group has been met, the fewer are left
        for i, j in np.unique(ends, axis=1).T.tolist():
            a, b = sorted((label[i], label[j]))
            if a != b:
                label[label == b] = a
    return fps, _centres(fps, label)


def _parts(fps: DataFrame, radius: int, lanes: int) -> DataFrame:
    """fps as (fp, size, head): their bits in radius + 1 parts, of which two within the radius have one alike; size is the bit count."""
    ends = [64 * lanes * i // (radius + 1) for i in range(radius + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(0).to_pylist(), lanes)
            signs = np.empty((len(rows), radius + 1), dtype=np.uint64)
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                bits = np.zeros(len(rows), dtype=np.uint64)
                for lane in range(a // 64, (b - 1) // 64 + 1):
                    x, y = max(a - 64 * lane, 0), min(b - 64 * lane, 64)
                    bits = mix(bits) ^ (rows[:, lane] >> np.uint64(x)) & np.uint64((1 << y - x) - 1)
                signs[:, i] = mix(bits ^ np.uint64(i << 56)) >> np.uint64(32)
            heads = pa.array([x.tobytes() for x in signs.astype(np.uint32)], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), heads], ["fp", "size", "head"])

    return fps.select("fp", "ones").mapInArrow(run, "fp binary, size int, head binary")


def _trees(fps: np.ndarray, sizes: np.ndarray, signs: np.ndarray, at: np.ndarray, radius: int, similarity: float | None) -> np.ndarray:
    """For each fingerprint one that it is tied to by close pairs with a sign in common, the same for all of a tree.

    fps are ordered by size; signs and at: a sign, and whose it is.
    """
    tree, many = np.arange(len(fps)), np.uint64(32)
    both = _different(signs.astype(np.uint64) << many | at.astype(np.uint64))
    signs, at = both >> many, (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    reach = np.searchsorted(sizes, _reach(sizes, radius, similarity), "right")

    def tops(x: np.ndarray) -> np.ndarray:
        up = tree[x]
        while (up != (further := tree[up])).any():
            up = further
        tree[x] = up
        return up

    def tie(x: np.ndarray, y: np.ndarray) -> None:
        x, y = tops(x), tops(y)
        ends = np.unique(x[x != y] << 32 | y[x != y])
        for a, b in zip((ends >> 32).tolist(), (ends & 0xFFFFFFFF).tolist(), strict=True):
            while tree[a] != a:
                a = tree[a]
            while tree[b] != b:
                b = tree[b]
            tree[max(a, b)] = min(a, b)

    edges = np.flatnonzero(np.append(True, signs[1:] != signs[:-1])) if len(signs) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(edges, len(signs)))
    # short runs all at once: each with the one behind it, then the one behind that
    last = np.repeat(edges + lengths, lengths)
    i = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= RUN), lengths))
    for step in range(1, RUN):
        i = i[i + step < last[i]]
        i = i[at[i + step] < reach[at[i]]]
        if not len(i):
            break
        x, y = at[i], at[i + step]
        apart = tops(x) != tops(y)
        x, y = x[apart], y[apart]
        near = np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1, dtype=np.int64) <= radius
        tie(x[near], y[near])

    def strips(a: np.ndarray, b: np.ndarray, triangle: bool) -> None:
        for x, y in _close(fps[a], fps[b], radius, triangle, (sizes[a], sizes[b]), similarity):
            tie(a[x], b[y])

    for k in np.flatnonzero(lengths > RUN).tolist():
        run = at[edges[k] : edges[k] + lengths[k]]
        if len(run) > 16 * RUN:  # some meet all, so that a dense group is a tree
            strips(run[:: len(run) // 16], run, False)
        names, number, count = np.unique(tops(run), return_inverse=True, return_counts=True)
        most = number == count.argmax()
        if len(names) > 1:  # those of the largest tree need not meet each other
            few = run[~most]
            strips(few, few, True)
            strips(few, run[most], False)
    return tops(np.arange(len(fps)))


def sharing(rows: DataFrame, radius: int, lanes: int, similarity: float | None = None) -> DataFrame:
    """(node, root): fingerprints that are within the radius of another that has a sign in common, by connected component.

    rows: fp, size (the bit count, or, with a similarity, how many values the
    text's set has) and head, the signs as 32-bit numbers. Signs are dealt by
    value, those of a batch and a share in one row with the fingerprints that
    have them. Each share gives a spanning forest.
    """
    count = rows.agg(F.coalesce(F.sum(F.octet_length("head")), F.lit(0))).first()[0] // 4
    shares = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // SIGNS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2), 4 << 20):
                part = batch.slice(a, b - a)
                heads = part.column(2).to_pylist()
                signs = np.frombuffer(b"".join(heads), np.uint32)
                at = np.repeat(np.arange(len(heads)), [len(x) // 4 for x in heads])
                share = (mix(signs.astype(np.uint64)) >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)
                order = np.argsort(share.astype(np.uint16 if shares < 1 << 16 else np.uint32), kind="stable")
                fps, sizes = _matrix(part.column(0).to_pylist(), lanes), part.column(1).to_numpy().astype(np.int32)
                names, first = np.unique(share[order], return_index=True)
                out = []
                for name, places in zip(names.tolist(), np.split(order, first[1:]), strict=True):
                    own, new = np.unique(at[places], return_inverse=True)
                    out.append((name, fps[own].tobytes(), sizes[own].tobytes(), signs[places].tobytes(), new.astype(np.uint32).tobytes()))
                if out:
                    yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), ["share", "fps", "sizes", "signs", "at"])

    def met(share: pa.Table) -> pa.Table:
        def read(name: str, kind: type) -> list[np.ndarray]:
            return [np.frombuffer(x, kind) for x in share[name].to_pylist()]

        sizes = read("sizes", np.int32)
        starts = np.cumsum([0, *map(len, sizes)])
        fps, sizes = np.concatenate(read("fps", np.uint64)).reshape(-1, lanes), np.concatenate(sizes)
        at = np.concatenate([x.astype(np.int64) + y for x, y in zip(read("at", np.uint32), starts.tolist(), strict=False)])
        order = np.argsort(sizes.astype(np.uint64) << np.uint64(40) | fps[:, 0] >> np.uint64(24))  # equal ones lie together
        fps, sizes = fps[order], sizes[order]
        new = np.append(True, (fps[1:] != fps[:-1]).any(axis=1) | (sizes[1:] != sizes[:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        fps, sizes = fps[new], sizes[new]
        tree = _trees(fps, sizes, np.concatenate(read("signs", np.uint32)), place[at], radius, similarity)
        some = np.flatnonzero(np.bincount(tree, minlength=len(tree))[tree] > 1)
        centre = _centres(fps[some], tree[some])
        off = centre != np.arange(len(some))
        return pa.table([_binary(fps[some[off]]), _binary(fps[some[centre[off]]])], ["a", "b"])

    dealt = rows.select("fp", "size", "head").mapInArrow(deal, "share bigint, fps binary, sizes binary, signs binary, at binary")
    return connected_components(dealt.repartition(shares, "share").groupBy("share").applyInArrow(met, "a binary, b binary"))


def linked(fps: DataFrame, radius: int = RADIUS, lanes: int = 1) -> DataFrame:
    """(node, root): fingerprints that are within the radius of another, by connected component.

    fps: distinct values in fp, with ones. Of many, only those that have one of
    radius + 1 parts alike are compared, as all within the radius have; where
    such parts would be short, or of few, all are. Those are dealt to tiles of
    like size in the order of their bit counts; a tile is compared with itself
    and with those whose bit counts can be within the radius, and with no other.
    Inside a tile only a spanning forest is kept, and between tiles one edge for
    each pair of such trees, so a dense group makes few edges.
    """
    bits = 64 * lanes
    histogram = {r.ones: r["count"] for r in fps.groupBy("ones").count().collect()}  # bits + 1 rows at most
    counts = [histogram.get(i, 0) for i in range(bits + 1)]
    total = sum(counts)
    if total > PARTED and bits // (radius + 1) >= PART_BITS:
        return sharing(_parts(fps, radius, lanes), radius, lanes)
    size = min(TILE_MAX, max(TILE_MIN, total // TILES_WANTED))
    offsets = [0]
    for i in range(bits + 1 + radius):
        offsets.append(offsets[-1] + (counts[i] if i <= bits else 0))
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i + 1)
    share = F.shiftrightunsigned(F.xxhash64(F.lit("deal"), "fp"), 11) / F.lit(float(1 << 53))
    dealt = fps.select("fp", F.floor((at(offsets, F.col("ones")) + F.floor(share * at(counts, F.col("ones")))) / size).alias("tile"))

    def tile(key, frame):
        import pandas as pd

        values, label = _tile(_matrix(frame["fp"], lanes), radius)
        return pd.DataFrame({"tile": [key[0]], "most": [int(_ones(values[-1:])[0])], "fps": [values.tobytes()], "label": [label.astype(np.uint32).tobytes()]})

    tiles = durable(dealt.groupBy("tile").applyInPandas(tile, "tile bigint, most int, fps binary, label binary"))
    read = lambda data: np.frombuffer(data, np.uint64).reshape(-1, lanes)

    def inside(batches):
        for batch in batches:
            for fp, label in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                values, label = read(fp), np.frombuffer(label, np.uint32)
                rest = np.flatnonzero(label != np.arange(len(label)))
                yield pa.record_batch([_binary(values[rest]), _binary(values[label[rest]])], ["a", "b"])

    def between(batches):
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                a, b = read(row[0]), read(row[2])
                of_a, of_b = (np.frombuffer(row[i], np.uint32).astype(np.int64) for i in (1, 3))
                trees = [np.unique(of_a[x] << 32 | of_b[y]) for x, y in _close(a, b, radius, triangle=False)]
                if trees:
                    trees = np.unique(np.concatenate(trees))
                    yield pa.record_batch([_binary(a[trees >> 32]), _binary(b[trees & 0xFFFFFFFF])], ["a", "b"])

    partners = F.expr("explode(sequence(tile + 1, last))")
    left = (
        tiles.withColumn("last", F.floor((at(offsets, F.col("most") + radius + 1) - 1) / size))
        .where("last > tile")
        .select(partners.alias("other"), F.col("fps").alias("fps_a"), F.col("label").alias("label_a"))
    )
    pairs = left.join(tiles.withColumnRenamed("tile", "other"), "other").select("fps_a", "label_a", "fps", "label")
    both = "a binary, b binary"
    return connected_components(tiles.select("fps", "label").mapInArrow(inside, both).union(pairs.mapInArrow(between, both)))


def _chunks(data: bytes, width: int) -> list[bytes]:
    return [data[i : i + width] for i in range(0, len(data), width)]


def _numbers(*sides: list[bytes]) -> list[np.ndarray]:
    """The values of each side as numbers, equal ones alike on all sides."""
    known: dict[bytes, int] = {}
    return [np.array([known.setdefault(x, len(known)) for x in side], dtype=np.int64) for side in sides]


def _packed(rows: pa.Table) -> pa.Table:
    """A block's fingerprints in the order of their bit counts, with their components and their shingle sets one behind the other."""
    fps = _matrix(rows["fp"].to_pylist(), len(rows["fp"][0].as_py()) // 8)
    order = np.argsort(_ones(fps), kind="stable")
    sets, comps = ([column[i] for i in order.tolist()] for column in (rows["shingles"].to_pylist(), rows["comp"].to_pylist()))
    ends = np.cumsum([len(x) // 4 for x in sets])
    found = {"fps": fps[order].tobytes(), "ends": ends.astype(np.int64).tobytes(), "sets": b"".join(sets), "comps": b"".join(comps)}
    kept = {name: rows[name][:1] for name in rows.column_names if name not in ("fp", "shingles", "comp")}
    return pa.table(kept | {name: pa.array([x], pa.binary()) for name, x in found.items()})


def _confirm(row: pa.Table, radius: int, lanes: int, similarity: float) -> pa.Table:
    """A spanning forest of the links between two blocks' texts, or inside one, each tree as a star.

    Texts of one component are one tree from the start. Candidates are asked for
    their sets' similarity from the closest fingerprints on, and only while
    their trees are not one yet.
    """
    one = {name: row[name][0].as_py() for name in row.column_names}
    fps = [np.frombuffer(one[f"fps{side}"], np.uint64).reshape(-1, lanes) for side in "ab"]
    sets = [np.split(np.frombuffer(one[f"sets{side}"], np.uint32), np.frombuffer(one[f"ends{side}"], np.int64)[:-1]) for side in "ab"]
    same = one["block"] == one["other"]
    met = [(x, y) for x, y in _close(*fps, radius, triangle=same)]
    x, y = (np.concatenate([np.zeros(0, np.int64), *(m[i] for m in met)]) for i in (0, 1))
    if same:
        x, y = x[x < y], y[x < y]
    order = np.argsort(np.bitwise_count(fps[0][x] ^ fps[1][y]).sum(axis=1), kind="stable")
    (comps,) = _numbers(_chunks(one["compsa"] + (b"" if same else one["compsb"]), 8 * lanes))
    _, first, inverse = np.unique(comps, return_index=True, return_inverse=True)
    tree = first[inverse]

    def top(i: int) -> int:
        while tree[i] != i:
            tree[i] = i = tree[tree[i]]
        return i

    every, linked_rows = np.concatenate(fps) if not same else fps[0], []
    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        other = j + (0 if same else len(fps[0]))
        a, b = top(i), top(other)
        if a != b:
            left, right = sets[0][i], sets[1][j]
            shared = len(np.intersect1d(left, right, assume_unique=True))
            if shared >= similarity * (len(left) + len(right) - shared):
                tree[max(a, b)] = min(a, b)
                linked_rows += [i, other]
    rows = np.unique(np.array(linked_rows, dtype=np.int64))
    tops = np.array([top(i) for i in range(len(every))])
    # of a tree only its linked rows are tied, the others are tied to those already
    centre = _centres(every[rows], tops[rows])
    off = centre != np.arange(len(rows))
    return pa.table([_binary(every[rows[off]]), _binary(every[rows[centre[off]]])], ["a", "b"])


def _tiled(rows: pa.Table) -> pa.Table:
    """The fingerprints of a tile's blocks in the order of their bit counts, each with its component and its block's place in the list."""
    fps = [np.frombuffer(x, np.uint64) for x in rows["fps"].to_pylist()]
    width = 8 * rows["lanes"][0].as_py()
    comps = _chunks(b"".join(rows["comps"].to_pylist()), width)
    values = np.concatenate(fps).reshape(-1, width // 8)
    at = np.repeat(np.arange(len(fps), dtype=np.uint32), [8 * len(x) // width for x in fps])
    order = np.argsort(_ones(values), kind="stable")
    found = {"fps": values[order].tobytes(), "comps": b"".join([comps[i] for i in order.tolist()]), "at": at[order].tobytes()}
    kept = {name: rows[name][:1] for name in ("root", "tile", "tiles")}
    lists = {name: pa.array([rows[name].to_pylist()], pa.list_(kind)) for name, kind in (("blocks", pa.string()), ("whole", pa.bool_()))}
    return pa.table(kept | lists | {name: pa.array([x], pa.binary()) for name, x in found.items()})


def _meeting(row: pa.Table, radius: int, lanes: int) -> pa.Table:
    """Pairs of blocks of two tiles, or of one, with fingerprints within the radius that are not of one component.

    The fingerprints of a block that is part of one component are not compared
    with others of it.
    """
    one = {name: row[name][0].as_py() for name in row.column_names}
    fps = [np.frombuffer(one[f"fps{side}"], np.uint64).reshape(-1, lanes) for side in "ab"]
    at = [np.frombuffer(one[f"at{side}"], np.uint32).astype(np.int64) for side in "ab"]
    comps = _numbers(*(_chunks(one[f"comps{side}"], 8 * lanes) for side in "ab"))
    group = np.where(np.array(one["wholea"])[at[0]], comps[0], -1)
    met = [np.zeros(0, np.int64)]
    for g in np.unique(group).tolist():
        i, j = np.flatnonzero(group == g), np.flatnonzero(comps[1] != g)
        for x, y in _close(fps[0][i], fps[1][j], radius, triangle=False):
            x, y = i[x], j[y]
            apart = comps[0][x] != comps[1][y]
            met.append(np.unique(at[0][x[apart]] << 32 | at[1][y[apart]]))
    names = sorted({tuple(sorted((one["blocksa"][k >> 32], one["blocksb"][k & 0xFFFFFFFF]))) for k in np.concatenate(met).tolist()})
    return pa.table([pa.array([n[i] for n in names], pa.string()) for i in (0, 1)], ["block", "other"])


def _sides(frame: DataFrame, names: tuple[str, ...], side: str) -> list:
    return [frame[name].alias(name + side) for name in names]


def _brought(pairs: DataFrame, packs: DataFrame, name: str, other: str, side: str) -> DataFrame:
    """pairs with the pack of the block in ``name``, of which a copy is sent for about every USES pairs."""
    uses = durable(pairs.groupBy(name).agg(F.count("*").alias("n"), F.ceil(F.count("*") / USES).alias("copies")))
    turns = meet(pairs, uses, name).withColumn("turn", F.pmod(F.xxhash64(F.lit("turn"), other), "copies")).drop("copies")
    ready = packs.withColumnRenamed("block", name).join(uses.drop("n"), name)
    return turns.join(ready.select(name, F.expr("explode(sequence(0L, copies - 1))").alias("turn"), *_sides(ready, PACK, side)), [name, "turn"]).drop("turn")


def confirmed(docs: DataFrame, candidates: DataFrame, key: str, text: str, words_per_shingle: int, radius: int, lanes: int, similarity: float) -> DataFrame:
    """(node, root): candidates linked anew, where their sets of shingles have the exact Jaccard similarity.

    candidates: fp, root and first, the key of a row with that fingerprint. The
    candidates of a component are dealt to blocks of about BLOCK texts, and each
    block meets itself and those that are a power of two further on, which links
    nearly all that can be linked. What is left is dealt anew, see ``_rest``.
    """
    wanted = candidates.select(F.col("first").alias(key), "root", "fp")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                part = batch.slice(a, b - a)
                shingles = _shingles([x or b"" for x in part.column(0).cast(pa.binary()).to_pylist()], words_per_shingle, repeats=False)
                own = part.column(2).to_pylist()
                again = _binary(_fingerprints(shingles, lanes)).to_pylist()
                same = [i for i, (x, y) in enumerate(zip(own, again, strict=True)) if x == y]
                hashes = [_different(shingles[i].astype(np.uint32)).tobytes() for i in same]
                yield pa.record_batch([part.column(1).take(pa.array(same, pa.int64())), pa.array([own[i] for i in same], pa.binary()), pa.array(hashes, pa.binary())], ["root", "fp", "shingles"])

    texts = docs.select(key, F.col(text).alias("t")).join(wanted, key).select("t", "root", "fp")
    found = durable(texts.mapInArrow(sets, "root binary, fp binary, shingles binary").dropDuplicates(["fp"]))
    sizes = durable(found.groupBy("root").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
    placed = meet(found, sizes, "root").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "fp"), "blocks")).withColumn("comp", F.col("fp"))
    packs = durable(placed.groupBy("root", "block").applyInArrow(_packed, f"root binary, blocks bigint, block bigint, {PACK_TYPES}"))
    ahead = F.expr("explode(filter(transform(sequence(-1, 40), k -> block + if(k < 0, 0L, shiftleft(1L, k))), x -> x < blocks))")
    left = packs.select("root", "block", ahead.alias("other"), *_sides(packs, PACK, "a"))
    both = left.join(packs.select("root", packs["block"].alias("other"), *_sides(packs, PACK, "b")), ["root", "other"])
    confirm = lambda row: _confirm(row, radius, lanes, similarity)
    # written tables here and below: a checkpoint keeps an estimated size that every join multiplies
    known = written(connected_components(both.groupBy("root", "other", "block").applyInArrow(confirm, "a binary, b binary")))
    large = sizes.where("blocks > 3")  # up to three blocks have all met each other
    if large.isEmpty():
        return known
    pairs, packs = _rest(found, large, known, radius, lanes)
    both = _brought(_brought(pairs, packs, "block", "other", "a"), packs, "other", "block", "b")
    edges = written(both.groupBy("block", "other").applyInArrow(confirm, "a binary, b binary"))
    return connected_components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges))


def _rest(found: DataFrame, large: DataFrame, known: DataFrame, radius: int, lanes: int) -> tuple[DataFrame, DataFrame]:
    """Which blocks must still meet, (block, other), and the packs of all blocks.

    Texts are dealt anew: a confirmed component of at least BLOCK texts has
    blocks of its own, smaller ones share blocks. Blocks of one component need
    not meet, so a dense group makes no pairs, and others meet only where they
    have close fingerprints. Those are compared alone, 32 bytes a text, in tiles
    of about TILE_BLOCKS blocks, each with itself and half of the others.
    """
    of = known.select(F.col("node").alias("fp"), F.col("root").alias("of"))
    tags = meet(found.select("root", "fp"), large.select("root", "n"), "root").join(of, "fp", "left")
    tags = durable(tags.select("root", "fp", F.coalesce("of", "fp").alias("comp")))
    comps = durable(tags.groupBy("root", "comp").agg(F.count("*").alias("size")).withColumn("whole", F.col("size") >= BLOCK))
    few, own = F.when(~F.col("whole"), F.col("size")), F.when(F.col("whole"), F.ceil(F.col("size") / BLOCK))
    roots = comps.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.coalesce(F.sum(few), F.lit(0)) / BLOCK).alias("shared"), F.coalesce(F.sum(own), F.lit(0)).alias("own"))
    roots = durable(roots.select("root", "n", "shared", F.ceil((F.col("shared") + F.col("own")) / TILE_BLOCKS).alias("tiles")))
    shapes = durable(meet(comps, roots, "root").withColumn("n", F.col("size")))
    parts = F.when(F.col("whole"), F.ceil(F.col("size") / BLOCK)).otherwise(F.col("shared"))
    number = F.pmod(F.xxhash64(F.lit("part"), F.when(F.col("whole"), F.col("fp")).otherwise(F.col("comp"))), parts)
    owner = F.when(F.col("whole"), F.hex("comp")).otherwise(F.lit(""))
    placed = (
        meet(tags.drop("root"), shapes, "comp")
        .select("root", "fp", "comp", "whole", "tiles", owner.alias("owner"), number.alias("number"))
        .withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "owner", F.floor(F.col("number") / TILE_BLOCKS)), "tiles"))
        .select("root", "fp", "comp", "whole", "tile", "tiles", F.concat_ws(":", F.hex("root"), "owner", "number").alias("block"))
    )
    packs = written(
        found.select("fp", "shingles").join(placed, "fp").groupBy("block").applyInArrow(_packed, f"root binary, whole boolean, tile bigint, tiles bigint, block string, {PACK_TYPES}")
    )
    fields = ("blocks", "whole", "fps", "comps", "at")
    names = packs.select("root", "tile", "tiles", packs["block"].alias("blocks"), "whole", "fps", "comps", F.lit(lanes).alias("lanes"))
    tiles = durable(
        names.groupBy("root", "tile").applyInArrow(_tiled, "root binary, tile bigint, tiles bigint, blocks array<string>, whole array<boolean>, fps binary, comps binary, at binary")
    )
    steps = tiles.withColumn("step", F.expr("explode(sequence(0L, tiles div 2))")).withColumn("other", F.expr("(tile + step) % tiles"))
    steps = steps.where("step * 2 < tiles or tile < other")
    left = steps.select("root", "tile", "other", *_sides(steps, fields, "a"))
    both = left.join(tiles.select("root", tiles["tile"].alias("other"), *_sides(tiles, fields, "b")), ["root", "other"])
    meeting = both.groupBy("root", "other", "tile").applyInArrow(lambda row: _meeting(row, radius, lanes), "block string, other string")
    return written(meeting), packs.select("block", *PACK)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS, lanes: int = 1, similarity: float | None = None
) -> DataFrame:
    """(key, fingerprint, component_id) for each row of docs.

    fingerprint: hexadecimal digits of ``lanes`` times 64 bits; component_id: the
    least key reachable over fingerprints that differ in at most ``radius`` bits.
    Texts without words, null ones too, have fingerprint zero and are linked like
    any other. A null key keeps its row and is no one's component_id unless the
    component has none but nulls. Rows that repeat a key are rows of their own.
    Columns of docs other than key and text are not read. An empty table gives
    an empty one.

    similarity: with it, fingerprints are of the different shingles of a text,
    and close ones are linked only if their texts' sets of shingles have at
    least this Jaccard similarity, which is worked out exactly (by 32-bit
    hashes); equal fingerprints are linked without. Fingerprints that only rows
    with null keys have are then linked to no other.
    """
    per_row = (durable if similarity is None else written)(fingerprints(docs, key, text, words_per_shingle, lanes, similarity))
    distinct = durable(per_row.groupBy("fp").agg(F.min(key).alias("first"), F.first("ones").alias("ones"), F.count("*").alias("n")))
    nodes = linked(distinct.select("fp", "ones"), radius, lanes) if not similarity else sharing(per_row.where(f"`{key}` is not null"), radius, lanes, similarity)
    if similarity is not None:
        candidates = nodes.join(distinct, nodes.node == distinct.fp).select("fp", "root", "first")
        nodes = confirmed(docs, candidates, key, text, words_per_shingle, radius, lanes, similarity)
    firsts = nodes.join(distinct, nodes.node == distinct.fp).groupBy("root").agg(F.min("first").alias("least"))
    least = nodes.join(firsts, "root").select(F.col("node").alias("fp"), "least", F.lit(True).alias("tied"))
    component = F.when(F.col("tied"), F.col("least")).otherwise(F.col("first")).alias("component_id")
    classes = durable(distinct.join(least, "fp", "left").select("fp", "n", component))
    return meet(per_row.select(key, "fp"), classes, "fp").select(key, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
