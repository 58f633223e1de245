"""Close fingerprints that meet only where they have a sign in common, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from lexigrid.llm import simhash


def partition(label) -> set:
    groups: dict = {}
    for i, x in enumerate(label):
        groups.setdefault(int(x), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def brute(fps, radius, together) -> set:
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    for i, j in zip(*np.nonzero((apart <= radius) & together), strict=True):
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return partition(map(top, range(len(fps))))


@pytest.mark.parametrize(("run", "dense"), [(64, 300), (2, 300), (2, 20)])
def test_trees_of_shared_signs_against_all_pairs(monkeypatch, run, dense):
    monkeypatch.setattr(simhash, "RUN", run)
    rng = np.random.default_rng(1)
    centres = np.repeat(rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64), [dense] + [4] * 39, axis=0)
    fps = centres ^ (np.uint64(1) << rng.integers(0, 64, centres.shape).astype(np.uint64))
    sizes = np.sort(rng.integers(20, 40, len(fps)))
    signs = rng.integers(0, 6, (len(fps), 2)).astype(np.uint32)
    together = (signs[:, None, :, None] == signs[None, :, None, :]).any(axis=(2, 3))
    at = np.repeat(np.arange(len(fps)), 2)
    for similarity, radius in ((0.8, 4), (None, 3)):
        keys = sizes if similarity else np.sort(np.bitwise_count(fps).sum(axis=1, dtype=np.int64))
        order = np.arange(len(fps)) if similarity else np.argsort(np.bitwise_count(fps).sum(axis=1, dtype=np.int64), kind="stable")
        met = together[np.ix_(order, order)]
        if similarity:
            met = met & (keys[:, None] * 1.0 >= similarity * keys[None]) & (keys[None] >= similarity * keys[:, None])
        found = partition(simhash._trees(fps[order], keys, signs[order].ravel(), at, radius, similarity))
        wanted = brute(fps[order], radius, met)
        # a strip may tie a pair whose sizes are a little too far apart, and no pair is lost
        assert all(any(w <= f for f in found) for w in wanted)
        if not similarity:
            assert found == wanted


def test_few_of_many_strangers_are_compared(monkeypatch):
    """Texts with little in common are not all compared with each other."""
    compared = []
    close = simhash._close
    monkeypatch.setattr(simhash, "_close", lambda a, b, *rest: compared.append(len(a) * len(b)) or close(a, b, *rest))
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, (20_000, 1), dtype=np.uint64)
    fps = fps[np.argsort(np.bitwise_count(fps[:, 0]), kind="stable")]
    parts = np.stack([(fps[:, 0] >> np.uint64(12 * i)) & np.uint64(4095) | np.uint64(i << 12) for i in range(5)], axis=1)
    signs = parts.astype(np.uint32).ravel()
    tree = simhash._trees(fps, np.bitwise_count(fps).sum(axis=1, dtype=np.int64), signs, np.repeat(np.arange(len(fps)), 5), 4, None)
    assert len(tree) == len(fps) and sum(compared) < len(fps) ** 2 / 50
    # a dense group is one tree at once, and is not compared in the square of its number
    compared.clear()
    dense = np.uint64(0x0F0F0F0F0F0F0F0F) ^ (np.uint64(1) << rng.integers(0, 64, 6000).astype(np.uint64))
    dense = np.sort(dense)[:, None]
    dense = dense[np.argsort(np.bitwise_count(dense[:, 0]), kind="stable")]
    tree = simhash._trees(dense, np.bitwise_count(dense).sum(axis=1, dtype=np.int64), np.zeros(6000, np.uint32), np.arange(6000), 4, None)
    assert len(set(tree.tolist())) == 1 and sum(compared) < 6000 * 40


def test_parts_of_many_fingerprints_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PARTED", 0)
    monkeypatch.setattr(simhash, "SIGNS", 500)
    called = []
    sharing = simhash.sharing
    monkeypatch.setattr(simhash, "sharing", lambda *a: called.append(1) or sharing(*a))
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = values[:300].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    every = np.unique(np.concatenate((values, near, [np.uint64(0), np.uint64(3)])))
    fps = spark.createDataFrame([(bytearray(int(v).to_bytes(8, "big")), int(v).bit_count()) for v in every], "fp binary, ones int")
    found = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in simhash.linked(fps).collect()}
    wanted = {min(int(every[i]) for i in g): g for g in brute(every[:, None], 4, np.ones((len(every),) * 2, bool)) if len(g) > 1}
    assert called and found == {int(every[i]): least for least, g in wanted.items() for i in g}


def test_heads_of_similar_sets_share_a_value():
    rng = np.random.default_rng(4)
    for n in (1, 4, 5, 6, 20, 300):
        for _ in range(20):
            union = rng.choice(1 << 32, n, replace=False).astype(np.uint32)
            common = -(-4 * n // 5)
            split = common + int(rng.integers(0, n - common + 1))
            a, b = np.sort(union[:split]), np.sort(np.concatenate((union[:common], union[split:])))
            assert len(a) and set(simhash._head(a, 0.8)) & set(simhash._head(b, 0.8))
    assert len(simhash._head(np.zeros(0, np.uint32), 0.8)) == 0


def test_fingerprints_of_long_texts_are_majorities():
    rng = np.random.default_rng(6)
    shingles = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 255, 0, 256, 511, 3000)]
    shingles.append(np.repeat(np.array([0xFFFFFFFFFFFFFFFF], np.uint64), 700))
    found = simhash._fingerprints(shingles, 1)[:, 0].tolist()
    assert found == [sum(1 << b for b in range(64) if 2 * int(((s >> np.uint64(b)) & np.uint64(1)).sum()) > len(s)) for s in shingles]
