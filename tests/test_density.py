"""Density clustering, the merge tree, terms and coverage against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import density, topic_tree


def brute(keys, vectors, least, neighbours):
    """Memberships by the definitions, on all pairs of rows."""
    steps, n = np.array(vectors, dtype=float), len(vectors)
    d = ((steps[:, None] - steps) ** 2).sum(-1)
    others = np.sort(np.where(np.eye(n, dtype=bool), np.inf, d), axis=1)
    core = others[np.arange(n), min(neighbours, n - 1) - 1]
    w = np.maximum(np.maximum(d, 1), np.maximum(core[:, None], core))
    # the tree, and of each pair of rows the heaviest edge between them
    path, left, inside = np.zeros((n, n)), set(range(1, n)), [0]
    near = {v: (w[0, v], 0) for v in left}
    tree = []
    while left:
        v = min(left, key=lambda x: near[x])
        weight, u = near[v]
        for x in inside:
            path[x, v] = path[v, x] = max(path[x, u], weight)
        tree.append((weight, u, v))
        inside.append(v)
        left.remove(v)
        near = {x: min(near[x], (w[v, x], v)) for x in left}

    clusters, leaves = [], {}

    def parts(rows, below):
        rest, out = set(rows), []
        while rest:
            first = min(rest)
            group = {x for x in rest if x == first or path[first, x] < below}
            rest -= group
            out.append(sorted(group))
        return out

    def descend(rows, parent, birth):
        me = len(clusters)
        clusters.append({"parent": parent, "birth": birth, "rows": rows, "stability": 0.0, "children": []})
        now = rows
        while True:
            top = path[np.ix_(now, now)].max() if len(now) > 1 else core[now[0]]
            at = max(top, 1) ** -0.5
            split = parts(now, top)
            big = [p for p in split if len(p) >= least]
            stay = big[0] if len(big) == 1 else []
            for r in set(now) - set(stay):
                clusters[me]["stability"] += at - birth
                if not any(r in p for p in big):
                    leaves[r] = (me, at)
            if len(big) == 1:
                now = stay
                continue
            for p in big:
                clusters[me]["children"].append(descend(p, me, at))
            return me

    descend(list(range(n)), None, 0.0)

    def best(i):
        below = [best(c) for c in clusters[i]["children"]]
        total, own = sum(b for b, _ in below), clusters[i]["stability"]
        if i and (not below or own >= total - 1e-15):
            return own, [i]
        return total, [x for _, s in below for x in s]

    chosen = sorted(best(0)[1], key=lambda i: (-len(clusters[i]["rows"]), min(clusters[i]["rows"])))
    up = lambda i: [i, *up(clusters[i]["parent"])] if i else []
    out = {}
    for r in range(n):
        home, at = leaves[r]
        raw = {}
        for t, c in enumerate(chosen):
            peak = max(leaves[x][1] for x in clusters[c]["rows"])
            if c in up(home):
                raw[t] = min(1.0, at / peak)
            elif set(up(home)) & set(up(c)):
                raw[t] = min(1.0, max(path[r, clusters[c]["rows"][0]], 1) ** -0.5 / peak)
        most, total = max(raw.values(), default=0.0), sum(raw.values())
        for t, x in raw.items():
            out[keys[r], t] = x / total * most
        if most < 1 - 1e-12:
            out[keys[r], -1] = 1 - most
    return out


def blobs(seed, n, width=3, copies=6):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-400, 400, (5, width))
    rows = [middle[rng.integers(5)] + rng.integers(-25, 26, width) for _ in range(n - copies)] + [middle[0]] * copies
    spread = [rng.integers(-600, 600, width) for _ in range(n // 10)]
    return [[int(x) for x in r] for r in rows + spread]


def found(df):
    return {(r.id, r.topic_id): r.membership for r in df.collect()}


def assert_close(a, b):
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a), max(abs(a[k] - b[k]) for k in a)


@pytest.mark.parametrize(("seed", "n", "least", "part"), [(3, 450, 8, 200_000), (2, 50, 4, 20)])
def test_clusters_equal_brute_force(spark, seed, n, least, part):
    vectors = blobs(seed, n)
    # the scale is a power of two, so steps are the vectors times one number
    largest = max(abs(x) for v in vectors for x in v)
    scale = 2 ** (20 - int(np.ceil(np.log2(largest))))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<double>")
    ours = found(density.cluster(df, "id", "v", least=least, tile=32, part=part))
    assert_close(ours, brute(range(len(vectors)), [[x * scale for x in v] for v in vectors], least, least))
    assert len({t for _, t in ours}) > 2


def test_equal_weights_and_parts_of_one_weight(spark):
    """A lattice: every edge weighs the same, beyond the bound of a part."""
    vectors = [[float(x), float(y)] for x in range(6) for y in range(6)] + [[100.0 + x, 0.0] for x in range(8)] + [[60.0, 60.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "id bigint, v array<float>")
    ours = found(density.cluster(df, "id", "v", least=4, neighbours=1, tile=16, part=20))
    assert_close(ours, brute(range(len(vectors)), [[x * 2**13 for x in v] for v in vectors], 4, 1))


def test_odd_vectors(spark):
    schema = "id bigint, v array<double>"
    rows = [(1, None), (2, [float("nan")]), (3, [None]), (4, [1.0]), (5, [1.0, 0.0]), (6, [1.0])]
    assert found(density.cluster(spark.createDataFrame(rows, schema), "id", "v", least=2)) == {(i, -1): 1.0 for i in range(1, 7)}
    assert density.cluster(spark.createDataFrame([], schema), "id", "v").count() == 0
    assert found(density.cluster(spark.createDataFrame(rows[:3], schema), "id", "v")) == {(i, -1): 1.0 for i in range(1, 4)}


def merges_of(unit):
    """One pair at a time."""
    groups, out = {i: [i] for i in range(len(unit))}, []
    while len(groups) > 1:
        pairs = [(1 - (unit[groups[a]].sum(0) @ unit[groups[b]].sum(0)) / (len(groups[a]) * len(groups[b])), a, b) for a in groups for b in groups if a < b]
        height, a, b = min(pairs)
        groups[a] += groups.pop(b)
        out.append((a, b, height))
    return out


def test_merge_tree_equals_one_pair_at_a_time(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 5)) + np.repeat(rng.normal(size=(8, 5)) * 3, 5, axis=0)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "t bigint, v array<double>")
    topics, width = topic_tree.centroids(df, "t", "v")
    topics = topics.cache()
    unit = np.array([r.steps for r in topics.orderBy("topic_id").collect()], dtype=float)
    unit /= max(np.linalg.norm(u) for u in unit)
    merges = topic_tree.merge_tree(topics, width).cache()
    expected = merges_of(unit)
    ours = [(r.kept, r.absorbed, r.height) for r in merges.orderBy("place").collect()]
    assert [x[:2] for x in ours] == [x[:2] for x in expected]
    assert np.allclose([x[2] for x in ours], [x[2] for x in expected], atol=1e-9)
    for k in (1, 2, 7, 25, 40):
        into = list(range(40))
        for kept, gone, _ in expected[: 40 - k]:
            into = [kept if x == gone else x for x in into]
        assert {r.topic_id: r.merged for r in topic_tree.cut(topics, merges, k).collect()} == dict(enumerate(into))
    with pytest.raises(ValueError, match="number of topics"):
        topic_tree.cut(topics, merges, 41)


def test_one_topic_has_no_merges(spark):
    topics, width = topic_tree.centroids(spark.createDataFrame([(0, [1.0, 2.0]), (-1, [5.0, 5.0])], "t bigint, v array<double>"), "t", "v")
    merges = topic_tree.merge_tree(topics, width)
    assert merges.count() == 0 and merges.columns == ["place", "kept", "absorbed", "height"]


def test_coverage_weighs_by_characters(spark):
    segments = spark.createDataFrame([("a", 1, 30), ("a", 2, 10), ("b", 3, 0), ("b", 4, 0)], "doc string, segment bigint, characters bigint")
    shares = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.25), (1, -1, 0.25), (2, 1, 1.0), (3, 0, 1.0)], "segment bigint, topic_id bigint, membership double")
    ours = {(r.doc, r.topic_id): round(r.coverage, 9) for r in topic_tree.coverage(segments, shares).collect()}
    assert ours == {("a", 0): 0.375, ("a", 1): 0.4375, ("a", -1): 0.1875, ("b", 0): 0.5, ("b", -1): 0.5}


def test_projected_coverage_adds_up(spark):
    coverage = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.25), (1, -1, 0.25)], "doc bigint, topic_id bigint, coverage double")
    into = spark.createDataFrame([(0, 0), (1, 0)], "topic_id bigint, merged bigint")
    assert {(r.topic_id, r.coverage) for r in topic_tree.project(coverage, into).collect()} == {(0, 0.75), (-1, 0.25)}


def test_terms_skip_nothing(spark):
    words = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["b", "c"]), (1, [])], "topic_id bigint, words array<string>")
    found = {(r.topic_id, r.place): r.term for r in topic_tree.terms(words, 2).collect()}
    assert found == {(0, 1): "a", (0, 2): "b", (1, 1): "c", (1, 2): "b"}
    assert topic_tree.terms(words.where(F.lit(False)), 2).count() == 0


@pytest.mark.parametrize(("n", "tile", "grid"), [(1, 4, 3), (2, 4, 3), (90, 1, 3), (150, 2, 2), (150, 64, 50)])
def test_spanning_tree_looks_at_all_pairs_once(spark, monkeypatch, n, tile, grid):
    """By one pass over the pairs, the one tree that the order of edges leaves, with many equal weights and several blocks."""
    rng = np.random.default_rng(n + grid)
    steps, core = rng.integers(0, grid, (n, 3)), rng.integers(0, 4, n)
    passes, by_pairs = [], density._by_pairs
    monkeypatch.setattr(density, "_by_pairs", lambda *x: passes.append(1) or by_pairs(*x))
    points = spark.createDataFrame([(i, int(core[i]), steps[i].tolist(), i // tile) for i in range(n)], "idx bigint, core bigint, steps array<int>, tile int")
    found = sorted((r.w, r.a, r.b) for r in density.spanning_tree(points, 3).collect())
    root, want = list(range(n)), []
    for w, a, b in sorted((max(int(((steps[a] - steps[b]) ** 2).sum()), core[a], core[b], 1), a, b) for a in range(n) for b in range(a + 1, n)):
        if root[a] != root[b]:
            want.append((w, a, b))
            root = [root[a] if x == root[b] else x for x in root]
    assert found == want and len(passes) == 1
