"""Selection and shares in a condensed tree, at once and level by level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexigrid.operators import density


def tree(seed, n, deep):
    """Clusters with one root; deep: nearly a chain."""
    rng = np.random.default_rng(seed)
    out = [("c0", None, 0.0, n + 5, 9.0)]
    for i in range(1, n):
        up = max(0, i - int(rng.integers(1, 3))) if deep else int(rng.integers(0, i))
        out.append((f"c{i}", f"c{up}", out[up][2] + float(rng.integers(1, 9)), n - i + 5, float(rng.integers(0, 20))))
    order = rng.permutation(n)
    return [out[i] for i in order]


SCHEMA = "name string, parent string, birth double, n bigint, stability double"


def test_small_trees_at_once_as_level_by_level(spark):
    for seed, n, deep in ((1, 1, False), (2, 2, False), (3, 40, False), (4, 12, True)):
        clusters = spark.createDataFrame(tree(seed, n, deep), SCHEMA).cache()
        ours, loops = (density.select_clusters(clusters, bound) for bound in (n, 0))
        assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, loops.collect()))
        named = density.written(ours.select("topic").distinct().selectExpr("topic", "crc32(encode(topic, 'utf-8')) AS topic_id", "length(topic) / 8D AS peak"))
        met = [{(r.name, r.topic_id): (r.peak, r.parts) for r in f(clusters, named).collect()} for f in (density._met_at_once, density._met_by_level)]
        assert met[0] == met[1] and (n < 3 or met[0])


def test_pairs_leave_in_pieces():
    rows = tree(5, 60, False)
    leaves = {r[0] for r in rows} - {r[1] for r in rows}
    batch = pa.record_batch([[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[0] in leaves for r in rows]], ["name", "parent", "birth", "topic"])
    whole, some = ([b.to_pylist() for b in density._meet(iter([batch]), piece)] for piece in (1 << 19, 7))
    key = lambda r: (r["name"], r["topic"], r["parts"] or 0.0)
    assert len(whole) == 1 and len(some) > 10
    assert sorted(whole[0], key=key) == sorted((r for b in some for r in b), key=key)
    assert len({(r["name"], r["topic"]) for r in whole[0]}) == len(whole[0])


def test_deep_trees_take_no_table_a_level(spark, monkeypatch):
    clusters = density.written(spark.createDataFrame(tree(6, 200, True), SCHEMA))
    made, written = [], density.written
    monkeypatch.setattr(density, "written", lambda df: made.append(1) or written(df))
    topics = density.select_clusters(clusters)
    members = clusters.selectExpr("'point ' || substr(name, 2) AS vertex", "name AS cluster", "birth + 1 AS lambda")
    assert density._shares(clusters, members, topics, None).count() > 0
    assert len(made) < 10
