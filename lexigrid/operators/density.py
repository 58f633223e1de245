"""Density clustering of vectors and the merging of its topics, exact, as Spark jobs.

Distances are whole numbers: components are rounded to steps so fine that every
squared distance is exact in a double, so results do not depend on the order of
work. Equal vectors are one point with a weight from the start.

Steps: core distances from nearest neighbours and the edges of spanning trees of
any two blocks of points, each in one pass over pairs of groups of points; a
spanning tree of these edges by Borůvka rounds; the tree is cut by weight into parts of bounded
size, each of which is turned into a piece of the condensed tree by itself; the
pieces are joined by their names. A condensed tree of bounded size is gone through
at once, a larger one level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.shared import written
from lexigrid.operators.order import numbered

#: Points of a tile, tiles that a tile meets in one task, and edges, or clusters, that are turned into a tree in one task.
TILE, SPAN, PART = 512, 16, 200_000
#: Tiles of a block, whose points and another's get a tree at once, and blocks of a group, of which a task has two.
BLOCK, GROUP = 4, 8


def _steps(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows with a finite vector, with ``steps`` (array of int), and the longest vector's length."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col(vector).isNotNull() & finite)
    found = rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0)), F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))))).first()
    width, largest = found[0], found[1] or 1.0
    bits = min(20, (51 - max(width - 1, 0).bit_length()) // 2)
    scale = 2.0 ** (bits - int(np.ceil(np.log2(largest))))
    return rows.withColumn("steps", F.transform(vector, lambda x: F.round(x.cast("double") * scale).cast("int"))), width


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Arrays of int as rows of doubles; shorter ones end in zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)


def _by_tiles(points: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of each tile (column tile) and each run of SPAN tiles; all points meet all others in blocks."""
    tiles = (points.agg(F.max("tile")).first()[0] or 0) + 1
    left = points.select(F.col("tile").alias("i"), F.explode(F.sequence(F.lit(0), F.lit((tiles - 1) // SPAN))).alias("g"), *points.columns)
    right = points.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("i"), F.floor(F.col("tile") / SPAN).cast("int").alias("g"), *points.columns)
    return left.groupBy("i", "g").cogroup(right.groupBy("i", "g")).applyInArrow(f, schema)


def _by_pairs(points: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of the points of each two groups (g <= h, with ``mine`` the one of a point) of up to GROUP blocks of tiles.

    All points meet, also those of one group (g = h). A point is sent to as many
    tasks as there are groups: some eight, or more where groups are full.
    """
    tiles = (points.agg(F.max("tile")).first()[0] or 0) + 1
    per = BLOCK * min(GROUP, -(-tiles // (8 * BLOCK)))
    groups = -(-tiles // per)
    met = points.withColumn("mine", F.floor(F.col("tile") / per).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = met.withColumns({"g": F.least("mine", "other"), "h": F.greatest("mine", "other")}).drop("other")
    # the work is far larger than what is read, so small partitions are not put together
    return met.repartition(min(2 * groups * (groups + 1), 4000), "g", "h").groupBy("g", "h").applyInArrow(f, schema)


def core_distances(points: DataFrame, width: int, neighbours: int) -> DataFrame:
    """(idx, core): squared distance to the ``neighbours``-th nearest other row, or to the furthest where there are fewer.

    points: idx, n (rows that share the vector), steps, tile.
    """

    def nearest(met: pa.Table) -> pa.Table:
        idx, n, steps, mine = met["idx"].to_numpy(), met["n"].to_numpy(), _matrix(met["steps"], width), met["mine"].to_numpy()
        g, h = met["g"][0].as_py(), met["h"][0].as_py()
        found = [[np.zeros(0, np.int64)] for _ in range(3)]
        for one, two in {(g, h), (h, g)}:
            rows, others = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
            k = min(neighbours, len(others))
            for some in np.array_split(rows, -(-len(rows) // TILE)) if k and len(rows) else ():
                distance = _squared(steps[some], steps[others])
                distance[idx[some][:, None] == idx[others]] = np.inf
                place = np.argpartition(distance, k - 1, axis=1)[:, :k]
                d = np.take_along_axis(distance, place, axis=1)
                other = np.isfinite(d)
                for at, x in enumerate((np.repeat(idx[some], k)[other.ravel()], d[other].astype(np.int64), n[others][place][other])):
                    found[at].append(x)
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in found], ["idx", "d", "n"])

    near = _by_pairs(points.select("idx", "n", "steps", "tile"), nearest, "idx bigint, d bigint, n bigint")
    lists = near.groupBy("idx").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("n").alias("m")))), 1, neighbours).alias("near"))
    walk = F.aggregate(
        "near",
        F.struct((neighbours - (F.col("n") - 1)).alias("need"), F.lit(0).cast("bigint").alias("core")),
        lambda a, x: F.when(a["need"] > 0, F.struct((a["need"] - x["m"]).alias("need"), x["d"].alias("core"))).otherwise(a),
        lambda a: a["core"],
    )
    return points.select("idx", "n").join(lists, "idx", "left").select("idx", F.coalesce(walk, F.lit(0)).alias("core"))


def _jump(links: DataFrame) -> DataFrame:
    """(node, root): where each node's links (node, up) end; every chain of them does."""
    roots = written(links.select("node", F.col("up").alias("root")))
    while True:
        further = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(roots.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if jumped.where("moved").isEmpty():
            return jumped.select("node", "root")
        roots = jumped.select("node", "root")


def _local_tree(idx: np.ndarray, steps: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): the minimum spanning tree of some points, by rising idx; edges are ordered by weight, then by their ends."""
    square = (steps * steps).sum(1)
    weight = steps @ steps.T
    weight *= -2
    weight += square[:, None]
    weight += square
    np.maximum(weight, core[:, None], out=weight)
    np.maximum(weight, np.maximum(core, 1), out=weight)
    # of each point the best edge to the tree: its weight (below all once it is in), the same (above all), its end
    best = weight[0].copy()
    open_, end = best.copy(), np.zeros(len(idx), np.int64)
    best[0], open_[0] = -1, np.inf
    one, two, w = (np.zeros(len(idx) - 1, np.int64) for _ in range(3))
    for i in range(len(idx) - 1):
        least = open_.min()
        at = np.flatnonzero(open_ == least)
        at = at[0] if len(at) == 1 else at[np.lexsort((np.maximum(at, end[at]), np.minimum(at, end[at])))[0]]
        one[i], two[i], w[i] = end[at], at, least
        best[at], open_[at] = -1, np.inf
        row = weight[at]
        better = (row < best) | ((row == best) & (at < end))
        for kept, new in ((best, row), (open_, row), (end, at)):
            np.copyto(kept, new, where=better)
    return idx[np.minimum(one, two)], idx[np.maximum(one, two)], w


def spanning_tree(points: DataFrame, width: int) -> DataFrame:
    """(a, b, w): a minimum spanning tree of mutual reachability, the largest of the squared distance and both cores, at least 1.

    points: idx, core, steps, tile. Edges are ordered by weight, then by their
    ends, so there is just one such tree. An edge of it between two blocks of
    points, or within one, is in the tree of these two blocks alone: all pairs
    are looked at once for these trees, and Borůvka rounds go over their edges.
    """

    def trees(met: pa.Table) -> pa.Table:
        met = met.sort_by("idx")
        idx, core, steps = met["idx"].to_numpy(), met["core"].to_numpy().astype(float), _matrix(met["steps"], width)
        mine, block = met["mine"].to_numpy(), met["tile"].to_numpy() // BLOCK
        g, h = met["g"][0].as_py(), met["h"][0].as_py()
        ours, theirs = (np.unique(block[mine == x]) for x in (g, h))
        pairs = [(i, j) for i in ours for j in theirs if i < j] or [(i, i) for i in ours if g == h]
        found = [(np.zeros(0, np.int64),) * 3]
        for i, j in pairs:
            some = np.flatnonzero((block == i) | (block == j))
            if len(some) > 1:
                found.append(_local_tree(idx[some], steps[some], core[some]))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], ["a", "b", "w"])

    left = _by_pairs(points.select("idx", "core", "steps", "tile"), trees, "a bigint, b bigint, w bigint")
    left = written(left.withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    edges = None
    while True:
        both = left.select(F.col("ca").alias("comp"), "w", "a", "b", F.col("cb").alias("other")).union(left.select("cb", "w", "a", "b", "ca"))
        chosen = written(both.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("comp", "e.*"))
        if chosen.isEmpty():
            return edges if edges is not None else chosen.select("a", "b", "w")
        new = chosen.select("a", "b", "w").distinct()
        edges = new if edges is None else edges.union(new)
        back = chosen.select(F.col("comp").alias("other"), F.col("other").alias("back"))
        links = chosen.join(back, "other").where((F.col("back") != F.col("comp")) | (F.col("comp") > F.col("other"))).select(F.col("comp").alias("node"), F.col("other").alias("up"))
        roots = _jump(links)
        for end in ("ca", "cb"):
            left = left.join(roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left = written(left.where("ca <> cb"))


def _components(edges: DataFrame) -> DataFrame:
    """(node, root) of the ends of edges (a, b): root is the least node of each component."""
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    ties = written(edges.select(both).select("e.*"))
    labels = written(ties.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        short = written(labels.join(up, "root").select("node", F.col("next").alias("root")))
        mine, theirs = short.select(F.col("node").alias("a"), F.col("root").alias("ra")), short.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        met = ties.join(mine, "a").join(theirs, "b").where("rb < ra")
        offers = met.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("rb").alias("root")), F.struct(F.col("ra").alias("node"), F.col("rb").alias("root")))).alias("o")).select("o.*")
        labels = written(short.union(offers).groupBy("node").agg(F.min("root").alias("root"), (F.min("root") < F.max("root")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("node", "root")


_PIECES = "kind string, name string, ref string, lambda double, n bigint"


def _condense(edges: pa.Table, least: int) -> pa.Table:
    """A part's piece of the condensed tree, its edges taken by rising weight, equal ones at once.

    edges: part, a, b, w, na, nb, ca, cb: the ends' names, sizes, and the weights
    at which their own rows come together. Kinds of rows:

    node    a cluster (name) under another (ref), from lambda on, with n rows then
    add     n rows leave the cluster (name) at lambda
    member  a vertex smaller than a cluster (name) leaves cluster ref at lambda, or, if ref begins with "part ", is of the vertex of that part
    top     the part (name) as a whole is of cluster ref
    """
    part = edges["part"][0].as_py()
    rows = sorted(zip(*(edges[c].to_pylist() for c in ("w", "a", "b", "na", "nb", "ca", "cb")), strict=True))
    root: dict[str, str] = {}
    size: dict[str, int] = {}
    cluster: dict[str, str | None] = {}
    waiting: dict[str, list[tuple[str, int]]] = {}
    out: list[tuple[str, str, str | None, float, int]] = []
    made = 0

    def enter(v: str, n: int, core: int) -> None:
        if v in root:
            return
        root[v], size[v], cluster[v], waiting[v] = v, n, None, []
        if n < least:
            waiting[v] = [(v, n)]
        elif v.startswith("part "):
            cluster[v] = f"top {v}"
        else:
            cluster[v] = v
            out.append(("add", v, None, max(core, 1) ** -0.5, n))
            out.append(("member", v, v, max(core, 1) ** -0.5, n))

    def find(v: str) -> str:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    i = 0
    while i < len(rows):
        j, met = i, {}
        while j < len(rows) and rows[j][0] == rows[i][0]:
            _, a, b, na, nb, ca, cb = rows[j]
            enter(a, na, ca)
            enter(b, nb, cb)
            ra, rb = find(a), find(b)
            x, y = met.pop(ra, [ra]), met.pop(rb, [rb])
            root[rb] = ra
            met[ra] = x + y
            j += 1
        at = max(rows[i][0], 1) ** -0.5
        for top, parts in met.items():
            big = [p for p in parts if cluster[p] is not None]
            small = [p for p in parts if cluster[p] is None]
            total = sum(size[p] for p in parts)
            held = [x for p in small for x in waiting[p]]
            if not big and total < least:
                now = None
            elif len(big) == 1:
                now = cluster[big[0]]
            else:
                made += 1
                now = f"cluster {part} {made}"
                out += [("node", cluster[p], now, at, size[p]) for p in big]
            if now is not None:
                leaving = sum(size[p] for p in small) if len(big) == 1 else total
                out.append(("add", now, None, at, leaving))
                out += [("member", v, now, at, n) for v, n in held]
                held = []
            size[top], cluster[top], waiting[top] = total, now, held
        i = j
    top = find(rows[0][1])
    out += [("member", v, f"part {part}", 0.0, n) for v, n in waiting[top]]
    if cluster[top] is not None:
        out.append(("top", f"part {part}", cluster[top], 0.0, size[top]))
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["kind", "name", "ref", "lambda", "n"])


def _condense_level(edges: DataFrame, least: int) -> DataFrame:
    """As ``_condense``, for parts whose edges all weigh the same: each is one meeting of all its vertices, of any number."""
    ends = edges.select("part", "w", F.col("a").alias("v"), F.col("na").alias("n"), F.col("ca").alias("c")).union(edges.select("part", "w", "b", "nb", "cb")).distinct()
    whole = F.col("v").startswith("part ")
    ends = written(ends.withColumn("own", F.when(F.col("n") >= least, F.when(whole, F.concat(F.lit("top "), "v")).otherwise(F.col("v")))))
    sums = ends.groupBy("part", "w").agg(F.sum("n").alias("total"), F.count("own").alias("big"), F.coalesce(F.sum(F.when(F.col("own").isNull(), F.col("n"))), F.lit(0)).alias("small"), F.min("own").alias("one"))
    made = F.when((F.col("big") == 0) & (F.col("total") < least), None).when(F.col("big") == 1, F.col("one")).otherwise(F.concat(F.lit("cluster "), "part", F.lit(" 1")))
    at = F.pow(F.greatest("w", F.lit(1)).cast("double"), F.lit(-0.5))
    sums = written(sums.select("part", "total", "big", "small", made.alias("now"), at.alias("at")))
    met = ends.drop("w").join(sums, "part")
    alone = F.pow(F.greatest("c", F.lit(1)).cast("double"), F.lit(-0.5))
    row = lambda df, kind, name, ref, height, n: df.select(F.lit(kind).alias("kind"), name.alias("name"), ref.cast("string").alias("ref"), height.alias("lambda"), n.alias("n"))
    v, n, now, height = F.col("v"), F.col("n"), F.col("now"), F.col("at")
    point = met.where("own = v")
    small = met.where("own is null")
    part = F.concat(F.lit("part "), "part")
    return (
        row(point, "add", v, F.lit(None), alone, n)
        .union(row(point, "member", v, v, alone, n))
        .union(row(met.where("own is not null and big > 1"), "node", F.col("own"), now, height, n))
        .union(row(sums.where("now is not null"), "add", now, F.lit(None), height, F.when(F.col("big") == 1, F.col("small")).otherwise(F.col("total"))))
        .union(row(small, "member", v, F.coalesce(now, part), F.when(now.isNotNull(), height).otherwise(F.lit(0.0)), n))
        .union(row(sums.where("now is not null"), "top", part, now, F.lit(0.0), F.col("total")))
    )


def _parts(edges: DataFrame, bound: int) -> DataFrame:
    """edges with ``part`` and ``level``: cut by weight until a part has no more than ``bound``, or, if level, its edges all weigh the same.

    The lighter half of a part falls into components; each is a part of its own
    and a vertex of the heavier half.
    """
    level = 0
    edges = written(edges.withColumn("part", F.lit("r")))
    while True:
        stats = edges.groupBy("part").agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.percentile_approx("w", 0.5).alias("mid"))
        cuts = written(stats.where((F.col("n") > bound) & (F.col("lo") < F.col("hi"))).select("part", F.when(F.col("mid") < F.col("hi"), F.col("mid") + 1).otherwise(F.col("hi")).alias("cut")))
        if cuts.isEmpty():
            large = stats.where(F.col("n") > bound).select("part", F.lit(True).alias("level"))
            return written(edges.join(F.broadcast(large), "part", "left").withColumn("level", F.coalesce("level", F.lit(False))))
        level += 1
        cut = edges.join(F.broadcast(cuts), "part", "left")
        light, rest = cut.where("w < cut").drop("cut"), cut.where("cut is null or w >= cut").drop("cut")
        of = written(_components(light))
        sizes = light.select(F.col("a").alias("node"), F.col("na").alias("n")).union(light.select("b", "nb")).distinct().join(of, "node").groupBy("root").agg(F.sum("n").alias("n"))
        whole = written(of.join(sizes, "root").select("node", "root", "n"))
        name = F.concat(F.lit(f"{level}."), F.col("root"))
        inner = light.join(whole.select(F.col("node").alias("a"), "root"), "a").withColumn("part", name).drop("root")
        for end in ("a", "b"):
            here = whole.select(F.col("node").alias(end), F.concat(F.lit("part "), name).alias("to"), F.col("n").alias("whole"))
            # the core of a vertex that is a part is never asked for
            rest = rest.join(here, end, "left").withColumns({end: F.coalesce("to", end), f"n{end}": F.coalesce("whole", f"n{end}"), f"c{end}": F.when(F.col("to").isNull(), F.col(f"c{end}"))}).drop("to", "whole")
        # dealt anew, or the partitions of both would add up from level to level
        edges = written(inner.unionByName(rest).repartition("a", "b"))


def condensed_tree(edges: DataFrame, least: int, bound: int = PART) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of a spanning tree (a, b, w, na, nb, ca, cb) whose clusters have at least ``least`` rows.

    clusters: name, parent (null for the root), birth (lambda at which it parts
    from its parent), n, stability. members: vertex, cluster, lambda at which it
    leaves it; vertices of no cluster are left out. lambda is 1 / distance.
    """
    parts = _parts(edges, bound)
    rows = parts.where("not level").drop("level").groupBy("part").applyInArrow(lambda t: _condense(t, least), _PIECES)
    rows = written(rows.union(_condense_level(parts.where("level"), least)).repartition("name"))
    tops = rows.where("kind = 'top'").select(F.concat(F.lit("top "), "name").alias("node"), F.col("ref").alias("up"))
    names = _jump(tops) if not tops.isEmpty() else tops.select("node", F.col("up").alias("root"))
    named = lambda df, c: df.join(names.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    nodes = named(named(rows.where("kind = 'node'").select("name", F.col("ref").alias("parent"), F.col("lambda").alias("birth"), "n"), "name"), "parent")
    added = named(rows.where("kind = 'add'").select("name", (F.col("n") * F.col("lambda")).alias("mass"), (F.col("n")).alias("m")), "name").groupBy("name").agg(F.sum("mass").alias("mass"), F.sum("m").alias("m"))
    born = written(added.join(nodes, "name", "left").select("name", "parent", F.coalesce("birth", F.lit(0.0)).alias("birth"), F.coalesce("n", "m").alias("n"), F.col("mass")))
    clusters = born.select("name", "parent", "birth", "n", (F.col("mass") - F.col("n") * F.col("birth")).alias("stability"))
    held = rows.where("kind = 'member'").select(F.col("name").alias("vertex"), F.col("ref").alias("cluster"), "lambda")
    while True:
        inner = held.where(F.col("cluster").startswith("part "))
        if inner.isEmpty():
            break
        up = held.where(F.col("vertex").startswith("part ")).select(F.col("vertex").alias("cluster"), F.col("cluster").alias("to"), F.col("lambda").alias("at"))
        # what no vertex stands for any more is a row of the root that never was in a cluster
        held = written(held.join(up, "cluster", "left").where(~F.col("cluster").startswith("part ") | F.col("to").isNotNull()).select("vertex", F.coalesce("to", "cluster").alias("cluster"), F.coalesce("at", "lambda").alias("lambda")))
    return written(clusters), written(named(held, "cluster").where(~F.col("vertex").startswith("part ")))


def _tree(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, list[int], list[list[int]], list[int]]:
    """The clusters that batches hold, the place of each one's parent (-1 for none), those of its children, and all places, parents first and a cluster's own together."""
    rows = pa.Table.from_batches(list(batches))
    at = {name: i for i, name in enumerate(rows["name"].to_pylist())}
    parents = [-1 if p is None else at[p] for p in rows["parent"].to_pylist()]
    children: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
    order, open_ = [], [i for i, p in enumerate(parents) if p < 0]
    while open_:
        order.append(open_.pop())
        open_ += children[order[-1]]
    return rows, parents, children, order


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``select_clusters``, of all clusters in one task."""
    rows, parents, children, order = _tree(batches)
    stability, below = rows["stability"].to_pylist(), [0.0] * len(order)
    for i in reversed(order):
        if parents[i] >= 0:
            below[parents[i]] += max(stability[i], below[i])
    topic: list[int | None] = [None] * len(order)
    for i in order:
        if parents[i] >= 0:
            above = topic[parents[i]]
            topic[i] = above if above is not None else i if stability[i] >= below[i] else None
    some = [i for i in order if topic[i] is not None]
    names = rows["name"].combine_chunks()
    yield pa.record_batch([names.take(pa.array(some, pa.int64())), names.take(pa.array([topic[i] for i in some], pa.int64()))], ["name", "topic"])


def _meet(batches: Iterator[pa.RecordBatch], piece: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """(name, topic, parts) of each cluster and each topic below the same child of the root: the birth of the cluster below the last one that holds both, null if one holds the other.

    batches: name, parent, birth, topic (is it one), of all clusters.
    """
    rows, parents, children, order = _tree(batches)
    order = np.array(order, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    size = np.ones(len(order), np.int64)
    for i in order[::-1].tolist():
        if parents[i] >= 0:
            size[parents[i]] += size[i]
    names, birth = rows["name"].combine_chunks(), rows["birth"].to_numpy()
    topics = order[rows["topic"].to_numpy(zero_copy_only=False)[order]]
    starts = np.searchsorted(place[topics], place)
    ends = np.searchsorted(place[topics], place + size)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        for i in order.tolist():
            of = topics[starts[i] : ends[i]]
            if parents[i] < 0 or not len(of):
                continue
            if of[0] == i:
                yield order[place[i] : place[i] + size[i]], of, np.nan
                continue
            yield np.array([i]), of, np.nan
            for c in children[i]:
                others = np.concatenate((topics[starts[i] : starts[c]], topics[ends[c] : ends[i]]))
                inside = order[place[c] : place[c] + size[c]]
                step = max(1, piece // max(1, len(others)))
                for k in range(0, len(inside) if len(others) else 0, step):
                    yield inside[k : k + step], others, birth[c]

    def batch(held: list[tuple[np.ndarray, np.ndarray, float]]) -> pa.RecordBatch:
        a = np.concatenate([np.repeat(x, len(y)) for x, y, _ in held])
        b = np.concatenate([np.tile(y, len(x)) for x, y, _ in held])
        parts = np.repeat([p for *_, p in held], [len(x) * len(y) for x, y, _ in held])
        return pa.record_batch([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(parts, pa.float64(), from_pandas=True)], ["name", "topic", "parts"])

    held, n = [], 0
    for pair in pairs():
        held.append(pair)
        n += len(pair[0]) * len(pair[1])
        if n >= piece:
            yield batch(held)
            held, n = [], 0
    if held:
        yield batch(held)


def _small(clusters: DataFrame, bound: int) -> bool:
    return clusters.count() <= bound


def select_clusters(clusters: DataFrame, bound: int = PART) -> DataFrame:
    """(name, topic): of each cluster the selected one it is in or is; the root and what is above all selected ones are left out.

    From the leaves up, a cluster is chosen over those below it if its
    stability is at least the sum of theirs; of those on a path the topmost
    chosen counts. Up to ``bound`` clusters are looked at in one task.
    """
    if _small(clusters, bound):
        return written(clusters.select("name", "parent", "stability").repartition(1).mapInArrow(_select, "name string, topic string"))
    inner = clusters.where("parent is not null")
    below = inner.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("children"))
    wait = written(inner.join(below, "name", "left").select("name", "parent", "stability", F.coalesce("children", F.lit(0)).alias("children"), F.lit(0.0).alias("sum")))
    known = None
    while True:
        done = F.col("children") == 0
        ready = wait.where(done).select("name", "parent", F.greatest("stability", "sum").alias("best"), (F.col("stability") >= F.col("sum")).alias("chosen"))
        known = ready if known is None else known.union(ready)
        sums = ready.groupBy(F.col("parent").alias("name")).agg(F.sum("best").alias("more"), F.count("*").alias("have"))
        wait = written(wait.where(~done).join(sums, "name", "left").select("name", "parent", "stability", (F.col("children") - F.coalesce("have", F.lit(0))).alias("children"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum")))
        if wait.isEmpty():
            break
    known = written(known)
    within = known.select("name")
    up = known.join(within.select(F.col("name").alias("parent"), F.col("name").alias("up")), "parent", "left")
    state = written(up.select("name", "up", F.when(F.col("chosen"), F.col("name")).alias("topic")))
    while not state.where("up is not null").isEmpty():
        further = state.select(F.col("name").alias("up"), F.col("up").alias("next"), F.col("topic").alias("above"))
        state = written(state.join(further, "up", "left").select("name", F.col("next").alias("up"), F.coalesce("above", "topic").alias("topic")))
    return state.where("topic is not null").select("name", "topic")


def cluster(vectors: DataFrame, key: str, vector: str, least: int = 5, neighbours: int | None = None, tile: int = TILE, part: int = PART) -> DataFrame:
    """(key, topic_id, membership): each row's share in each topic, -1 for none; the shares of a row are 1 together.

    Topics are the selected clusters of the condensed tree, numbered from 0 by
    falling size, then by their least key. A row is in a topic as far as it
    stays with it: lambda at which the two part over the largest in the topic,
    1 at most; those that part at the root share nothing. The largest of these
    is what the row shares out, in proportion to them; the rest is -1.
    Vectors that are null or not finite have -1 alone; shorter ones end in
    zeros. ``neighbours`` (``least`` by default) is how many give the core
    distance. An empty table gives an empty one.
    """
    neighbours = neighbours or least
    usable, width = _steps(vectors.select(key, vector), vector)
    usable = written(usable.select(key, "steps"))
    distinct = usable.groupBy("steps").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    points = written(numbered(distinct, [F.col("first"), F.col("steps")], "idx").withColumn("tile", F.floor(F.col("idx") / tile).cast("int")))
    every = vectors.select(key)
    points = written(points.join(core_distances(points, width, neighbours), "idx"))
    tree = spanning_tree(points, width)
    of = points.select(F.concat(F.lit("point "), F.col("idx")).alias("v"), "n", "core")
    edges = written(tree).select(F.concat(F.lit("point "), "a").alias("a"), F.concat(F.lit("point "), "b").alias("b"), "w")
    for end in ("a", "b"):
        edges = edges.join(of.select(F.col("v").alias(end), F.col("n").alias(f"n{end}"), F.col("core").alias(f"c{end}")), end)
    edges = written(edges)
    if edges.isEmpty():
        return every.select(key, F.lit(-1).cast("bigint").alias("topic_id"), F.lit(1.0).alias("membership"))
    clusters, members = condensed_tree(edges, least, part)
    shares = _shares(clusters, members, select_clusters(clusters, part), points, part)
    rows = written(usable.join(points.select("steps", F.concat(F.lit("point "), F.col("idx")).alias("vertex")), "steps").join(shares, "vertex").select(key, "topic_id", "membership"))
    outside = rows.groupBy(key).agg(F.sum("membership").alias("in"))
    rest = every.join(outside, key, "left").select(key, F.lit(-1).cast("bigint").alias("topic_id"), F.greatest(1 - F.coalesce("in", F.lit(0.0)), F.lit(0.0)).alias("membership"))
    return rows.union(rest.where("membership > 1e-12"))


def _shares(clusters: DataFrame, members: DataFrame, topics: DataFrame, points: DataFrame, bound: int = PART) -> DataFrame:
    """(vertex, topic_id, membership) of the topics in which a vertex has a share."""
    heights = members.join(topics.withColumnRenamed("name", "cluster"), "cluster").groupBy("topic").agg(F.max("lambda").alias("peak"), F.min(F.substring("vertex", 7, 20).cast("bigint")).alias("least"))
    sized = heights.join(clusters.select(F.col("name").alias("topic"), F.col("n")), "topic")
    named = written(numbered(sized, [F.desc("n"), F.asc("least")], "topic_id").select("topic", "topic_id", "peak"))
    met = written(_met_at_once(clusters, named) if _small(clusters, bound) else _met_by_level(clusters, named))
    raw = written(members.join(met.withColumnRenamed("name", "cluster"), "cluster").select("vertex", "topic_id", F.least(F.lit(1.0), F.coalesce("parts", "lambda") / F.col("peak")).alias("raw")))
    sums = raw.groupBy("vertex").agg(F.sum("raw").alias("sum"), F.max("raw").alias("most"))
    return raw.join(sums, "vertex").select("vertex", "topic_id", (F.col("raw") / F.col("sum") * F.col("most")).alias("membership"))


def _met_at_once(clusters: DataFrame, named: DataFrame) -> DataFrame:
    """As ``_met_by_level``, in one task."""
    marked = clusters.select("name", "parent", "birth").join(named.select(F.col("topic").alias("name"), F.lit(True).alias("topic")), "name", "left")
    pairs = marked.withColumn("topic", F.coalesce("topic", F.lit(False))).repartition(1).mapInArrow(_meet, "name string, topic string, parts double")
    return pairs.join(named, "topic").select("name", "topic_id", "peak", "parts")


def _met_by_level(clusters: DataFrame, named: DataFrame) -> DataFrame:
    """(name, topic_id, peak, parts): each cluster with the topics that share something above it below the root, and where it parts from them, null if one holds the other."""
    # all clusters below the root above each cluster, itself included, and where the path to it parts from them
    parents = clusters.where("parent is not null").select("name", "parent", "birth")
    below_root = parents.join(clusters.where("parent is null").select(F.col("name").alias("parent")), "parent", "left_anti")
    paths = step = written(parents.select("name", F.col("name").alias("above"), F.lit(None).cast("double").alias("parts"), F.lit(0).alias("far")))
    while True:
        step = written(step.join(below_root.select(F.col("name").alias("above"), F.col("parent").alias("next"), "birth"), "above").select("name", F.col("next").alias("above"), F.col("birth").alias("parts"), (F.col("far") + 1).alias("far")))
        if step.isEmpty():
            break
        paths = paths.union(step)
    to = paths.join(named, paths["name"] == named["topic"]).select("above", "topic", "topic_id", "peak")
    within = F.col("above") == F.col("topic")  # a row of the topic itself stays until it leaves the last of its clusters
    return paths.join(to, "above").groupBy("name", "topic_id", "peak").agg(F.min_by(F.when(~within, F.col("parts")), "far").alias("parts"))
