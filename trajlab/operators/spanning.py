"""Least spanning forests of all clouds at once, as tables of edges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlab.operators.blocks import BLOCK, Halves, Side, below, distances, meet, meet_blocks, n_blocks, range_of
from trajlab.operators.graph import WHOLE, checkpointed, joined_ends, parted

#: edges of a known forest up to which one task orders a cloud's points by its merges; larger clouds go without
ORDERED = 2_000_000
#: survivors that a task keeps before it reduces them to a forest
PENDING = 200_000


def _prim(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and weights of a least spanning forest of a dense graph; an infinite weight is no edge."""
    n = len(w)
    near, source, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    ends, at = [], 0
    for _ in range(n):
        left[at] = False
        closer = left & (w[at] < near)
        near[closer], source[closer] = w[at][closer], at
        if not left.any():
            break
        away = np.where(left, near, np.inf)
        at = int(np.argmin(away))
        if away[at] < np.inf:
            ends.append((source[at], at))
        else:
            at = int(np.flatnonzero(left)[0])  # another tree begins
    u, v = np.array(ends, int).reshape(-1, 2).T
    return u, v, w[u, v]


def _dense(v: np.ndarray, core: np.ndarray | None, radius: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = distances(v, v)
    if core is not None:
        w = np.maximum(np.maximum(core[:, None], core[None, :]), w)
    if radius is not None:
        w[w > radius] = np.inf
    np.fill_diagonal(w, np.inf)
    return _prim(w)


def _forest(a: Side, b: Side | None, radius: float | None) -> dict[str, np.ndarray | pa.Array]:
    side = a if b is None else {k: pa.concat_arrays([a[k], b[k]]) if k == "id" else np.concatenate([a[k], b[k]]) for k in a}
    u, v, w = _dense(side["v"], side.get("core"), radius)
    return {"u": side["id"].take(pa.array(u)), "v": side["id"].take(pa.array(v)), "w": w}


def block_edges(points: DataFrame, key: list[str], fields: list[str] | None = None, radius: float | None = None, block: int = BLOCK, decimals: int | None = None) -> DataFrame:
    """(key, u, v, w), u < v: a least spanning forest of each two blocks of a cloud, over pairs up to radius. As
    many edges as connect what all such pairs connect, at the radius and at every smaller one, and all edges of
    a least spanning forest of the cloud among them. With the field `core` w is the mutual reachability,
    max(core u, core v, distance). decimals: w rounded."""
    kind = points.schema["id"].dataType.simpleString()
    found = meet(points, key, lambda a, b: _forest(a, b, radius), f"u {kind}, v {kind}, w double", fields, block)
    w = F.col("w") if decimals is None else F.round("w", decimals)
    return found.select(*key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), w.alias("w")).distinct()


def _roots(parents: DataFrame, key: list[str]) -> DataFrame:
    """(key, c, root) of (key, c, to), where following `to` ends at a node that is its own: paths halve each round."""
    while True:
        onward = parents.select(*key, F.col("c").alias("to"), F.col("to").alias("beyond"))
        parents = checkpointed(parents.join(onward, [*key, "to"]).select(*key, "c", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")))
        if parents.where("moved").isEmpty():
            return parents.select(*key, "c", F.col("to").alias("root"))
        parents = parents.drop("moved")


def _kruskal(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The forest's edges of one cloud's (a, b, w, u, v), by rising weight."""
    table = table.sort_by([("w", "ascending"), ("u", "ascending"), ("v", "ascending")])
    took = table.take(pa.array(joined_ends(table.column("a").to_pylist(), table.column("b").to_pylist()), pa.int64()))
    return took.drop_columns(["a", "b"])


def least_forest(edges: DataFrame, key: list[str], most: int = WHOLE) -> DataFrame:
    """(key, u, v, w): a least spanning forest of each cloud's edges (key, u, v, w); equal weights are told apart by
    their ends. The edges of the forest in order of w are the merges of single linkage.

    Clouds of over `most` edges go through Boruvka's rounds, all at once: a round takes each component's least
    edge, summed in part where the edges are, merges what these connect, and leaves the least edge between any
    two components. What has come down to `most` edges is finished in one task for each cloud."""
    kind = T.StructType([*(edges.schema[c] for c in key), *(T.StructField(c, edges.schema[c].dataType) for c in ("w", "u", "v"))])
    left = checkpointed(edges.select(*key, F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"))
    taken = None
    while True:
        few, left = parted(left, key, most)
        now = few.groupBy(*key).applyInArrow(_kruskal, kind).select(*key, "u", "v", "w")
        taken = now if taken is None else taken.unionByName(now)
        if left.isEmpty():
            return taken
        e = F.struct("w", "u", "v").alias("e")
        ends = left.select(*key, F.col("a").alias("c"), F.struct(e, F.col("b").alias("to")).alias("m")).unionByName(left.select(*key, F.col("b").alias("c"), F.struct(e, F.col("a").alias("to")).alias("m")))
        least = checkpointed(ends.groupBy(*key, "c").agg(F.min("m").alias("m")).select(*key, "c", "m.e", "m.to"))
        taken = checkpointed(taken.unionByName(least.select(*key, "e.u", "e.v", "e.w").distinct()))
        # two components that choose each other share their edge; the lesser is the root of what hangs on both
        back = least.select(*key, F.col("c").alias("to"), F.col("to").alias("back"))
        parents = least.join(back, [*key, "to"]).select(*key, "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        roots = _roots(parents, key)
        for end in ("a", "b"):
            left = left.join(roots.withColumnRenamed("c", end), [*key, end]).drop(end).withColumnRenamed("root", end)
        apart = left.where("a <> b").groupBy(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = checkpointed(apart.agg(F.min(e).alias("e")).select(*key, "a", "b", "e.w", "e.u", "e.v"))


def merge_order(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points 0 to n - 1 in an order, and the gap behind each, so that the widest gap between two is the greatest
    weight on the path of the edges (u, v, w) between them; infinite where there is no path."""
    root, first, last, behind, gap = list(range(n)), list(range(n)), list(range(n)), [-1] * n, [np.inf] * n

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = np.argsort(w, kind="stable")
    for a, b, x in zip(u[at].tolist(), v[at].tolist(), w[at].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            behind[last[a]], gap[last[a]] = first[b], x
            root[b], last[a] = a, last[b]
    order = []
    for x in range(n):
        if root[x] == x:
            y = first[x]
            while y >= 0:
                order.append(y)
                y = behind[y]
    order = np.array(order, int)
    return order, np.array(gap)[order]


def _placed(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ends = pa.concat_arrays([c for name in ("u", "v") for c in table.column(name).chunks]).dictionary_encode()
    at, n = ends.indices.to_numpy(), len(ends.dictionary)
    order, gap = merge_order(at[: len(table)], at[len(table) :], table.column("w").to_numpy(), n)
    own = [pa.array([k.as_py()] * n, k.type) for k in keys]
    return pa.table([*own, ends.dictionary.take(pa.array(order)), pa.array(np.arange(n)), pa.array(gap)], [*table.schema.names[: len(keys)], "id", "_place", "_gap"])


def _in_place(side: Side) -> Side:
    at = np.argsort(side["_place"], kind="stable")
    return {k: x.take(pa.array(at)) if isinstance(x, pa.Array) else x[at] for k, x in side.items()}


def _upto(gaps: np.ndarray) -> np.ndarray:
    """The widest gap from the first point to each."""
    return np.maximum.accumulate(np.concatenate([[0.0], gaps[:-1]]))


def _shorter(radius: float | None, decimals: int | None, tops: dict[tuple, list[float]], block: int):
    """Pairs of two blocks that are nearer than the known forest's path between them, reduced to a forest of theirs."""
    most = np.inf if radius is None else radius

    def reduced(found: list) -> list:
        u, v, w = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.argsort(w, kind="stable")
        at = at[joined_ends(u[at].tolist(), v[at].tolist())]
        return [(u[at], v[at], w[at])]

    def step(keys: tuple, i: int, j: int, a: Side, b: Side | None) -> dict[str, np.ndarray | pa.Array]:
        sides = [_in_place(s) for s in ([a] if b is None else [a, b])]
        one, two = sides[0], sides[-1]
        n = len(one["v"])
        # of both blocks' points, one behind the other; gaps of the blocks between them are in the last of the first
        ids = pa.concat_arrays([s["id"] for s in sides])
        gaps = np.concatenate([s["_gap"] for s in sides])
        if b is not None:
            gaps[n - 1] = max([gaps[n - 1], *tops.get(keys, [])[i + 1 : j]])
        v = [s["v"] for s in sides]
        core = np.concatenate([s["core"] for s in sides]) if "core" in one else None
        h, shift = Halves(one["v"], two["v"]), 0 if b is None else n
        found, pending = [(np.empty(0, int), np.empty(0, int), np.empty(0))], 0

        def rough(x: np.ndarray) -> np.ndarray:
            return (np.minimum(x, most) ** 2 / h.unit * (1 + 1e-6) + 2 * h.slack).astype(np.float32)

        for p in range(0, n, block):
            left = slice(p, min(p + block, n))
            before = np.maximum.accumulate(gaps[left][::-1])[::-1]
            for q in range(p if b is None else 0, len(two["v"]), block):
                right = slice(q + shift, min(q + block, len(two["v"])) + shift)
                lone = left == right
                if lone:
                    m = left.stop - left.start
                    upto = np.maximum.accumulate(np.triu(np.broadcast_to(np.concatenate([[0.0], gaps[left][:-1]]), (m, m)), 1), axis=1)
                    limit = np.where(upto > 0, rough(upto), np.float32(-1))
                else:
                    ahead, behind = np.maximum(before, gaps[left.stop : right.start].max(initial=0.0)), _upto(gaps[right])
                    limit = np.maximum.outer(rough(ahead), rough(behind))
                g = h.tile(p, q, block)
                x, y = below(g, limit)
                if len(x) > g.size // 8:
                    both = np.arange(left.start, left.stop) if lone else np.concatenate([np.arange(left.start, left.stop), np.arange(right.start, right.stop)])
                    points = v[0][left] if lone else np.concatenate([v[0][left], v[-1][q : q + block]])
                    x, y, w = _dense(points, None if core is None else core[both], radius)
                    x, y = both[x], both[y]
                    w = w if decimals is None else np.round(w, decimals)
                else:
                    w = np.sqrt(h.squares(x + p, y + q))
                    path = upto[x, y] if lone else np.maximum(ahead[x], behind[y])
                    x, y = x + left.start, y + right.start
                    w = w if core is None else np.maximum(w, np.maximum(core[x], core[y]))
                    w = w if decimals is None else np.round(w, decimals)
                    at = np.flatnonzero((w < path) & (w <= most))
                    x, y, w = x[at], y[at], w[at]
                found.append((x, y, w))
                pending += len(x)
                if pending > PENDING + 4 * len(ids):
                    found = reduced(found)
                    pending = len(found[0][0])
        [(x, y, w)] = reduced(found)
        return {"u": ids.take(pa.array(x)), "v": ids.take(pa.array(y)), "w": w}

    return step


def tied(points: DataFrame, key: list[str], known: DataFrame, radius: float | None = None, block: int = BLOCK, decimals: int | None = None) -> DataFrame:
    """(key, u, v, w): as block_edges, from edges (key, u, v, w) that are known already, such as those to each
    point's nearest. Points are put in the order of the merges of the known edges' forest, which tells the
    greatest weight on the path between any two; a pair that isn't nearer than that is in no least spanning
    forest. Every pair is looked at, few are left, and a task reduces these to a forest of its own."""
    few, many = parted(checkpointed(least_forest(known, key)), key, ORDERED)
    forest = few.unionByName(many)
    kind = T.StructType([*(points.schema[k] for k in key), points.schema["id"], *T.StructType.fromDDL("_place long, _gap double").fields])
    placed = few.select(*key, "u", "v", "w").groupBy(*key).applyInArrow(_placed, kind)
    fields = [f for f in ("core", "_place", "_gap") if f != "core" or "core" in points.columns]
    ordered = points.join(placed, [*key, "id"], "left").select(*key, "id", "v", *(f for f in fields if f == "core"), F.coalesce("_place", F.lit(0).cast("long")).alias("_place"), F.coalesce("_gap", F.lit(float("inf"))).alias("_gap"))
    if not many.isEmpty():
        # without an order: any numbers, and gaps that leave every pair
        count = F.count("*").over(Window.partitionBy(*key))
        spread = F.when(F.max("_place").over(Window.partitionBy(*key)) == 0, F.pmod(F.xxhash64("id"), count)).otherwise(F.col("_place"))
        ordered = ordered.withColumn("_place", spread)
    ordered = checkpointed(ordered)
    count = F.count("*")
    sizes = ordered.groupBy(*key).agg(n_blocks(count, block).alias("_n"), count.alias("_count")).where("_n > 2")
    own = range_of(F.col("_place"), F.col("_n"), F.col("_count")).cast("int").alias("_own")
    tops: dict[tuple, list[float]] = {}
    for r in ordered.join(sizes, key).groupBy(*key, "_n", own).agg(F.max("_gap").alias("top")).collect():
        # only pairs of three blocks and more have others between them; a block without a point has no gap
        tops.setdefault(tuple(r[c] for c in key), [0.0] * r["_n"])[r["_own"]] = r["top"]
    told = points.schema["id"].dataType.simpleString()
    found = meet_blocks(ordered, key, _shorter(radius, decimals, tops, block), f"u {told}, v {told}, w double", fields, block, "_place")
    w = F.col("w") if decimals is None else F.round("w", decimals)
    return found.select(*key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), w.alias("w")).unionByName(forest.select(*key, "u", "v", "w")).distinct()


def near_edges(near: DataFrame, key: list[str], points: DataFrame, decimals: int | None = None) -> DataFrame:
    """(key, u, v, w), u < v: the edges to each point's nearest (key, id, other, d) among these points (key, id, v),
    with the field `core` by mutual reachability."""
    core = F.col("core") if "core" in points.columns else F.lit(0.0)
    ends = points.select(*key, "id", core.alias("core"))
    both = near.join(ends, [*key, "id"]).join(ends.select(*key, F.col("id").alias("other"), F.col("core").alias("other_core")), [*key, "other"])
    w = F.greatest("d", "core", "other_core")
    return both.select(*key, F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v"), (w if decimals is None else F.round(w, decimals)).alias("w")).distinct()


def spanning_forest(points: DataFrame, key: list[str], near: Callable[[DataFrame], DataFrame], block: int = BLOCK, decimals: int | None = None) -> DataFrame:
    """(key, u, v, w): a least spanning tree of each cloud of points (key, id, v), with the field `core` by mutual
    reachability. A cloud of one tile gives its tree at once; larger ones start from their points' nearest,
    which `near` gives as (key, id, other, d); see tied."""
    fields = ["core"] if "core" in points.columns else []
    large = points.groupBy(*key).count().where(F.col("count") > block).select(*key)
    if large.isEmpty():
        return block_edges(points, key, fields, None, block, decimals)
    small = block_edges(points.join(large, key, "left_anti"), key, fields, None, block, decimals)
    several = checkpointed(points.join(large, key, "left_semi"))
    known = near_edges(near(several), key, several, decimals)
    return small.unionByName(least_forest(tied(several, key, known, None, block, decimals), key))


def quantile_cuts(forest: DataFrame, key: list[str], quantiles: list[float]) -> DataFrame:
    """(key, level, cut): for each quantile in rising order the least weight that at least that share of the
    edges doesn't exceed. Weights are counted by value first, so the ordered pass is over distinct ones."""
    values = forest.groupBy(*key, "w").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    ranked = values.select(*key, "w", F.sum("n").over(w.orderBy("w")).alias("upto"), F.sum("n").over(w).alias("n"))
    cuts = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("n")), F.col("w"))).alias(f"c{i}") for i, q in enumerate(sorted(quantiles))]
    wide = ranked.groupBy(*key).agg(*cuts)
    return wide.select(*key, F.posexplode(F.array(*[f"c{i}" for i in range(len(cuts))])).alias("level", "cut"))
