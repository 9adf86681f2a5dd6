"""Layered density clustering of pooled vectors, model by model; centroids and medoids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlab.operators.blocks import BLOCK, Halves, Side, below, distances, meet_blocks
from trajlab.operators.graph import checkpointed, components
from trajlab.operators.spanning import block_edges, least_forest, near_edges, quantile_cuts, spanning_forest, tied

MIN_SAMPLES = 5
#: fewer vectors of a model have no layer
LEAST = 16
#: shares of a tree's edges that the layers keep, fine to coarse
QUANTILES = [0.25, 0.5, 0.75]
#: lists that a vector is in, and centres of a model at most, which every task gets
PROBES, CENTRES = 8, 8192
#: vectors of a model whose nearest are found by brute force, and the share of these that lists must have; sampled,
#: so above the nine tenths that are asked for
QUERIES, SHARE = 100, 0.95
#: decimals that weights of trees are compared at
DECIMALS = 9


def _under(df: DataFrame, key: list[str] | None) -> tuple[DataFrame, list[str]]:
    """df with a key; without one all rows are one cloud."""
    return (df, key) if key else (df.withColumn("_all", F.lit(0)), ["_all"])


def _in_order(side: Side, by: np.ndarray | pa.Array) -> Side:
    at = pc.sort_indices(by if isinstance(by, pa.Array) else pa.array(by))
    return {k: x.take(at) if isinstance(x, pa.Array) else x[at.to_numpy()] for k, x in side.items()}


def _nearer(g: np.ndarray, far: np.ndarray, other: np.ndarray, first: int, slack: float, unit: float, squares: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Of the rough squared distances g of some points to others, numbered from `first`, put those that are nearer
    than a point's k-th into its k nearest (far, other), by rising distance. Ties stay with the lesser number."""
    k, last = far.shape[1], far[:, -1]
    limit = last / unit + slack
    new = np.flatnonzero(np.isinf(last))
    if len(new) and g.shape[1] > k:
        limit[new] = np.partition(g[new], k - 1, axis=1)[:, k - 1] + 2 * slack
    limit[last == 0] = -np.inf
    i, j = below(g, limit.astype(np.float32))
    d = squares(i, j)
    at = np.flatnonzero(d < last[i])
    i, j, d = i[at], j[at] + first, d[at]
    rows = np.unique(i)
    i, d, j = np.concatenate([i, np.repeat(rows, k)]), np.concatenate([d, far[rows].ravel()]), np.concatenate([j, other[rows].ravel()])
    at = np.lexsort((j, d, i))
    best = at[np.searchsorted(i[at], rows)[:, None] + np.arange(k)]
    far[rows], other[rows] = d[best], j[best]


def _nearest(k: int, block: int):
    def step(_keys: tuple, _i: int, _j: int, a: Side, b: Side | None) -> dict[str, np.ndarray | pa.Array]:
        sides = [_in_order(s, s["id"]) for s in ([a] if b is None else [a, b])]
        one, two = sides[0], sides[-1]
        found = [(np.full((len(s["v"]), k), np.inf), np.full((len(s["v"]), k), -1)) for s in sides]
        h = Halves(one["v"], two["v"])
        for p in range(0, len(h.x), block):
            for q in range(p if b is None else 0, len(h.y), block):
                g = h.tile(p, q, block)
                if b is None and p == q:
                    np.fill_diagonal(g, np.inf)
                _nearer(g, *(f[p : p + block] for f in found[0]), q, h.slack, h.unit, lambda i, j: h.squares(i + p, j + q))
                if b is not None or p < q:
                    _nearer(g.T, *(f[q : q + block] for f in found[-1]), p, h.slack, h.unit, lambda i, j: h.squares(j + p, i + q))
        out = []
        for s, t, (far, other) in zip(sides, sides[::-1], found, strict=True):
            at = np.flatnonzero(other >= 0)
            out.append((s["id"].take(pa.array(at // k)), t["id"].take(pa.array(other.ravel()[at])), np.sqrt(far.ravel()[at])))
        ids, others, far = zip(*out, strict=True)
        return {"id": pa.concat_arrays(ids), "other": pa.concat_arrays(others), "d": np.concatenate(far)}

    return step


def nearest(vectors: DataFrame, k: int, key: list[str] | None = None, block: int = BLOCK, probes: int | None = None) -> DataFrame:
    """(key, id, other, d, rank): the k nearest other vectors of each vector (key, id, v), ties by their id, rank
    from 1. Exact without probes: all of a key meet, by pairs of blocks, and a task gives each row's nearest of
    its blocks; distances in single precision leave out what can't be nearest, the rest are exact. With probes those meet that share one of their `probes` nearest centres (see listed), so what is
    shuffled grows with the vectors."""
    points, key = _under(vectors, key)
    cloud = key if probes is None else [*key, "_list"]
    points = points if probes is None else listed(points, key, probes, block, k)
    kind = points.schema["id"].dataType.simpleString()
    found = meet_blocks(points, cloud, _nearest(k, block), f"id {kind}, other {kind}, d double", block=block if probes is None else 4 * BLOCK)
    if probes is not None:
        found = found.groupBy(*key, "id", "other").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy(*key, "id").orderBy("d", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*[c for c in key if c != "_all"], "id", "other", "d", "rank")


def _sampled(vectors: DataFrame, key: list[str], k: int) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """For each key some vectors, those with the least hashes, each as often as it has a nearest, and these."""
    w = Window.partitionBy(*key).orderBy(F.xxhash64("id"), "id")
    asked: dict[tuple, list] = {}
    sizes = vectors.groupBy(*key).agg(F.count("*").alias("_count"))
    h = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30))
    some = vectors.join(sizes, key).where(h <= 4.0 * QUERIES / F.col("_count") * (1 << 30))
    for r in some.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= QUERIES).select(*key, "id", "v").collect():
        asked.setdefault(tuple(r[c] for c in key), []).append((r["id"], r["v"]))
    sent = vectors.sparkSession.sparkContext.broadcast({x: ([i for i, _ in y], np.array([v for _, v in y])) for x, y in asked.items()})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            for one in dict.fromkeys(keys):
                if one not in sent.value:
                    continue
                ids, mine = sent.value[one]
                own = batch.take(pa.array([i for i, x in enumerate(keys) if x == one]))
                d = distances(mine, own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1))
                place = {x: i for i, x in enumerate(own.column("id").to_pylist())}
                for q, x in enumerate(ids):
                    if x in place:
                        d[q, place[x]] = np.inf
                n = min(k, d.shape[1])
                best = np.argpartition(d, n - 1, axis=1)[:, :n]
                rows = own.select([*key, "id", "v"]).take(pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.repeat(np.arange(len(ids)), n)), pa.array(np.take_along_axis(d, best, 1).ravel())], [*key, "id", "v", "_q", "_d"])

    fields = [vectors.schema[c] for c in [*key, "id", "v"]]
    found = vectors.select(*key, "id", "v").mapInArrow(near, T.StructType([*fields, T.StructField("_q", T.LongType()), T.StructField("_d", T.DoubleType())]))
    rank = F.row_number().over(Window.partitionBy(*key, "_q").orderBy("_d", "id"))
    pairs: dict[tuple, list] = {}
    for r in found.where(F.col("_d") < float("inf")).withColumn("_k", rank).where(F.col("_k") <= k).collect():
        one = tuple(r[c] for c in key)
        pairs.setdefault(one, []).append((sent.value[one][1][r["_q"]], r["v"]))
    return {one: (np.array([a for a, _ in x]), np.array([b for _, b in x])) for one, x in pairs.items()}


def enough(centres: np.ndarray, ones: np.ndarray, others: np.ndarray, probes: int) -> int:
    """The least of probes, twice as many and so on, at which SHARE of the pairs have a nearest centre in common;
    with all centres all have."""
    a, b = (np.argsort(np.argsort(distances(x, centres), axis=1), axis=1) for x in (ones, others))
    both = np.maximum(a, b).min(axis=1)
    while probes < len(centres) and (both < probes).mean() < SHARE:
        probes *= 2
    return probes


def listed(vectors: DataFrame, key: list[str], probes: int = PROBES, block: int = BLOCK, k: int = MIN_SAMPLES) -> DataFrame:
    """vectors with `_list`, `probes` rows each: its nearest centres. Where a sample of a key's vectors, whose k
    nearest are found by brute force, shares too few lists with these, its vectors are in more; see enough. Centres are vectors of the key, those with
    the least hashes of their id, as many as make a list about a block long, CENTRES at most. Lists that are
    longer, where a key has many vectors or a centre a crowd, meet block by block."""
    sizes = vectors.groupBy(*key).count().withColumn("n_centres", F.least(F.lit(CENTRES), F.ceil(F.col("count") * probes / block)))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # hashes below a share that leaves about four times the centres, then the least of them
    some = vectors.join(sizes, key).where(h <= F.col("n_centres") * 4 / F.col("count") * (1 << 30))
    w = Window.partitionBy(*key).orderBy(h, "id")
    drawn = some.withColumn("_k", F.row_number().over(w)).where("_k <= n_centres").select(*key, "_k", "v").collect()
    centres: dict[tuple, list] = {}
    for r in sorted(drawn, key=lambda r: r["_k"]):
        centres.setdefault(tuple(r[c] for c in key), []).append(r["v"])
    pairs = _sampled(vectors, key, k)
    asked = {}
    for one, x in centres.items():
        x = np.array(x)
        asked[one] = (x, enough(x, *pairs[one], probes) if one in pairs else probes)
    sent = vectors.sparkSession.sparkContext.broadcast(asked)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            for one in dict.fromkeys(keys):
                at = np.array([i for i, x in enumerate(keys) if x == one])
                own, (mine, most) = batch.take(pa.array(at)), sent.value[one]
                for a in range(0, own.num_rows, 512):
                    part = own.slice(a, 512)
                    d = distances(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), mine)
                    n = min(most, d.shape[1])
                    lists = np.argpartition(d, n - 1, axis=1)[:, :n]
                    rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lists.ravel().astype(np.int32))], [*rows.schema.names, "_list"])

    return vectors.mapInArrow(probed, T.StructType([*vectors.schema.fields, T.StructField("_list", T.IntegerType())]))


def core_distances(vectors: DataFrame, min_samples: int = MIN_SAMPLES, block: int = BLOCK, key: list[str] | None = None, probes: int | None = None) -> DataFrame:
    """(key, id, core): distance to the min_samples-th nearest other vector of the key, exact without probes."""
    return cores_of(nearest(vectors, min_samples, key, block, probes), min_samples, key)


def cores_of(near: DataFrame, min_samples: int = MIN_SAMPLES, key: list[str] | None = None) -> DataFrame:
    """(key, id, core) of what nearest gives."""
    return near.where(F.col("rank") == min_samples).select(*(key or []), "id", F.col("d").alias("core"))


def reachability_edges(vectors: DataFrame, cores: DataFrame, radius: float, block: int = BLOCK, near: DataFrame | None = None) -> DataFrame:
    """(u, v, w), u < v: pairs whose mutual reachability, max(core u, core v, distance), is up to radius, as
    many as connect what all such pairs connect, at the radius and at every smaller one. near: some of each
    vector's nearest, as nearest gives them; without it they are found first."""
    reachable, key = _under(vectors.join(cores.where(F.col("core") <= radius), "id").select("id", "v", "core"), None)
    reachable = checkpointed(reachable)
    near = (nearest(reachable.select("id", "v"), MIN_SAMPLES, block=block) if near is None else near).withColumn("_all", F.lit(0))
    known = near_edges(near, key, reachable).where(F.col("w") <= radius)
    return tied(reachable, key, known, radius, block).drop("_all")


def merges(vectors: DataFrame, key: list[str] | None = None, min_samples: int = MIN_SAMPLES, block: int = BLOCK, exact: int | None = None, probes: int = PROBES) -> DataFrame:
    """(key, u, v, w): the least spanning tree of each key's vectors by mutual reachability; in order of w its
    edges are the merges of the density hierarchy. All vectors of a key meet all, however many there are. Only a
    caller that gives `exact` has keys with more vectors than that as a forest of the pairs that share a list of
    centres; see listed_merges."""
    points, inner = _under(vectors, key)
    if exact is None:
        return checkpointed(_tree(points, inner, min_samples, block)).drop("_all")
    large = points.groupBy(*inner).count().where(F.col("count") > exact).select(*inner)
    few, many = _tree(points.join(large, inner, "left_anti"), inner, min_samples, block), listed_merges(points.join(large, inner, "left_semi"), inner, min_samples, block, probes)
    return checkpointed(few.unionByName(many)).drop("_all")


def _reaching(points: DataFrame, near: DataFrame, key: list[str], min_samples: int) -> DataFrame:
    return checkpointed(points.join(cores_of(near, min_samples, key), [*key, "id"]))


def _tree(points: DataFrame, key: list[str], min_samples: int, block: int) -> DataFrame:
    near = checkpointed(nearest(points, min_samples, key, block))
    reach = _reaching(points, near, key, min_samples)
    return spanning_forest(reach, key, lambda large: near.join(large.select(*key).distinct(), key, "left_semi"), block, DECIMALS)


def listed_merges(points: DataFrame, key: list[str], min_samples: int = MIN_SAMPLES, block: int = BLOCK, probes: int = PROBES) -> DataFrame:
    """(key, u, v, w): as merges, but approximate: a least spanning forest of the pairs that share a list of centres,
    with the distances to approximate neighbours. Vectors that lists leave apart stay apart. No query has it."""
    reach = _reaching(points, nearest(points, min_samples, key, block, probes), key, min_samples)
    near = block_edges(listed(reach, key, probes, block), [*key, "_list"], ["core"], None, block, DECIMALS)
    return least_forest(near.select(*key, "u", "v", "w").distinct(), key)


def least_size(n: int) -> int:
    return max(5, int(0.001 * n))


def layers(vectors: DataFrame, edges: DataFrame, cuts: DataFrame, key: list[str], least: int = LEAST) -> DataFrame:
    """(key, id, layer, cluster): for each cut (key, level, cut), fine to coarse, the components of vectors that
    edges (key, u, v, w) up to it connect. A component of fewer than max(5, 0.001 n) is outliers (null); a level
    without a cluster goes, the others are numbered from 0; a cluster's label is its least id. A key with fewer
    than `least` vectors has no layer."""
    ids = vectors.select(*key, "id")
    sizes = ids.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    linked = edges.join(cuts, key).where("w <= cut").select(*key, "level", "u", "v")
    nodes = linked.select(*key, "level", "u").unionByName(linked.select(*key, "level", F.col("v").alias("u"))).distinct()
    labels = components(linked, nodes, [*key, "level"])
    counts = labels.groupBy(*key, "level", "label").agg(F.count("*").alias("size")).join(sizes, key)
    big = counts.where(F.col("size") >= F.greatest(F.lit(5), F.floor(F.col("n") * 0.001))).select(*key, "level", "label")
    number = (F.row_number().over(Window.partitionBy(*key).orderBy("level")) - 1).alias("layer")
    shown = big.select(*key, "level").distinct().select(*key, "level", number)
    kept = labels.join(big, [*key, "level", "label"]).select(*key, "level", F.col("u").alias("id"), F.col("label").alias("cluster"))
    return ids.join(shown, key).join(kept, [*key, "level", "id"], "left").select(*key, "id", "layer", "cluster")


def density_layers(vectors: DataFrame, thresholds: list[float], min_samples: int = MIN_SAMPLES, least: int = LEAST) -> DataFrame:
    """(id, layer, cluster): layers of vectors (id, v) at thresholds that are given; see layers."""
    points, key = _under(vectors, None)
    near = checkpointed(nearest(vectors, min_samples))
    edges = checkpointed(reachability_edges(vectors, cores_of(near, min_samples), max(thresholds), near=near)).withColumn("_all", F.lit(0))
    cuts = edges.select("_all").limit(1).select("_all", F.posexplode(F.lit(sorted(map(float, thresholds)))).alias("level", "cut"))
    return layers(points, edges, cuts, key, least).drop("_all")


def clusterings(vectors: DataFrame, key: list[str], quantiles: list[float] | None = None, min_samples: int = MIN_SAMPLES, least: int = LEAST, **more: int) -> DataFrame:
    """(key, id, layer, cluster): layers of every key's vectors (key, id, v), cut at quantiles of its own tree's
    weights, in one pass for all keys; see merges and layers."""
    edges = merges(vectors, key, min_samples, **more)
    return layers(vectors, edges, quantile_cuts(edges, key, quantiles or QUANTILES), key, least)


def clustering_tables(found: DataFrame, vectors: DataFrame, algorithm: str, parameters: dict[str, str], at: Column) -> dict[str, DataFrame]:
    """clustering_results and embedding_clusters of layers (embedding_model, id, layer, cluster) over vectors
    (embedding_model, id, v): a row for each model and layer, and one for each vector in each layer with its
    cluster's medoid, null for an outlier. _model tags an assignment with its clustering's model."""
    key = ["embedding_model", "layer"]
    runs = found.select(*key).distinct().select(F.concat_ws("-", F.lit(algorithm), *key).alias("id"), "embedding_model", F.lit(algorithm).alias("algorithm"), F.create_map(*[F.lit(x) for p in parameters.items() for x in p]).alias("parameters"), F.col("layer").cast("long").alias("layer"), at.alias("started_at"), at.alias("completed_at"), at.alias("inserted_at"), at.alias("updated_at"))
    members = found.where("cluster is not null").join(vectors, ["embedding_model", "id"])
    centre = medoids(members, [*key, "cluster"])
    own = found.join(centre, [*key, "cluster"], "left")
    run = F.concat_ws("-", F.lit(algorithm), *key)
    assigned = own.select(F.concat_ws("-", run, "id").alias("id"), F.col("id").cast("string").alias("embedding_id"), run.alias("clustering_result_id"), F.col("medoid").cast("string").alias("medoid_embedding_id"), at.alias("inserted_at"), at.alias("updated_at"), F.col("embedding_model").alias("_model"))
    return {"clustering_results": runs, "embedding_clusters": assigned}


def centroids(assigned: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, centroid): element-wise mean of the members' vectors (key, id, v), in long form."""
    return assigned.select(*key, F.posexplode("v").alias("i", "x")).groupBy(*key, "i").agg(F.avg("x").alias("centroid"))


def mean_pooled(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, x): element-wise mean of a group's vectors (key, v) that aren't zero, NaN taken as 0; a group
    of zero vectors alone gives zeros."""
    x = tokens.withColumn("full", F.exists("v", lambda a: F.isnan(a) | (a != 0))).select(*key, "full", F.posexplode("v").alias("i", "x"))
    good = F.when(F.col("full"), F.when(F.isnan("x"), 0.0).otherwise(F.col("x")))
    return x.groupBy(*key, "i").agg(F.coalesce(F.avg(good), F.lit(0.0)).alias("x"))


def medoids(assigned: DataFrame, key: list[str]) -> DataFrame:
    """(key, medoid): the member nearest to the plain mean of its cluster by squared distance; least id on ties."""
    x = assigned.select(*key, "id", F.posexplode("v").alias("i", "x")).join(centroids(assigned, key), [*key, "i"])
    off = x.groupBy(*key, "id").agg(F.round(F.sum((F.col("x") - F.col("centroid")) ** 2), 12).alias("d"))
    return off.groupBy(*key).agg(F.min(F.struct("d", "id")).alias("m")).select(*key, F.col("m.id").alias("medoid"))
