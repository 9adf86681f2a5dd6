"""Zero-dimensional persistence of point clouds, one cloud per run and model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlab.operators.blocks import BLOCK, Side, between, meet
from trajlab.operators.clustering import nearest
from trajlab.operators.spanning import spanning_forest

CLOUD = ["run_id", "embedding_model"]
#: decimals that distances are compared at
DECIMALS = 9


def _cloud(pts: DataFrame) -> DataFrame:
    return pts.select(*CLOUD, F.col("t").alias("id"), "v")


def _farthest(a: Side, b: Side | None) -> dict[str, np.ndarray | pa.Array]:
    d = np.round(between(a, b), DECIMALS)
    if b is None:
        return {"id": a["id"], "far": np.nan_to_num(d).max(1, initial=0)}
    return {"id": pa.concat_arrays([a["id"], b["id"]]), "far": np.concatenate([d.max(1), d.max(0)])}


def _within_radius(a: Side, b: Side | None) -> dict[str, np.ndarray]:
    near = np.round(between(a, b), DECIMALS) <= a["radius"][0]
    return {"n": np.array([near.sum() // (2 if b is None else 1)])}


def rips_edges(pts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(CLOUD, num_edges, radius): pairs of each cloud's points up to its enclosing radius, the least over points
    of the farthest other. Pairs are reduced where two blocks meet: first to each point's farthest, then to a count."""
    cloud = _cloud(pts)
    far = meet(cloud, CLOUD, _farthest, "id long, far double", block=block).groupBy(*CLOUD, "id").agg(F.max("far").alias("far"))
    radius = far.groupBy(*CLOUD).agg(F.min("far").alias("radius"), F.count("*").alias("_points")).where("_points > 1").drop("_points")
    counts = meet(cloud.join(radius, CLOUD), CLOUD, _within_radius, "n long", ["radius"], block)
    return counts.groupBy(*CLOUD).agg(F.sum("n").alias("num_edges")).join(radius, CLOUD)


def h0_bars(pts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Finite bars born at 0: (CLOUD, death), the edge lengths of each cloud's minimum spanning tree."""
    return spanning_forest(_cloud(pts), CLOUD, lambda large: nearest(large, 3, CLOUD, block), block).select(*CLOUD, F.col("w").alias("death"))


def h0_diagrams(pts: DataFrame) -> DataFrame:
    """(CLOUD, dim, birth, death): the bars of dimension 0, born at 0; each cloud has one that never dies."""
    finite = h0_bars(pts).select(*CLOUD, "death")
    endless = pts.select(*CLOUD).distinct().withColumn("death", F.lit(float("inf")))
    return finite.unionByName(endless).select(*CLOUD, F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), "death")


def entropy(bars: DataFrame) -> DataFrame:
    """Persistent entropy -Σ p ln p of the bars' shares of their total length; empty bars don't count."""
    w = Window.partitionBy(*CLOUD)
    p = F.col("death") / F.sum("death").over(w)
    return bars.where("death > 0").withColumn("p", p).groupBy(*CLOUD).agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), F.count("*").alias("n_bars"))


def persistence_l1(bars: DataFrame, group: DataFrame) -> DataFrame:
    """L1 distance of the descending bar lengths of each two runs of a group; a missing bar is 0.
    group: (CLOUD, cell)."""
    w = Window.partitionBy(*CLOUD).orderBy(F.desc("death"))
    ranked = bars.withColumn("k", F.row_number().over(w)).join(group, CLOUD)
    runs = group.alias("a").join(group.alias("b"), ["cell", "embedding_model"]).where("a.run_id < b.run_id").select("cell", "embedding_model", F.col("a.run_id").alias("run_1"), F.col("b.run_id").alias("run_2"))
    one = ranked.select("embedding_model", F.col("run_id").alias("run_1"), "k", F.col("death").alias("d"))
    two = ranked.select("embedding_model", F.col("run_id").alias("run_2"), "k", F.col("death").alias("d"))
    signed = runs.join(one, ["embedding_model", "run_1"]).select("cell", "embedding_model", "run_1", "run_2", "k", "d").unionByName(runs.join(two, ["embedding_model", "run_2"]).select("cell", "embedding_model", "run_1", "run_2", "k", (-F.col("d")).alias("d")))
    key = ["cell", "embedding_model", "run_1", "run_2"]
    return signed.groupBy(*key, "k").agg(F.abs(F.sum("d")).alias("d")).groupBy(*key).agg(F.sum("d").alias("l1"))
