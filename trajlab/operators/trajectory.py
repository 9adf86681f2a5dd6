"""Trajectories: the vectors of one run and model in order of their steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlab.functions.vectors import doubles, drift
from trajlab.operators.blocks import BLOCK, Side, between, meet

CELL = ["experiment_id", "network", "prompt", "embedding_model"]


def points(steps: DataFrame) -> DataFrame:
    """steps with t, the position of a vector in its run (from 0, not the sequence number), and v, the
    vector in doubles. A missing vector moves the later ones up."""
    w = Window.partitionBy("run_id", "embedding_model").orderBy("sequence_number", "embedding_id")
    return steps.where("vector is not null").withColumn("t", (F.row_number().over(w) - 1).cast("long")).withColumn("v", doubles(F.col("vector"))).drop("vector")


def run_lengths(pts: DataFrame) -> DataFrame:
    return pts.groupBy(*CELL, "run_id").agg(F.count("*").alias("length"))


def cells(pts: DataFrame) -> DataFrame:
    """Per cell: runs with a vector and the shortest of them; cells with under two runs or two steps go."""
    return run_lengths(pts).groupBy(*CELL).agg(F.count("*").alias("n_runs"), F.min("length").alias("num_timesteps")).where("n_runs >= 2 and num_timesteps >= 2")


def truncated(pts: DataFrame) -> DataFrame:
    """Points up to the shortest run of their cell."""
    return pts.join(cells(pts), CELL).where("t < num_timesteps")


def prompt_drift(pts: DataFrame, prompts: DataFrame) -> DataFrame:
    """Distance of every point from its prompt's vector: (run_id, embedding_model, t, drift)."""
    return pts.join(prompts.select("prompt", "embedding_model", doubles(F.col("vector")).alias("v0")), ["prompt", "embedding_model"]).select("run_id", "embedding_model", "t", drift(F.col("v"), F.col("v0")).alias("drift"))


def _returns(radius: float, min_gap: int):
    def step(a: Side, b: Side | None) -> dict[str, np.ndarray]:
        near = between(a, b) < radius
        one, other = np.asarray(a["id"]), np.asarray((b or a)["id"])
        gap = other[None, :] - one[:, None]
        found = []
        for at, later, steps in ((one, near & (gap >= min_gap), gap), (other, (near & (-gap >= min_gap)).T, -gap.T))[: 1 if b is None else 2]:
            least = np.where(later, steps, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
            found.append((at[later.any(1)], least[later.any(1)]))
        t, steps = zip(*found, strict=True)
        return {"t": np.concatenate(t), "steps": np.concatenate(steps)}

    return step


def return_times(pts: DataFrame, radius: float, min_gap: int = 2, block: int = BLOCK) -> DataFrame:
    """Per run: how many points come back within `radius` after `min_gap` steps or more, and the mean
    number of steps to the first return. Two blocks of a run's points give each point's first return there."""
    back = meet(pts.select("run_id", "embedding_model", F.col("t").alias("id"), "v"), ["run_id", "embedding_model"], _returns(radius, min_gap), "t long, steps long", block=block)
    first = back.groupBy("run_id", "embedding_model", "t").agg(F.min("steps").alias("steps"))
    return first.groupBy("run_id", "embedding_model").agg(F.count("*").alias("n_returns"), F.avg("steps").alias("mean_return"))
