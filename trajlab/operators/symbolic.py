"""Dynamics of symbol sequences: milestones, transitions, dwell times, fixed points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def milestoned(seq: DataFrame) -> DataFrame:
    """seq (run_id, t, core) with state: a step outside every core takes the last core visited; steps
    before the first core take that one. A run without a core has null states."""
    w = Window.partitionBy("run_id").orderBy("t")
    past = F.last("core", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("core", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return seq.withColumn("state", F.coalesce(past, ahead))


def transitions(states: DataFrame) -> DataFrame:
    """(from_state, to_state, n, p): counts of successive states, and their share of the state's."""
    w = Window.partitionBy("run_id").orderBy("t")
    pairs = states.withColumn("to_state", F.lead("state").over(w)).where("to_state is not null and state is not null")
    n = pairs.groupBy(F.col("state").alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def transitions_by(states: DataFrame, key: list[str]) -> DataFrame:
    """The same within each cell of key: (key, from_state, to_state, n, p)."""
    w = Window.partitionBy("run_id").orderBy("t")
    pairs = states.withColumn("to_state", F.lead("state").over(w)).where("to_state is not null and state is not null")
    n = pairs.groupBy(*key, F.col("state").alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*key, "from_state")))


def occupancy(states: DataFrame, key: list[str]) -> DataFrame:
    """(key, state, n, share): how much of a cell's steps each state holds; steps without one don't count."""
    n = states.where("state is not null").groupBy(*key, "state").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))


def balance_by(states: DataFrame, key: list[str]) -> DataFrame:
    """(key, state_1, state_2, violation): |flow forth - flow back| between two states of a cell, as a share
    of the cell's transitions."""
    t = transitions_by(states, key).withColumn("total", F.sum("n").over(Window.partitionBy(*key))).where("from_state != to_state")
    flow = F.when(F.col("from_state") < F.col("to_state"), F.col("n")).otherwise(-F.col("n")) / F.col("total")
    return t.groupBy(*key, F.least("from_state", "to_state").alias("state_1"), F.greatest("from_state", "to_state").alias("state_2")).agg(F.abs(F.sum(flow)).alias("violation"))


def dwell_times(states: DataFrame) -> DataFrame:
    """(run_id, state, start, length): maximal stretches of one state."""
    w = Window.partitionBy("run_id").orderBy("t")
    new = F.when(F.lag("state").over(w).eqNullSafe(F.col("state")) & F.lag("t").over(w).isNotNull(), 0).otherwise(1)
    stretch = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return states.withColumn("new", new).withColumn("stretch", stretch).groupBy("run_id", "stretch").agg(F.min("state").alias("state"), F.min("t").alias("start"), F.count("*").alias("length")).drop("stretch")


def transit_share(seq: DataFrame) -> DataFrame:
    """Share of each run's steps outside every core."""
    return seq.groupBy("run_id").agg(F.count("*").alias("n_steps"), F.sum(F.col("core").isNull().cast("long")).alias("n_transit")).withColumn("share", F.col("n_transit") / F.col("n_steps"))


def balance_violation(states: DataFrame) -> DataFrame:
    """(state_1, state_2, violation): |flow forth - flow back| between two states, flows as shares of all
    transitions."""
    t = transitions(states).select("from_state", "to_state", "n")
    total = t.agg(F.sum("n").alias("total"))
    flow = t.where("from_state != to_state").select(F.least("from_state", "to_state").alias("state_1"), F.greatest("from_state", "to_state").alias("state_2"), F.when(F.col("from_state") < F.col("to_state"), F.col("n")).otherwise(-F.col("n")).alias("n"))
    # one row of totals
    return flow.groupBy("state_1", "state_2").agg(F.abs(F.sum("n")).alias("net")).join(F.broadcast(total)).select("state_1", "state_2", (F.col("net") / F.col("total")).alias("violation"))


def fixed_points(seq: DataFrame, text: str = "caption") -> DataFrame:
    """Per run: whether its text stops changing before the last step, and the step from which it doesn't
    (absorbed_at). A run of one step isn't absorbed."""
    w = Window.partitionBy("run_id").orderBy("t")
    changed = F.when(~F.lag(text).over(w).eqNullSafe(F.col(text)), F.col("t"))
    runs = seq.withColumn("changed", changed).groupBy("run_id").agg(F.max("t").alias("last"), F.max("changed").alias("absorbed_at"))
    return runs.select("run_id", (F.col("absorbed_at") < F.col("last")).alias("absorbed"), F.when(F.col("absorbed_at") < F.col("last"), F.col("absorbed_at")).alias("absorbed_at"))
