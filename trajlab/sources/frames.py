"""Frames of the data model's shape, derived from the driver's star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlab.functions.vectors import doubles, normalised


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with vectors: a prompt for each label, four runs each, two networks."""
    e = table(spark, sf_dir, "embeddings")
    rn = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    part = (F.col("label") % 2).cast("string")
    text = F.col("label").cast("string")
    run = F.col("rn") % 4
    return e.withColumn("rn", rn).select(
        F.lit("exp0").alias("experiment_id"),
        F.concat(F.lit("T"), part, F.lit("|I"), part).alias("network"),
        F.concat(F.lit("p"), text).alias("prompt"),
        F.concat(F.lit("r"), text, F.lit("-"), run.cast("string")).alias("run_id"),
        run.alias("run_number"),
        (2 * F.floor(F.col("rn") / 4) + 1).cast("long").alias("sequence_number"),
        F.lit("M0").alias("embedding_model"),
        F.col("vec_id").alias("embedding_id"),
        F.col("embedding").alias("vector"),
    )


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of runs, one for each turn of a conversation."""
    c = table(spark, sf_dir, "conversations")
    run, turn = F.col("conv_id").cast("string"), F.col("turn")
    return c.select(
        F.concat(run, F.lit("-"), turn.cast("string")).alias("id"),
        F.col("conv_id").alias("run_id"),
        turn.alias("sequence_number"),
        F.when(F.col("role") == "assistant", "text").otherwise("image").alias("type"),
        F.col("role").alias("model"),
        F.col("text").alias("output_text"),
        F.when(turn > 0, F.concat(run, F.lit("-"), (turn - 1).cast("string"))).alias("input_invocation_id"),
        F.first("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("initial_prompt"),
        F.lit(8).cast("long").alias("max_length"),
    )


def embedded(inv: DataFrame) -> DataFrame:
    """The (invocation_id, embedding_model) pairs that count as embedded already."""
    return inv.where((F.col("run_id") + F.col("sequence_number")) % 3 == 0).select(F.col("id").alias("invocation_id"), F.lit("M0").alias("embedding_model"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol sequence for each user; errors play the steps outside every core."""
    e = table(spark, sf_dir, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("run_id"), t.cast("long").alias("t"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("core"), F.col("event_type").alias("caption"), "value")


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """experiment, run and step with their times: customers, orders and line items."""
    c, o, i = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    joined = i.join(o, i["l_orderkey"] == o["o_orderkey"]).join(c, c["c_custkey"] == o["o_custkey"])
    return joined.select(
        F.col("c_custkey").alias("experiment_id"),
        F.col("o_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("long").alias("sequence_number"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("o_orderdate").cast("timestamp")).alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("l_shipdate").cast("timestamp")).alias("completed_at"),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster labels of two layers; null is an outlier."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("embedding_id"), "label", F.explode(F.array(F.lit(0), F.lit(1))).alias("layer"))
    label = F.when(F.col("layer") == 0, F.col("label")).otherwise(F.col("label") % 3)
    return e.select("embedding_id", "layer", F.when(F.col("embedding_id") % 5 != 0, label).alias("cluster_label"))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment grids, one for each nation with customers: networks by market segment, prompts by part size."""
    c = table(spark, sf_dir, "customer")
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), (F.col("p_size") % 25).alias("n")).distinct()
    networks = c.select("c_nationkey", F.array(F.lower("c_mktsegment"), F.concat(F.lit("i"), (F.col("c_nationkey") % 3).cast("string"))).alias("network")).distinct().groupBy("c_nationkey").agg(F.array_sort(F.collect_list("network")).alias("networks"))
    prompts = p.groupBy("n").agg(F.array_sort(F.collect_list(F.concat(F.lit("size "), F.col("size").cast("string")))).alias("prompts"))
    return networks.join(prompts, networks["c_nationkey"] == prompts["n"]).select(F.col("c_nationkey").cast("long").alias("experiment_id"), "networks", "prompts", (F.col("c_nationkey") % 3 + 1).cast("long").alias("num_runs"), (F.col("c_nationkey") % 5 + 2).cast("long").alias("max_length"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors with a cluster for each label; every fifth is left as noise."""
    def moved(x: Column, i: Column) -> Column:
        return x + F.when((F.col("vec_id") % 5 != 0) & (i == F.col("label")), 2.0).otherwise(0.0)

    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(doubles(F.col("embedding")), moved).alias("v"))
    return v.select(F.col("vec_id").alias("id"), normalised(F.col("v")).alias("v"))
