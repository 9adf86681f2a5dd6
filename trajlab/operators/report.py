"""Status reports, the wide frame, cluster statistics, image manifests and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlab.functions.scalars import age_seconds, iso_micros, or_empty_mark, padded, shown_time, slug


def experiment_status(steps: DataFrame, now: Column, stall_seconds: int = 3600) -> DataFrame:
    """Per experiment of steps (experiment_id, started_at, completed_at), where experiments have no stamps of
    their own (status_report has them): pending without a start, completed when all steps are, else stalled
    when the last activity is over stall_seconds ago, else running. The last activity is the latest
    completion, the latest start where nothing is complete."""
    e = steps.groupBy("experiment_id").agg(F.min("started_at").alias("started_at"), F.count("*").alias("n_steps"), F.count("completed_at").alias("n_done"), F.coalesce(F.max("completed_at"), F.max("started_at")).alias("last_activity"))
    idle = F.unix_timestamp(now) - F.unix_timestamp("last_activity")
    status = F.when(F.col("started_at").isNull(), "pending").when(F.col("n_done") == F.col("n_steps"), "completed").when(idle > stall_seconds, "stalled").otherwise("running")
    return e.withColumn("status", status)


def status_report(tables: dict[str, DataFrame], now: Column, stall_seconds: int = 3600) -> DataFrame:
    """A row for each experiment, newest first: status, times, last activity, counts and clustering layers.

    Completed and started are the experiment's own stamps; one that has started is stalled when its last
    activity is over stall_seconds ago. The last activity is that of the step completed latest (of steps
    none of which is complete, the latest start), without steps the experiment's start. layers counts the
    clusterings of each of the experiment's models, in order of the models, `(none)` without any.
    """
    e, runs = tables["experiments"], tables["runs"].select(F.col("id").alias("run_id"), F.col("experiment_id").alias("id"))
    steps = tables["invocations"].select(F.col("id").alias("invocation_id"), "run_id", "started_at", "completed_at").join(runs, "run_id")
    latest = steps.groupBy("id").agg(F.max(F.struct("completed_at", "started_at")).alias("latest")).select("id", F.coalesce("latest.completed_at", "latest.started_at").alias("last_step"))
    of_runs = runs.groupBy("id").agg(F.count("*").alias("n_runs"))
    vectors = tables["embeddings"].select("invocation_id").join(steps.select("invocation_id", "id"), "invocation_id").groupBy("id").agg(F.count("*").alias("n_embeddings"))
    diagrams = tables["persistence_diagrams"].select("run_id").join(runs, "run_id").groupBy("id").agg(F.count("*").alias("n_diagrams"))
    per_model = tables["clustering_results"].groupBy("embedding_model").agg(F.count("*").alias("n"))
    used = e.select("id", F.explode("embedding_models").alias("embedding_model")).distinct().join(per_model, "embedding_model")
    layers = used.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("embedding_model", "n"))), lambda x: F.concat_ws("=", x["embedding_model"], x["n"].cast("string"))), ", ").alias("layers"))
    out = e
    for part in (latest, of_runs, vectors, diagrams, layers):
        out = out.join(part, "id", "left")
    last = F.coalesce("last_step", "started_at")
    status = F.when(F.col("completed_at").isNotNull(), "completed").when(F.col("started_at").isNotNull(), F.when(age_seconds(last, now) > stall_seconds, "stalled").otherwise("running")).otherwise("pending")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_runs", "n_embeddings", "n_diagrams")]
    shown = [shown_time(F.col(c)).alias(c) for c in ("inserted_at", "started_at", "completed_at")]
    return out.orderBy(F.desc("inserted_at"), "id").select("id", status.alias("status"), F.to_json("networks").alias("networks"), F.to_json("prompts").alias("prompts"), F.to_json("embedding_models").alias("embedding_models"), "num_runs", "max_length", *shown, shown_time(last).alias("last_activity"), *counts, F.coalesce("layers", F.lit("(none)")).alias("layers"))


def model_layers(tables: dict[str, DataFrame], experiment: str) -> DataFrame:
    """(embedding_model, n_layers) of the models of one experiment, in order of the models."""
    mine = tables["experiments"].where(F.col("id") == experiment).select(F.explode("embedding_models").alias("embedding_model")).distinct()
    return tables["clustering_results"].join(mine, "embedding_model").groupBy("embedding_model").agg(F.count("*").alias("n_layers")).orderBy("embedding_model")


def experiment_counts(experiments: DataFrame, **parts: DataFrame) -> DataFrame:
    """A column of counts for each part (a frame with experiment_id); 0 without rows. Each part is
    counted before it is joined."""
    out = experiments.select("experiment_id").distinct()
    for name, df in parts.items():
        out = out.join(df.groupBy("experiment_id").agg(F.count("*").alias(name)), "experiment_id", "left")
    return out.na.fill(0, list(parts))


def wide_frame(steps: DataFrame, assignments: DataFrame, layers: list[int]) -> DataFrame:
    """One row for each vector with its run and step, and a cluster_layer_n column for each layer: null
    for an outlier or a vector never clustered. layers are given, so the pivot needs no pass of its own."""
    wide = assignments.groupBy("embedding_id").agg(*[F.max(F.when(F.col("layer") == n, F.col("cluster_label"))).alias(f"cluster_layer_{n}") for n in layers])
    return steps.drop("vector").join(wide, "embedding_id", "left")


def cluster_stats(assignments: DataFrame) -> DataFrame:
    """Per layer: rows, rows with a cluster, clusters, share of outliers."""
    return assignments.groupBy("layer").agg(F.count("*").alias("n_rows"), F.count("cluster_label").alias("cluster_count"), F.countDistinct("cluster_label").alias("n_clusters"), F.avg(F.col("cluster_label").isNull().cast("double")).alias("outlier_share"))


def outliers_by_model(tables: dict[str, DataFrame]) -> DataFrame:
    """(embedding_model, layer, model, n, n_outliers): how many of the vectors of the steps that a model made lie
    outside every cluster, for each clustering layer of each embedding model."""
    runs = tables["clustering_results"].select(F.col("id").alias("clustering_result_id"), "layer")
    steps = tables["invocations"].select(F.col("id").alias("invocation_id"), "model")
    vectors = tables["embeddings"].select(F.col("id").alias("embedding_id"), "invocation_id", "embedding_model")
    assigned = tables["embedding_clusters"].select("embedding_id", "clustering_result_id", "medoid_embedding_id").join(runs, "clustering_result_id")
    found = assigned.join(vectors, "embedding_id").join(steps, "invocation_id")
    return found.groupBy("embedding_model", "layer", "model").agg(F.count("*").alias("n"), F.sum(F.col("medoid_embedding_id").isNull().cast("long")).alias("n_outliers"))


def image_manifest(invocations: DataFrame, limit: int | None = None) -> DataFrame:
    """Target path and caption texts of each image, with the text it was made from: its input's output,
    else the run's prompt. Ordered by run and step where limited."""
    source = invocations.select(F.col("id").alias("input_invocation_id"), F.col("output_text").alias("input_text"))
    i = invocations.where("type = 'image'").join(source, "input_invocation_id", "left")
    name = padded(F.col("sequence_number"))
    path = F.concat_ws("/", F.col("model"), F.left(slug(F.col("initial_prompt")), F.lit(40)), F.concat(F.lit("run_"), F.col("run_id").cast("string")), F.concat(F.lit("seq_"), name, F.lit(".avif")))
    out = i.select("run_id", "sequence_number", path.alias("path"), or_empty_mark(F.coalesce("input_text", "initial_prompt")).alias("caption"), F.concat_ws(" -> ", "model", F.col("run_id").cast("string")).alias("headline"))
    return out.orderBy("run_id", "sequence_number").limit(limit) if limit else out


def scoped(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose column is among the one column of ids."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def export_cluster_scope(layers: DataFrame, experiments: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Clustering layers of the given models, else of the models of the exported experiments."""
    if models is not None:
        return layers.where(F.col("embedding_model").isin(models))
    return scoped(layers, "embedding_model", experiments.select(F.explode("embedding_models")))


def export_invocations(invocations: DataFrame) -> DataFrame:
    """The columns of the export, image bytes left out, times as ISO text."""
    times = [iso_micros(F.col(c)).alias(c) for c in ("started_at", "completed_at") if c in invocations.columns]
    return invocations.select(F.col("id").cast("string"), F.col("run_id").cast("string"), F.col("sequence_number").cast("long"), F.col("type").cast("string"), F.col("model").cast("string"), "output_text", "input_invocation_id", *times)


def export_lyapunov(curves: DataFrame, fits: DataFrame, key: list[str]) -> DataFrame:
    """One row for each cell with its curve as an array in order of t."""
    curve = curves.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "distance"))).alias("c"))
    return fits.join(curve.select(*key, F.transform("c", lambda x: x["distance"]).alias("divergence_curve")), key)
