"""Experiment grids, backfill plans and step schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["experiment_id", "network", "prompt", "run_number"]


def run_grid(experiments: DataFrame) -> DataFrame:
    """A row for each network, prompt and run number of every experiment."""
    e = experiments.select("experiment_id", "max_length", "num_runs", "prompts", F.explode("networks").alias("network"))
    e = e.select("experiment_id", "max_length", "num_runs", "network", F.explode("prompts").alias("prompt"))
    return e.where("num_runs > 0").select("experiment_id", "network", "prompt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_runs") - 1)).alias("run_number"), "max_length")


def missing_runs(grid: DataFrame, existing: DataFrame) -> DataFrame:
    return grid.join(existing.select(*RUN).distinct(), RUN, "left_anti")


def all_runs(grid: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing runs and those of the grid that are missing, marked in `is_new`."""
    return existing.select(*RUN).withColumn("is_new", F.lit(False)).unionByName(missing_runs(grid, existing).select(*RUN).withColumn("is_new", F.lit(True)))


def step_schedule(runs: DataFrame) -> DataFrame:
    """(RUN, step, model, next_model): models of a network take turns; the last step has no next."""
    s = runs.select(*RUN, "max_length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("max_length") - 1)).alias("step"))
    def at(k):
        return F.element_at("network", (k % F.size("network") + 1).cast("int"))
    return s.select(*RUN, "step", at(F.col("step")).alias("model"), F.when(F.col("step") + 1 < F.col("max_length"), at(F.col("step") + 1)).alias("next_model"))


def runs_with_model(runs: DataFrame, model: str) -> DataFrame:
    return runs.where(F.array_contains("network", model))


def resume_state(invocations: DataFrame) -> DataFrame:
    """Per unfinished run: its next step and that step's input."""
    last = invocations.groupBy("run_id").agg(F.max(F.struct("sequence_number", "id", "output_text")).alias("last"), F.max("max_length").alias("max_length"))
    return last.select("run_id", (F.col("last.sequence_number") + 1).alias("next_sequence"), F.col("last.id").alias("input_invocation_id"), F.col("last.output_text").alias("next_input"), "max_length").where("next_sequence < max_length")


def missing_embeddings(invocations: DataFrame, embeddings: DataFrame, model: str, kind: str) -> DataFrame:
    """Invocations of the kind that a model embeds, with an output, that it hasn't embedded."""
    have = embeddings.where(F.col("embedding_model") == model).select(F.col("invocation_id").alias("id"))
    return embeddable(invocations, model, kind).join(have, "id", "left_anti")


def embeddable(invocations: DataFrame, model: str, kind: str) -> DataFrame:
    """Invocations of a kind that have its output: a text model asks for output_text, an image model for
    output_image."""
    output = {"text": "output_text", "image": "output_image"}[kind]
    return invocations.where((F.col("type") == kind) & F.col(output).isNotNull()).withColumn("embedding_model", F.lit(model))


def missing_diagrams(runs: DataFrame, diagrams: DataFrame, model: str) -> DataFrame:
    have = diagrams.where(F.col("embedding_model") == model).select("run_id")
    return runs.select("run_id").distinct().join(have, "run_id", "left_anti").withColumn("embedding_model", F.lit(model))


def backfill(tables: dict[str, DataFrame], kinds: dict[str, str]) -> DataFrame:
    """(work, key, embedding_model): what the experiments still lack. Runs of their grids, the next step of
    unfinished runs, embeddings and diagrams in each experiment's models, and exponents, which are computed
    anew for every cell of runs. kinds: whether a model embeds text or image; one not named is left out."""
    e, runs, steps = tables["experiments"].withColumnRenamed("id", "experiment_id"), tables["runs"].withColumnRenamed("initial_prompt", "prompt"), tables["invocations"]
    none = F.lit(None).cast("string").alias("embedding_model")

    def text(*parts: str) -> Column:
        return F.concat_ws("/", *[F.concat_ws("|", c) if c == "network" else F.col(c).cast("string") for c in parts]).alias("key")

    lacking = missing_runs(run_grid(e), runs).select(F.lit("run").alias("work"), text(*RUN), none)
    last = steps.groupBy("run_id").agg(F.max("sequence_number").alias("last"))
    partial = runs.select(F.col("id").alias("run_id"), "max_length").join(last, "run_id", "left").where("coalesce(last + 1, 0) < max_length").select(F.lit("step").alias("work"), F.concat_ws("/", "run_id", F.coalesce(F.col("last") + 1, F.lit(0)).cast("string")).alias("key"), none)
    used = e.select("experiment_id", F.explode("embedding_models").alias("embedding_model")).where(F.col("embedding_model").isin(*kinds)).distinct()
    owners = runs.select(F.col("id").alias("run_id"), "experiment_id")
    out = [lacking, partial]
    for model, kind in kinds.items():
        mine = steps.join(owners, "run_id").join(used.where(F.col("embedding_model") == model).select("experiment_id"), "experiment_id", "left_semi")
        out.append(missing_embeddings(mine, tables["embeddings"], model, kind).select(F.lit("embedding").alias("work"), F.col("id").alias("key"), "embedding_model"))
    out.append(owners.join(used, "experiment_id").join(tables["persistence_diagrams"], ["run_id", "embedding_model"], "left_anti").select(F.lit("diagram").alias("work"), F.col("run_id").alias("key"), "embedding_model"))
    out.append(runs.select("experiment_id", "network", "prompt").distinct().join(used, "experiment_id").select(F.lit("exponent").alias("work"), text("experiment_id", "network", "prompt"), "embedding_model"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(finding, key): steps without the output of their type, runs whose steps have gaps, vectors without
    a step and steps without a run."""
    steps, vectors, runs = tables["invocations"], tables["embeddings"], tables["runs"]
    missing = steps.where("case type when 'text' then output_text is null else output_image is null end").select(F.lit("missing output").alias("finding"), F.col("id").alias("key"))
    gaps = sequence_gaps(steps).select(F.lit("sequence gap").alias("finding"), F.col("run_id").alias("key"))
    lost = vectors.join(steps.select(F.col("id").alias("invocation_id")), "invocation_id", "left_anti").select(F.lit("vector without step").alias("finding"), F.col("id").alias("key"))
    loose = steps.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti").select(F.lit("step without run").alias("finding"), F.col("id").alias("key"))
    return missing.unionByName(gaps).unionByName(lost).unionByName(loose)


def prompt_rows(invocations: DataFrame, model: str) -> DataFrame:
    """Real steps and one more for each run at -1, its prompt: (id, run_id, sequence_number, embedding_id, output_text)."""
    runs = invocations.groupBy("run_id").agg(F.min("initial_prompt").alias("output_text"))
    rid = F.col("run_id").cast("string")
    start = runs.select(F.concat(F.lit("prompt-"), rid).alias("id"), "run_id", F.lit(-1).cast("long").alias("sequence_number"), F.concat(F.lit("prompt-"), rid, F.lit(f"-{model}")).alias("embedding_id"), "output_text")
    return invocations.select("id", "run_id", "sequence_number", F.concat("id", F.lit(f"-{model}")).alias("embedding_id"), "output_text").unionByName(start)


def sequence_gaps(invocations: DataFrame) -> DataFrame:
    """Runs whose steps aren't 0, 1, .. once each: steps there, distinct ones, steps expected."""
    r = invocations.groupBy("run_id").agg(F.count("*").alias("n_steps"), F.countDistinct("sequence_number").alias("n_distinct"), (F.max("sequence_number") + 1).alias("n_expected"))
    return r.where("n_steps != n_expected or n_distinct != n_expected")


def downsampled(invocations: DataFrame, every: int, without: list[int]) -> DataFrame:
    """Each every-th step of the runs that aren't excluded."""
    return invocations.where((F.col("sequence_number") % every == 0) & ~F.col("run_id").isin(without))


def first_of_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the least `order`."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
