"""Scoped, typed exports of the eight tables, the wide frame and frames joined from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlab.functions.scalars import exif_time, iso_micros, slug, padded, short_id
from trajlab.operators.graph import checkpointed
from trajlab.operators.report import scoped
from trajlab.sources.io import write_dump

Tables = dict[str, DataFrame]
STAMPS = ["started_at", "completed_at", "inserted_at", "updated_at"]
#: the columns of the export in order; a kind behind the name where it isn't text as it is
CONTRACT = {
    "experiments": ["id", "networks json", "num_runs long", "prompts json", "embedding_models json", "max_length long", *(f"{c} time" for c in STAMPS)],
    "runs": ["id", "experiment_id", "network json", "run_number long", "max_length long", "initial_prompt", "inserted_at time", "updated_at time"],
    "invocations": ["id", "run_id", "input_invocation_id", "sequence_number long", "type", "model", "output_text", *(f"{c} time" for c in STAMPS)],
    "embeddings": ["id", "invocation_id", "embedding_model", "vector array<float>", *(f"{c} time" for c in STAMPS)],
    "persistence_diagrams": ["id", "run_id", "embedding_model", "diagram_data json", *(f"{c} time" for c in STAMPS)],
    "clustering_results": ["id", "embedding_model", "algorithm", "parameters json", "layer long", *(f"{c} time" for c in STAMPS)],
    "embedding_clusters": ["id", "embedding_id", "clustering_result_id", "medoid_embedding_id", "inserted_at time", "updated_at time"],
    "lyapunov_results": ["id", "experiment_id", "embedding_model", "network json", "prompt", "lyapunov_data.exponent double", "lyapunov_data.r_squared double", "lyapunov_data.num_pairs long", "lyapunov_data.num_timesteps long", "lyapunov_data.divergence_curve array<double>", *(f"{c} time" for c in STAMPS)],
}


def by_id(df: DataFrame, *ids: str) -> DataFrame:
    """The rows with these ids."""
    return df.where(F.col("id").isin(*ids))


def by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """The one row with the least id that begins with prefix; none is an error."""
    found = df.where(F.col("id").startswith(prefix)).orderBy("id").limit(1)
    if found.isEmpty():
        raise ValueError(f"no id begins with '{prefix}'")
    return found


def scoped_tables(tables: Tables, experiments: list[str], models: list[str] | None = None, once: bool = False) -> Tables:
    """What belongs to the experiments with these ids. models (all where None) narrows embeddings,
    diagrams, exponents, clusterings and assignments; an assignment's model is its clustering's. Clusterings
    belong to no experiment: without models those of the experiments' models stay. Images are left behind
    before anything is joined. once: the ids of runs, steps and vectors are computed once, for all tables below
    them, as pays where several of the tables are used."""
    def ids(df: DataFrame) -> DataFrame:
        return checkpointed(df.select("id")) if once else df.select("id")

    def of_models(df: DataFrame) -> DataFrame:
        return df if models is None else df.where(F.col("embedding_model").isin(models))

    chosen = by_id(tables["experiments"], *experiments)
    runs = scoped(tables["runs"], "experiment_id", chosen.select("id"))
    of = ids(runs)
    invocations = scoped(tables["invocations"].drop("output_image"), "run_id", of)
    of_runs = scoped(tables["embeddings"], "invocation_id", ids(invocations))
    assigned = scoped(tables["embedding_clusters"], "embedding_id", ids(of_runs))
    if models is None:
        clusterings = scoped(tables["clustering_results"], "embedding_model", chosen.select(F.explode("embedding_models")))
    else:
        clusterings = of_models(tables["clustering_results"])
        assigned = scoped(assigned, "clustering_result_id", clusterings.select("id"))
    return {
        "experiments": chosen, "runs": runs, "invocations": invocations, "embeddings": of_models(of_runs),
        "persistence_diagrams": of_models(scoped(tables["persistence_diagrams"], "run_id", of)),
        "lyapunov_results": of_models(scoped(tables["lyapunov_results"], "experiment_id", chosen.select("id"))),
        "clustering_results": clusterings, "embedding_clusters": assigned,
    }


def typed(name: str, df: DataFrame) -> DataFrame:
    """A table in the columns of the export: nested values as JSON, times as ISO text."""
    def told(spec: str) -> Column:
        path, _, kind = spec.partition(" ")
        c = F.col(path)
        out = {"json": F.to_json, "time": iso_micros, "": lambda c: c.cast("string")}.get(kind, lambda c: c.cast(kind))(c)
        return out.alias(path.rpartition(".")[2])

    return df.select(*[told(x) for x in CONTRACT[name]])


Embed = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def embedder(batches: Embed) -> Callable[[Column], Column]:
    """A column function from a callable over batches of contents, which may load a model once and then
    goes through all batches of its task; it gives a list of floats for each."""
    def called(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from batches(it)

    return F.pandas_udf(called, "array<float>")


def prompt_rows(scope: Tables, text_models: dict[str, Callable[[Column], Column]], models: list[str] | None = None) -> Tables:
    """Rows for the prompts of the scope's runs, as step -1: an invocation for each run and an embedding for
    each run and text model. text_models: a column function for each model that embeds text. The models are
    those given, else those that the experiments use, as far as they embed text. Each distinct prompt is
    embedded once. Without such a model there are no rows at all."""
    wanted = models if models is not None else sorted(r[0] for r in scope["experiments"].select(F.explode("embedding_models")).distinct().collect())
    usable = [m for m in dict.fromkeys(wanted) if m in text_models]
    runs = scope["runs"].select(F.col("id").alias("run_id"), "initial_prompt")
    if not usable:
        runs = runs.limit(0)
    own = F.concat(F.lit("prompt-"), F.col("run_id"))
    none = [F.lit(None).cast("timestamp").alias(c) for c in STAMPS]
    steps = runs.select(own.alias("id"), "run_id", F.lit(None).cast("string").alias("input_invocation_id"), F.lit(-1).cast("long").alias("sequence_number"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("model"), F.col("initial_prompt").alias("output_text"), *none)
    prompts = runs.select("initial_prompt").distinct()
    vectors = [runs.join(prompts.select("initial_prompt", text_models[m](F.col("initial_prompt")).cast("array<float>").alias("vector")), "initial_prompt").select(F.concat(own, F.lit(f"-{m}")).alias("id"), own.alias("invocation_id"), F.lit(m).alias("embedding_model"), "vector", *none) for m in usable]
    out = scope["embeddings"].limit(0).select("id", "invocation_id", "embedding_model", "vector", *STAMPS)
    for v in vectors:
        out = out.unionByName(v)
    return {"invocations": steps, "embeddings": out}


def exported(tables: Tables, experiments: list[str], models: list[str] | None = None, text_models: dict[str, Callable[[Column], Column]] | None = None, once: bool = False) -> Tables:
    """The eight tables of an export; with text_models, the prompts' rows are among them. once: see scoped_tables."""
    scope = scoped_tables(tables, experiments, models, once)
    more = prompt_rows(scope, text_models, models) if text_models else {}
    return {name: typed(name, scope[name].unionByName(more[name]) if name in more else scope[name]) for name in CONTRACT}


def export(tables: Tables, experiments: list[str], folder: str, models: list[str] | None = None, text_models: dict[str, Callable[[Column], Column]] | None = None) -> list[tuple[str, str, int]]:
    """Write an export; (table, path, rows) of each. The steps' files, read in order of their names, have the steps
    in order of run and sequence number."""
    found = exported(tables, experiments, models, text_models, once=True)
    return write_dump(found, folder, order={"invocations": ["run_id", "sequence_number", "id"]})


def joined_frame(tables: Tables, layers: list[int]) -> DataFrame:
    """One row for each embedding with its step, its run, and a cluster_layer_n column for each layer (the
    medoid's id): null for an outlier or a vector never clustered."""
    steps = tables["invocations"].select(F.col("id").alias("invocation_id"), "run_id", "sequence_number", "model", "output_text")
    runs = tables["runs"].select(F.col("id").alias("run_id"), "experiment_id", "network", "initial_prompt")
    base = tables["embeddings"].withColumnRenamed("id", "embedding_id").join(steps, "invocation_id").join(runs, "run_id")
    which = tables["clustering_results"].select(F.col("id").alias("clustering_result_id"), "layer")
    wide = tables["embedding_clusters"].join(which, "clustering_result_id").groupBy("embedding_id").agg(*[F.max(F.when(F.col("layer") == n, F.col("medoid_embedding_id"))).alias(f"cluster_layer_{n}") for n in layers])
    return base.join(wide, "embedding_id", "left")


def trajectory_steps(tables: Tables) -> DataFrame:
    """The steps with vectors that trajectories are made of."""
    runs = tables["runs"].select(F.col("id").alias("run_id"), "experiment_id", F.concat_ws("|", "network").alias("network"), F.col("initial_prompt").alias("prompt"), "run_number")
    steps = tables["invocations"].select(F.col("id").alias("invocation_id"), "run_id", "sequence_number")
    return tables["embeddings"].select(F.col("id").alias("embedding_id"), "invocation_id", "embedding_model", "vector").join(steps, "invocation_id").join(runs, "run_id")


def frame_images(invocations: DataFrame, runs: list[str], sequence_number: int) -> DataFrame:
    """(run_id, output_image) of the images that the runs have at one step."""
    return invocations.where(F.col("run_id").isin(runs) & (F.col("sequence_number") == sequence_number) & F.col("output_image").isNotNull()).select("run_id", "output_image")


def manifest(tables: Tables, experiment: str, limit: int | None = None) -> DataFrame:
    """Path and texts of each image of an experiment: headline, caption, comment, keywords, time. An image's
    input is the text of the step it was made from, else the run's prompt. Ordered by run and step where
    limited."""
    runs = scoped(tables["runs"], "experiment_id", by_id(tables["experiments"], experiment).select("id")).select(F.col("id").alias("run_id"), "network", "run_number", "initial_prompt")
    steps = tables["invocations"]
    source = steps.select(F.col("id").alias("input_invocation_id"), F.col("output_text").alias("input_text"))
    i = steps.where("output_image is not null").select("run_id", "input_invocation_id", "sequence_number", "model", "started_at").join(runs, "run_id").join(source, "input_invocation_id", "left")
    text, seq, number = F.coalesce("input_text", "initial_prompt"), F.col("sequence_number").cast("string"), F.col("run_number").cast("string")
    network, prompt, short = F.concat_ws(" -> ", "network"), F.col("initial_prompt"), short_id(F.lit(experiment))
    out = i.select(
        "run_id", "sequence_number",
        F.concat_ws("/", F.concat_ws("_", "network"), slug(prompt), F.concat(F.lit("run_"), number), F.concat(F.lit("seq_"), padded(F.col("sequence_number")), F.lit(".avif"))).alias("path"),
        F.concat(prompt, F.lit(" — "), network, F.lit(", run "), number, F.lit(", step "), seq).alias("headline"),
        F.concat(F.lit('Initial prompt: "'), prompt, F.lit('". Generated by '), F.col("model"), F.lit(' from input text: "'), text, F.lit('". Run '), number, F.lit(", step "), seq, F.lit(" of experiment "), short, F.lit(".")).alias("caption"),
        F.concat(F.lit("Network: "), network, F.lit(" | Run: "), number, F.lit(" | Sequence: "), seq, F.lit(" | Model: "), F.col("model"), F.lit(" | Input: "), text).alias("comment"),
        F.concat_ws(", ", slug(prompt), "network").alias("keywords"),
        exif_time(F.col("started_at")).alias("taken_at"),
    )
    return out.orderBy("run_id", "sequence_number").limit(limit) if limit is not None else out
