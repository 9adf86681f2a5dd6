"""The eight tables of the data model, derived from the driver's `embeddings` table.

Each label is a prompt with four runs of alternating image and text steps, one
vector a text step; experiments are labels modulo three, and a fourth one has not
begun. `SQL` states the same tables as DuckDB expressions (CTEs named as the tables).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlab.sources.frames import table

#: seconds of the first step
START = 1704067200
TIMES = ["started_at", "completed_at", "inserted_at", "updated_at"]
#: key columns that no two rows of a table share
UNIQUE = {
    "runs": ["experiment_id", "network", "initial_prompt", "run_number"],
    "invocations": ["run_id", "sequence_number"],
    "embeddings": ["invocation_id", "embedding_model"],
    "persistence_diagrams": ["run_id", "embedding_model"],
    "lyapunov_results": ["experiment_id", "network", "prompt", "embedding_model"],
    "clustering_results": ["embedding_model", "algorithm", "layer"],
    "embedding_clusters": ["embedding_id", "clustering_result_id"],
}


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(START) + seconds)


def _stamped(df: DataFrame, start: Column, done: Column | None = None) -> DataFrame:
    """df with the four times; done: whether it is complete."""
    end = start + F.expr("interval 1 second")
    return df.withColumns({"started_at": start, "completed_at": end if done is None else F.when(done, end), "inserted_at": start, "updated_at": end})


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rn = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    e = table(spark, sf_dir, "embeddings").withColumn("rn", rn).withColumn("step", F.floor(F.col("rn") / 4).cast("long")).withColumn("run_id", _text("r", F.col("label"), "-", F.col("rn") % 4))
    label, vec = F.col("label"), F.col("vec_id")
    network = F.array(_text("T", label % 2), _text("I", label % 2))
    experiment, prompt = _text("exp", label % 3), _text("prompt ", label)

    runs = e.groupBy("label", "run_id").agg(F.min("rn").alias("run_number"), (2 * (F.max("step") + 1)).alias("max_length"))
    runs = runs.select(F.col("run_id").alias("id"), experiment.alias("experiment_id"), network.alias("network"), "run_number", "max_length", prompt.alias("initial_prompt"), _at(label * 100).alias("inserted_at"), _at(label * 100).alias("updated_at"))

    begun = runs.groupBy(F.col("experiment_id").alias("id")).agg(F.array_sort(F.collect_set("network")).alias("networks"), F.lit(4).cast("long").alias("num_runs"), F.array_sort(F.collect_set("initial_prompt")).alias("prompts"), F.max("max_length").alias("max_length"), F.min("inserted_at").alias("started_at"))
    first = F.col("id") == "exp0"
    begun = begun.withColumns({"embedding_models": F.when(first, F.array(F.lit("M0"), F.lit("M1"), F.lit("V0"))).otherwise(F.array(F.lit("M0"))), "completed_at": F.when(first, _at(F.lit(90000))), "inserted_at": F.col("started_at"), "updated_at": F.col("started_at")})
    waiting = begun.where(first).withColumns({"id": F.lit("exp3"), "started_at": F.lit(None).cast("timestamp"), "completed_at": F.lit(None).cast("timestamp"), "inserted_at": _at(F.lit(95000))})
    experiments = begun.unionByName(waiting).select("id", "networks", "num_runs", "prompts", "embedding_models", "max_length", *TIMES)

    def steps(seq: Column, kind: str, model: str, text: Column, image: Column) -> DataFrame:
        before = F.when(seq > 0, _text(F.col("run_id"), "-", seq - 1))
        out = e.select(_text(F.col("run_id"), "-", seq).alias("id"), "run_id", before.alias("input_invocation_id"), seq.alias("sequence_number"), F.lit(kind).alias("type"), _text(model, label % 2).alias("model"), text.alias("output_text"), image.alias("output_image"), "vec_id")
        return _stamped(out, _at(vec), vec % 19 != 0).drop("vec_id")

    image = F.when(vec % 23 != 0, _text("img", vec).cast("binary"))
    invocations = steps(2 * F.col("step"), "image", "T", F.lit(None).cast("string"), image).unionByName(steps(2 * F.col("step") + 1, "text", "I", _text("caption ", vec % 50), F.lit(None).cast("binary")))

    def embedded(prefix: str, model: str, seq: Column, where: Column) -> DataFrame:
        out = e.where(where).select(_text(f"{prefix}-", vec).alias("id"), _text(F.col("run_id"), "-", seq).alias("invocation_id"), F.lit(model).alias("embedding_model"), F.col("embedding").alias("vector"), "vec_id")
        return _stamped(out, _at(vec + 5)).drop("vec_id")

    seq = 2 * F.col("step")
    embeddings = embedded("m0", "M0", seq + 1, F.lit(True)).unionByName(embedded("m1", "M1", seq + 1, (label % 3 == 0) & (vec % 2 == 0))).unionByName(embedded("v0", "V0", seq, label % 3 == 0))

    counted = e.where(label % 3 < 2).groupBy("label", "run_id").agg(F.count("*").alias("n"))
    diagrams = _stamped(counted.select(_text("pd-", F.col("run_id")).alias("id"), "run_id", F.lit("M0").alias("embedding_model"), F.struct(F.col("n").alias("num_edges")).alias("diagram_data"), "label"), _at(label)).drop("label")
    cells = e.groupBy("label").agg(F.max("step").alias("steps")).select(_text("ly-", label).alias("id"), experiment.alias("experiment_id"), F.lit("M0").alias("embedding_model"), network.alias("network"), prompt.alias("prompt"), F.struct((label / 8).alias("exponent"), F.when(label > 0, label / 16).alias("r_squared"), F.array(label / 2, label / 4).alias("divergence_curve"), F.lit(6).cast("long").alias("num_pairs"), "steps").alias("lyapunov_data"), "label")
    cells = cells.withColumn("lyapunov_data", F.struct("lyapunov_data.exponent", "lyapunov_data.r_squared", "lyapunov_data.divergence_curve", "lyapunov_data.num_pairs", F.col("lyapunov_data.steps").alias("num_timesteps")))
    lyapunov = _stamped(cells, _at(label)).drop("label")

    c = F.col("c")
    kinds = e.select((label % 4).cast("long").alias("c")).distinct()
    model = F.when(c < 2, "M0").when(c == 2, "M1").otherwise("X0")
    clusterings = _stamped(kinds.select(_text("c", c).alias("id"), model.alias("embedding_model"), F.lit("density").alias("algorithm"), F.create_map(F.lit("k"), F.lit("5")).alias("parameters"), F.when(c == 1, 1).otherwise(0).cast("long").alias("layer"), "c"), _at(c)).drop("c")

    def assigned(number: int, prefix: str, group: Column, where: Column) -> DataFrame:
        medoid = F.min("vec_id").over(Window.partitionBy(group))
        out = e.where(where).select(_text(f"a{number}-", vec).alias("id"), _text(f"{prefix}-", vec).alias("embedding_id"), F.lit(f"c{number}").alias("clustering_result_id"), F.when(vec % 5 != 0, _text(f"{prefix}-", medoid)).alias("medoid_embedding_id"), _at(vec).alias("inserted_at"), _at(vec).alias("updated_at"))
        return out

    clusters = assigned(0, "m0", label, F.lit(True)).unionByName(assigned(1, "m0", label % 3, F.lit(True))).unionByName(assigned(2, "m1", label, (label % 3 == 0) & (vec % 2 == 0)))
    return {"experiments": experiments, "runs": runs, "invocations": invocations, "embeddings": embeddings, "persistence_diagrams": diagrams, "lyapunov_results": lyapunov, "clustering_results": clusterings, "embedding_clusters": clusters}


def _sql_at(seconds: str) -> str:
    return f"make_timestamp(({START}::BIGINT + {seconds}) * 1000000)"


def _sql_times(start: str, done: str = "true") -> str:
    end = f"{start} + INTERVAL 1 SECOND"
    return f"{start} AS started_at, CASE WHEN {done} THEN {end} END AS completed_at, {start} AS inserted_at, {end} AS updated_at"


_NETWORK = "[concat('T', label % 2), concat('I', label % 2)]"
SQL = f"""e AS MATERIALIZED (SELECT *, rn // 4 AS step, concat('r', label, '-', rn % 4) AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings)),
m_runs AS (SELECT run_id AS id, concat('exp', label % 3) AS experiment_id, {_NETWORK} AS network, min(rn) AS run_number, 2 * (max(step) + 1) AS max_length, concat('prompt ', label) AS initial_prompt, {_sql_at('label * 100')} AS inserted_at, {_sql_at('label * 100')} AS updated_at FROM e GROUP BY label, run_id),
begun AS (SELECT experiment_id AS id, list_sort(list(DISTINCT network)) AS networks, 4::BIGINT AS num_runs, list_sort(list(DISTINCT initial_prompt)) AS prompts, CASE WHEN experiment_id = 'exp0' THEN ['M0', 'M1', 'V0'] ELSE ['M0'] END AS embedding_models, max(max_length) AS max_length,
  min(inserted_at) AS started_at, CASE WHEN experiment_id = 'exp0' THEN {_sql_at('90000')} END AS completed_at, min(inserted_at) AS inserted_at, min(inserted_at) AS updated_at FROM m_runs GROUP BY experiment_id),
m_experiments AS (SELECT * FROM begun UNION ALL SELECT * REPLACE ('exp3' AS id, NULL AS started_at, NULL AS completed_at, {_sql_at('95000')} AS inserted_at) FROM begun WHERE id = 'exp0'),
m_invocations AS (SELECT concat(run_id, '-', 2 * step) AS id, run_id, CASE WHEN step > 0 THEN concat(run_id, '-', 2 * step - 1) END AS input_invocation_id, 2 * step AS sequence_number, 'image' AS type, concat('T', label % 2) AS model, NULL::VARCHAR AS output_text, CASE WHEN vec_id % 23 <> 0 THEN concat('img', vec_id) END AS output_image, {_sql_times(_sql_at('vec_id'), 'vec_id % 19 <> 0')} FROM e
  UNION ALL SELECT concat(run_id, '-', 2 * step + 1), run_id, concat(run_id, '-', 2 * step), 2 * step + 1, 'text', concat('I', label % 2), concat('caption ', vec_id % 50), NULL, {_sql_times(_sql_at('vec_id'), 'vec_id % 19 <> 0')} FROM e),
m_embeddings AS (SELECT concat('m0-', vec_id) AS id, concat(run_id, '-', 2 * step + 1) AS invocation_id, 'M0' AS embedding_model, embedding AS vector, {_sql_times(_sql_at('vec_id + 5'))} FROM e
  UNION ALL SELECT concat('m1-', vec_id), concat(run_id, '-', 2 * step + 1), 'M1', embedding, {_sql_times(_sql_at('vec_id + 5'))} FROM e WHERE label % 3 = 0 AND vec_id % 2 = 0
  UNION ALL SELECT concat('v0-', vec_id), concat(run_id, '-', 2 * step), 'V0', embedding, {_sql_times(_sql_at('vec_id + 5'))} FROM e WHERE label % 3 = 0),
m_persistence_diagrams AS (SELECT concat('pd-', run_id) AS id, run_id, 'M0' AS embedding_model, {{'num_edges': count(*)}} AS diagram_data, {_sql_times(_sql_at('label'))} FROM e WHERE label % 3 < 2 GROUP BY label, run_id),
m_lyapunov_results AS (SELECT concat('ly-', label) AS id, concat('exp', label % 3) AS experiment_id, 'M0' AS embedding_model, {_NETWORK} AS network, concat('prompt ', label) AS prompt, label / 8 AS exponent, CASE WHEN label > 0 THEN label / 16 END AS r_squared, 6::BIGINT AS num_pairs, max(step) AS num_timesteps, [label / 2, label / 4] AS divergence_curve, {_sql_times(_sql_at('label'))} FROM e GROUP BY label),
m_clustering_results AS (SELECT concat('c', c) AS id, CASE WHEN c < 2 THEN 'M0' WHEN c = 2 THEN 'M1' ELSE 'X0' END AS embedding_model, 'density' AS algorithm, {{'k': '5'}} AS parameters, (c = 1)::BIGINT AS layer, {_sql_times(_sql_at('c'))} FROM (SELECT DISTINCT label % 4 AS c FROM e)),
m_embedding_clusters AS (SELECT concat('a0-', vec_id) AS id, concat('m0-', vec_id) AS embedding_id, 'c0' AS clustering_result_id, CASE WHEN vec_id % 5 <> 0 THEN concat('m0-', min(vec_id) OVER (PARTITION BY label)) END AS medoid_embedding_id, {_sql_at('vec_id')} AS inserted_at, {_sql_at('vec_id')} AS updated_at FROM e
  UNION ALL SELECT concat('a1-', vec_id), concat('m0-', vec_id), 'c1', CASE WHEN vec_id % 5 <> 0 THEN concat('m0-', min(vec_id) OVER (PARTITION BY label % 3)) END, {_sql_at('vec_id')}, {_sql_at('vec_id')} FROM e
  UNION ALL SELECT concat('a2-', vec_id), concat('m1-', vec_id), 'c2', CASE WHEN vec_id % 5 <> 0 THEN concat('m1-', min(vec_id) OVER (PARTITION BY label)) END, {_sql_at('vec_id')}, {_sql_at('vec_id')} FROM e WHERE label % 3 = 0 AND vec_id % 2 = 0)"""
