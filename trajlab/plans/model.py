"""Queries on the eight tables: exports, the wide frame, reports, manifests, deletes and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.functions import vectors as V
from trajlab.operators import checks as K
from trajlab.operators import clustering as C
from trajlab.operators import divergence as D
from trajlab.operators import export as E
from trajlab.operators import grid as G
from trajlab.operators import mutate as M
from trajlab.operators import report as R
from trajlab.operators import symbolic as Y
from trajlab.operators import topology as P
from trajlab.operators import trajectory as T
from trajlab.plans.relational import F3
from trajlab.plans.trajectories import _BARS, _CROSS, _WITHIN, EARLY, _points, _slope, r6
from trajlab.sources import frames, model

CHOSEN, MODELS = ["exp0", "exp1"], ["M1", "X0"]
NOW = "2024-01-01 02:00:00"
#: models that embed text, with a featuriser each
TEXT_MODELS = {"M0": V.char_features, "M1": lambda c: V.char_features(F.reverse(c))}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def _told(name: str, df: DataFrame) -> DataFrame:
    """A table with its lists as length and first number."""
    for c in {"embeddings": ["vector"], "lyapunov_results": ["divergence_curve"]}.get(name, []):
        df = df.withColumn(f"{c}_size", F.size(c).cast("long")).withColumn(f"{c}_first", F.round(F.get(c, 0).cast("double"), 6)).drop(c)
    return df


def _exporter(name: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        return _told(name, E.exported(model.tables(s, d), CHOSEN)[name])

    query.__doc__ = f"The exported table {name} of two experiments."
    return query


def exported_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows of the eight tables, all models and two of them."""
    t = model.tables(s, d)
    every, some = _counts(E.scoped_tables(t, CHOSEN)), _counts(E.scoped_tables(t, CHOSEN, MODELS)).withColumnRenamed("n", "n_some")
    return every.join(some, "table_name")


def exported_prompts(s: SparkSession, d: str) -> DataFrame:
    """The prompts' rows of an export: each run's step -1 and its vectors in the text models."""
    t = E.exported(model.tables(s, d), CHOSEN, text_models=TEXT_MODELS)
    steps = t["invocations"].where("sequence_number = -1").select(F.col("id").alias("invocation_id"), "run_id", "output_text")
    return t["embeddings"].join(steps, "invocation_id").select("id", "invocation_id", "run_id", "embedding_model", "output_text", F.size("vector").cast("long").alias("n"), F.round(F.get("vector", 0).cast("double"), 5).alias("first"), F.round(F.get("vector", 7).cast("double"), 5).alias("eighth"))


def wide_frame_joined(s: SparkSession, d: str) -> DataFrame:
    return E.joined_frame(model.tables(s, d), [0, 1]).select("embedding_id", "invocation_id", "embedding_model", "run_id", "sequence_number", "model", "output_text", "experiment_id", F.concat_ws("|", "network").alias("network"), "initial_prompt", "cluster_layer_0", "cluster_layer_1", V.dimension(F.col("vector")).cast("long").alias("dimension"))


def ftle_joined(s: SparkSession, d: str) -> DataFrame:
    """Exponents within prompts, with intercepts, from the joined tables."""
    fits = D.exponents(D.within_curves(T.points(E.trajectory_steps(model.tables(s, d)))), T.CELL)
    return fits.select(*T.CELL, *[r6(c).alias(c) for c in ("exponent", "intercept", "r_squared")], "num_pairs", "num_timesteps")


def status_report(s: SparkSession, d: str) -> DataFrame:
    return R.status_report(model.tables(s, d), F.lit(NOW).cast("timestamp"))


def experiment_layers(s: SparkSession, d: str) -> DataFrame:
    return R.model_layers(model.tables(s, d), "exp0")


def experiment_by_prefix(s: SparkSession, d: str) -> DataFrame:
    return E.by_prefix(model.tables(s, d)["experiments"], "exp").select("id", "num_runs", "max_length")


def runs_by_id(s: SparkSession, d: str) -> DataFrame:
    return E.by_id(model.tables(s, d)["runs"], "r0-0", "r1-1", "absent").select("id", "experiment_id", "initial_prompt")


def frame_images(s: SparkSession, d: str) -> DataFrame:
    return E.frame_images(model.tables(s, d)["invocations"], ["r0-0", "r1-1", "r2-2", "r3-3"], 4).select("run_id", F.decode("output_image", "utf-8").alias("image"))


def full_manifest(s: SparkSession, d: str) -> DataFrame:
    return E.manifest(model.tables(s, d), "exp0")


def first_images(s: SparkSession, d: str) -> DataFrame:
    """The first images by run and step."""
    return E.manifest(model.tables(s, d), "exp1", limit=7).select("run_id", "sequence_number", "path")


def outlier_by_model(s: SparkSession, d: str) -> DataFrame:
    return R.outliers_by_model(model.tables(s, d))


def delete_experiment(s: SparkSession, d: str) -> DataFrame:
    t = model.tables(s, d)
    return M.counted(M.experiments_deleted(t, E.by_id(t["experiments"], "exp1")))


def delete_runs_of_model(s: SparkSession, d: str) -> DataFrame:
    return M.counted(M.runs_of_model_deleted(model.tables(s, d), "T1"))


def embeddable_images(s: SparkSession, d: str) -> DataFrame:
    return G.embeddable(model.tables(s, d)["invocations"], "V0", "image").select("id", "run_id", "sequence_number", "embedding_model")


def missing_image_embeddings(s: SparkSession, d: str) -> DataFrame:
    t = model.tables(s, d)
    return G.missing_embeddings(t["invocations"], t["embeddings"], "V0", "image").select("id", "run_id", "sequence_number", "embedding_model")


def backfill_plan(s: SparkSession, d: str) -> DataFrame:
    return G.backfill(model.tables(s, d), {"M0": "text", "M1": "text", "V0": "image"})


def _faulty(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables with rows that break each rule."""
    t = model.tables(s, d)
    r, e, i = t["runs"], t["experiments"], t["invocations"]
    t["runs"] = r.withColumns({"run_number": F.when(F.col("id").endswith("-3"), F.lit(-1).cast("long")).otherwise(F.col("run_number")), "network": F.when(F.col("id") == "r0-1", F.slice("network", 1, 0)).otherwise(F.col("network")), "initial_prompt": F.when(F.col("id") == "r1-1", "").otherwise(F.col("initial_prompt")), "max_length": F.when(F.col("id") == "r2-2", F.lit(0).cast("long")).otherwise(F.col("max_length"))})
    t["experiments"] = e.withColumns({"max_length": F.when(F.col("id") == "exp3", F.lit(0).cast("long")).otherwise(F.col("max_length")), "num_runs": F.when(F.col("id") == "exp2", F.lit(0).cast("long")).otherwise(F.col("num_runs")), "networks": F.when(F.col("id") == "exp1", F.slice("networks", 1, 0)).when(F.col("id") == "exp2", F.array(F.slice(F.get("networks", 0), 1, 0))).otherwise(F.col("networks")), "prompts": F.when(F.col("id") == "exp3", F.slice("prompts", 1, 0)).otherwise(F.col("prompts")), "embedding_models": F.when(F.col("id") == "exp1", F.slice("embedding_models", 1, 0)).otherwise(F.col("embedding_models"))})
    fault = F.col("sequence_number") == 3
    t["invocations"] = i.withColumns({"output_text": F.when(fault & F.col("run_id").endswith("-1"), F.lit(None)).otherwise(F.col("output_text")), "output_image": F.when(fault & F.col("run_id").endswith("-2"), F.lit("x").cast("binary")).otherwise(F.col("output_image")), "completed_at": F.when(fault, F.col("started_at") - F.expr("interval 1 second")).otherwise(F.col("completed_at")), "sequence_number": F.when((F.col("sequence_number") == 2) & F.col("run_id").endswith("-0"), F.lit(-2).cast("long")).otherwise(F.col("sequence_number"))})
    return t


def rule_violations(s: SparkSession, d: str) -> DataFrame:
    """The rules of experiments, runs and steps, on tables with a fault for each."""
    t = _faulty(s, d)
    return _union([K.violations(t["experiments"], "experiments", K.experiment_rules(), F.col("id")), K.violations(t["runs"], "runs", K.run_rules(), F.col("id")), K.violations(t["invocations"], "invocations", K.step_rules() | K.output_rules(), F.col("id"))])


def repeated_keys(s: SparkSession, d: str) -> DataFrame:
    """The keys of seven tables that rows share, on tables in which some rows come twice."""
    out = []
    for name, key in model.UNIQUE.items():
        df = model.tables(s, d)[name]
        twice = df.unionByName(df.where(F.substring("id", -1, 1) == "1"))
        out.append(K.duplicate_keys(twice, key).agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_keys", "n_rows"))
    return _union(out)


def integrity(s: SparkSession, d: str) -> DataFrame:
    return G.integrity(_faulty(s, d))


def paraphrase_curve(s: SparkSession, d: str) -> DataFrame:
    """The first pair's curve of each cell; one network has a single prompt left, so zeros."""
    p = _points(s, d).where("network <> 'T1|I1' or prompt = 'p1'")
    return D.paraphrase_curves(D.within_curves(p), D.cross_curves(p)).select("network", "t", r6("distance").alias("distance"))


def regimes_between(s: SparkSession, d: str) -> DataFrame:
    """Curves of a close and of a far experiment."""
    p = _points(s, d).withColumn("experiment_id", F.when(F.substring("prompt", 2, 9).cast("int") < 5, "exp0").otherwise("exp1"))
    return D.regimes_between(D.within_curves(p), D.cross_curves(p), "exp0", "exp1").withColumn("distance", r6("distance"))


def ftle_early_cross(s: SparkSession, d: str) -> DataFrame:
    fits = D.exponents(D.cross_curves(_points(s, d)), D.PAIR, EARLY)
    return fits.select("network", "prompt_1", "prompt_2", *[r6(c).alias(c) for c in ("exponent", "intercept", "r_squared")])


def h0_diagrams(s: SparkSession, d: str) -> DataFrame:
    """Bars with birth, death (null: never) and dimension."""
    return P.h0_diagrams(_points(s, d)).select("run_id", F.col("dim").cast("long").alias("dim"), "birth", F.when(F.col("death") < float("inf"), r6("death")).alias("death"))


def mean_pool_groups(s: SparkSession, d: str) -> DataFrame:
    """Pooled vectors of thirteen groups; those of the first are all zero, some of the second are."""
    g = F.col("vec_id") % 13
    zero = (g == 0) | ((g == 1) & (F.col("vec_id") % 2 == 0))
    e = frames.table(s, d, "embeddings").select(g.alias("g"), F.transform(V.doubles(F.col("embedding")), lambda x: F.when(zero, 0.0).otherwise(x)).alias("v"))
    return C.mean_pooled(e, ["g"]).select("g", "i", F.round("x", 6).alias("x"))


def vector_finalise_whole(s: SparkSession, d: str) -> DataFrame:
    """At the default of 256 dimensions, which these vectors don't fill; every third is all zeros."""
    v = V.finalised(F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("vec_id") % 3)))
    return frames.table(s, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.size("v").cast("long").alias("n"), r6(F.element_at("v", 1)).alias("first"), r6(F.element_at("v", -1)).alias("last"))


def _states(s: SparkSession, d: str) -> DataFrame:
    """Users' symbol sequences, in seven cells."""
    return Y.milestoned(frames.symbols(s, d)).withColumn("cell", F.col("run_id") % 7)


def transition_matrix_by_cell(s: SparkSession, d: str) -> DataFrame:
    return Y.transitions_by(_states(s, d), ["cell"]).withColumn("p", r6("p"))


def occupancy(s: SparkSession, d: str) -> DataFrame:
    return Y.occupancy(_states(s, d), ["cell"]).withColumn("share", r6("share"))


def balance_by_cell(s: SparkSession, d: str) -> DataFrame:
    return Y.balance_by(_states(s, d), ["cell"]).withColumn("violation", F.round("violation", 8))


# ---------------------------------------------------------------- the same in SQL

_IN = ", ".join(f"'{x}'" for x in CHOSEN)
_OF = ", ".join(f"'{x}'" for x in MODELS)
_SCOPE = f"""{model.SQL},
x_experiments AS (SELECT * FROM m_experiments WHERE id IN ({_IN})),
x_runs AS (SELECT * FROM m_runs WHERE experiment_id IN ({_IN})),
x_invocations AS (SELECT * FROM m_invocations WHERE run_id IN (SELECT id FROM x_runs)),
x_embeddings AS (SELECT * FROM m_embeddings WHERE invocation_id IN (SELECT id FROM x_invocations)),
x_persistence_diagrams AS (SELECT * FROM m_persistence_diagrams WHERE run_id IN (SELECT id FROM x_runs)),
x_lyapunov_results AS (SELECT * FROM m_lyapunov_results WHERE experiment_id IN ({_IN})),
x_clustering_results AS (SELECT * FROM m_clustering_results WHERE embedding_model IN (SELECT unnest(embedding_models) FROM x_experiments)),
x_embedding_clusters AS (SELECT * FROM m_embedding_clusters WHERE embedding_id IN (SELECT id FROM x_embeddings)),
y_experiments AS (FROM x_experiments), y_runs AS (FROM x_runs), y_invocations AS (FROM x_invocations),
y_embeddings AS (SELECT * FROM x_embeddings WHERE embedding_model IN ({_OF})),
y_persistence_diagrams AS (SELECT * FROM x_persistence_diagrams WHERE embedding_model IN ({_OF})),
y_lyapunov_results AS (SELECT * FROM x_lyapunov_results WHERE embedding_model IN ({_OF})),
y_clustering_results AS (SELECT * FROM m_clustering_results WHERE embedding_model IN ({_OF})),
y_embedding_clusters AS (SELECT * FROM x_embedding_clusters WHERE clustering_result_id IN (SELECT id FROM m_clustering_results WHERE embedding_model IN ({_OF})))"""


def _sql_column(spec: str) -> str:
    path, _, kind = spec.partition(" ")
    name = path.rpartition(".")[2]
    if kind.startswith("array"):
        return f"len({name})::BIGINT AS {name}_size, round({name}[1]::DOUBLE, 6) AS {name}_first"
    return {"json": f"to_json({name})::VARCHAR AS {name}", "time": f"strftime({name}, '%Y-%m-%dT%H:%M:%S.%fZ') AS {name}"}.get(kind, name)


def _sql_slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


_TEXT = "coalesce(s.output_text, r.initial_prompt)"
_IMAGES = """m_invocations i JOIN m_runs r ON r.id = i.run_id LEFT JOIN m_invocations s ON s.id = i.input_invocation_id WHERE i.output_image IS NOT NULL AND r.experiment_id"""
_PATH = f"concat(array_to_string(r.network, '_'), '/', {_sql_slug('r.initial_prompt')}, '/run_', r.run_number, '/seq_', CASE WHEN i.sequence_number < 100 THEN lpad(i.sequence_number::VARCHAR, 3, '0') ELSE i.sequence_number::VARCHAR END, '.avif')"
_DELETED = f"""{model.SQL},
g_runs AS (SELECT id FROM m_runs WHERE WHICH),
g_invocations AS (SELECT id FROM m_invocations WHERE run_id IN (FROM g_runs)),
g_embeddings AS (SELECT id FROM m_embeddings WHERE invocation_id IN (FROM g_invocations)),
g_persistence_diagrams AS (SELECT id FROM m_persistence_diagrams WHERE run_id IN (FROM g_runs))"""


def _sql_deleted(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, sum((id NOT IN (FROM g_{n}))::INT)::BIGINT AS n_left, sum((id IN (FROM g_{n}))::INT)::BIGINT AS n_gone FROM m_{n}" for n in names)


_SIX = ["embedding_clusters", "embeddings", "persistence_diagrams", "lyapunov_results", "invocations", "runs"]
_FAULTY = f"""{model.SQL},
b_runs AS (SELECT * REPLACE (CASE WHEN id LIKE '%-3' THEN -1 ELSE run_number END AS run_number, CASE WHEN id = 'r0-1' THEN [] ELSE network END AS network, CASE WHEN id = 'r1-1' THEN '' ELSE initial_prompt END AS initial_prompt, CASE WHEN id = 'r2-2' THEN 0 ELSE max_length END AS max_length) FROM m_runs),
b_experiments AS (SELECT * REPLACE (CASE WHEN id = 'exp3' THEN 0 ELSE max_length END AS max_length, CASE WHEN id = 'exp2' THEN 0 ELSE num_runs END AS num_runs, CASE id WHEN 'exp1' THEN [] WHEN 'exp2' THEN [[]] ELSE networks END AS networks, CASE WHEN id = 'exp3' THEN [] ELSE prompts END AS prompts, CASE WHEN id = 'exp1' THEN [] ELSE embedding_models END AS embedding_models) FROM m_experiments),
b_invocations AS (SELECT * REPLACE (CASE WHEN sequence_number = 3 AND run_id LIKE '%-1' THEN NULL ELSE output_text END AS output_text, CASE WHEN sequence_number = 3 AND run_id LIKE '%-2' THEN 'x' ELSE output_image END AS output_image, CASE WHEN sequence_number = 3 THEN started_at - INTERVAL 1 SECOND ELSE completed_at END AS completed_at, CASE WHEN sequence_number = 2 AND run_id LIKE '%-0' THEN -2 ELSE sequence_number END AS sequence_number) FROM m_invocations)"""
_RULES = [
    ("experiments", "max_length > 0", "max_length > 0"), ("experiments", "num_runs > 0", "num_runs > 0"), ("experiments", "networks non-empty", "len(networks) > 0 AND len(list_filter(networks, lambda n: len(n) = 0)) = 0"), ("experiments", "prompts non-empty", "len(prompts) > 0"), ("experiments", "embedding_models non-empty", "len(embedding_models) > 0"),
    ("runs", "max_length > 0", "max_length > 0"), ("runs", "run_number >= 0", "run_number >= 0"), ("runs", "network non-empty", "len(network) > 0"), ("runs", "initial_prompt non-empty", "length(initial_prompt) > 0"),
    ("invocations", "sequence_number >= 0", "sequence_number >= 0"), ("invocations", "completed_at >= started_at", "completed_at >= started_at"), ("invocations", "output matches type", "CASE type WHEN 'text' THEN output_text IS NOT NULL AND output_image IS NULL ELSE output_image IS NOT NULL AND output_text IS NULL END"),
]
_CELLS = f"""{F3}, ms AS (SELECT run_id % 7 AS cell, run_id, t, coalesce(last_value(core IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(core IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS state FROM f3),
tr AS (SELECT cell, from_state, to_state, count(*) AS n FROM (SELECT cell, state AS from_state, lead(state) OVER (PARTITION BY run_id ORDER BY t) AS to_state FROM ms) WHERE to_state IS NOT NULL GROUP BY ALL)"""
_SHOWN = "coalesce(strftime({0}, '%Y-%m-%d %H:%M:%S'), '-')"
_MEAN_SAME = "ms AS (SELECT experiment_id, network, embedding_model, t, avg(distance) AS distance FROM (SELECT *, min(num_timesteps) OVER (PARTITION BY experiment_id, network, embedding_model) AS k FROM curve) WHERE t < k GROUP BY ALL), fp AS (SELECT experiment_id, network, embedding_model, min((prompt_1, prompt_2)) AS p FROM cross_curve GROUP BY ALL), fc AS (SELECT c.* FROM cross_curve c JOIN fp ON c.experiment_id = fp.experiment_id AND c.network = fp.network AND (prompt_1, prompt_2) = p)"
_JOINED = f"""{model.SQL}, f1 AS (SELECT experiment_id, array_to_string(network, '|') AS network, initial_prompt AS prompt, run_id, run_number, sequence_number, embedding_model, m_embeddings.id AS embedding_id, vector FROM m_embeddings JOIN m_invocations i ON i.id = invocation_id JOIN m_runs ON m_runs.id = run_id)"""

SQL = {f"export_table_{n}": f"WITH {_SCOPE} SELECT {', '.join(map(_sql_column, E.CONTRACT[n]))} FROM x_{n}" for n in E.CONTRACT} | {
    "exported_counts": f"WITH {_SCOPE} " + " UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT count(*) FROM x_{n}) AS n, (SELECT count(*) FROM y_{n}) AS n_some" for n in E.CONTRACT),
    "exported_prompts": f"""WITH {_SCOPE}, tm AS (SELECT DISTINCT unnest(embedding_models) AS m FROM x_experiments)
SELECT concat('prompt-', id, '-', m) AS id, concat('prompt-', id) AS invocation_id, id AS run_id, m AS embedding_model, initial_prompt AS output_text, 256::BIGINT AS n,
  round(ord(CASE m WHEN 'M0' THEN initial_prompt ELSE reverse(initial_prompt) END) / 255.0::DOUBLE, 5) AS first, round(coalesce(ord(nullif(substr(CASE m WHEN 'M0' THEN initial_prompt ELSE reverse(initial_prompt) END, 8, 1), '')), 0) / 255.0::DOUBLE, 5) AS eighth FROM x_runs, tm WHERE m IN ('M0', 'M1')""",
    "wide_frame_joined": f"""WITH {model.SQL}, a AS (SELECT embedding_id, max(CASE WHEN layer = 0 THEN medoid_embedding_id END) AS l0, max(CASE WHEN layer = 1 THEN medoid_embedding_id END) AS l1 FROM m_embedding_clusters JOIN m_clustering_results c ON c.id = clustering_result_id GROUP BY embedding_id)
SELECT v.id AS embedding_id, invocation_id, v.embedding_model, run_id, sequence_number, model, output_text, experiment_id, array_to_string(network, '|') AS network, initial_prompt, l0 AS cluster_layer_0, l1 AS cluster_layer_1, len(vector)::BIGINT AS dimension
FROM m_embeddings v JOIN m_invocations i ON i.id = invocation_id JOIN m_runs r ON r.id = run_id LEFT JOIN a ON a.embedding_id = v.id""",
    "ftle_joined": "WITH " + _JOINED + _WITHIN[_WITHIN.index(",\npts AS") :] + f" SELECT experiment_id, network, prompt, embedding_model, round(regr_slope(y, t), 6) AS exponent, round(regr_intercept(y, t), 6) AS intercept, round(CASE WHEN max(y) > min(y) THEN regr_r2(y, t) END, 6) AS r_squared, max(num_pairs) AS num_pairs, max(num_timesteps) AS num_timesteps FROM (SELECT *, ln(greatest(distance, 1e-10)) AS y FROM curve) GROUP BY ALL",
    "status_report": f"""WITH {model.SQL}, st AS (SELECT experiment_id, max(i.completed_at) AS c, max(i.started_at) AS s FROM m_invocations i JOIN m_runs r ON r.id = run_id GROUP BY 1),
x AS (SELECT e.*, coalesce(c, s, e.started_at) AS last FROM m_experiments e LEFT JOIN st ON st.experiment_id = e.id),
ly AS (SELECT x.id, string_agg(concat(m, '=', n), ', ' ORDER BY m) AS layers FROM (SELECT id, unnest(embedding_models) AS m FROM x) x JOIN (SELECT embedding_model, count(*) AS n FROM m_clustering_results GROUP BY 1) k ON k.embedding_model = m GROUP BY x.id)
SELECT id, CASE WHEN completed_at IS NOT NULL THEN 'completed' WHEN started_at IS NULL THEN 'pending' WHEN epoch(TIMESTAMP '{NOW}') - epoch(last) > 3600 THEN 'stalled' ELSE 'running' END AS status, to_json(networks)::VARCHAR AS networks, to_json(prompts)::VARCHAR AS prompts, to_json(embedding_models)::VARCHAR AS embedding_models, num_runs, max_length,
  {_SHOWN.format('inserted_at')} AS inserted_at, {_SHOWN.format('started_at')} AS started_at, {_SHOWN.format('completed_at')} AS completed_at, {_SHOWN.format('last')} AS last_activity,
  (SELECT count(*) FROM m_runs WHERE experiment_id = x.id) AS n_runs, (SELECT count(*) FROM m_embeddings v JOIN m_invocations i ON i.id = invocation_id JOIN m_runs r ON r.id = run_id WHERE experiment_id = x.id) AS n_embeddings,
  (SELECT count(*) FROM m_persistence_diagrams p JOIN m_runs r ON r.id = run_id WHERE experiment_id = x.id) AS n_diagrams, coalesce(layers, '(none)') AS layers FROM x LEFT JOIN ly USING (id)""",
    "experiment_layers": f"WITH {model.SQL} SELECT embedding_model, count(*) AS n_layers FROM m_clustering_results WHERE embedding_model IN (SELECT unnest(embedding_models) FROM m_experiments WHERE id = 'exp0') GROUP BY 1",
    "experiment_by_prefix": f"WITH {model.SQL} SELECT id, num_runs, max_length FROM m_experiments WHERE id LIKE 'exp%' ORDER BY id LIMIT 1",
    "runs_by_id": f"WITH {model.SQL} SELECT id, experiment_id, initial_prompt FROM m_runs WHERE id IN ('r0-0', 'r1-1', 'absent')",
    "frame_images": f"WITH {model.SQL} SELECT run_id, output_image AS image FROM m_invocations WHERE run_id IN ('r0-0', 'r1-1', 'r2-2', 'r3-3') AND sequence_number = 4 AND output_image IS NOT NULL",
    "full_manifest": f"""WITH {model.SQL} SELECT i.run_id, i.sequence_number, {_PATH} AS path, concat(r.initial_prompt, ' — ', array_to_string(r.network, ' -> '), ', run ', r.run_number, ', step ', i.sequence_number) AS headline,
  concat('Initial prompt: "', r.initial_prompt, '". Generated by ', i.model, ' from input text: "', {_TEXT}, '". Run ', r.run_number, ', step ', i.sequence_number, ' of experiment exp0.') AS caption,
  concat('Network: ', array_to_string(r.network, ' -> '), ' | Run: ', r.run_number, ' | Sequence: ', i.sequence_number, ' | Model: ', i.model, ' | Input: ', {_TEXT}) AS comment,
  concat({_sql_slug('r.initial_prompt')}, ', ', array_to_string(r.network, ', ')) AS keywords, strftime(i.started_at, '%Y:%m:%d %H:%M:%S') AS taken_at FROM {_IMAGES} = 'exp0'""",
    "first_images": f"WITH {model.SQL} SELECT i.run_id, i.sequence_number, {_PATH} AS path FROM {_IMAGES} = 'exp1' ORDER BY i.run_id, i.sequence_number LIMIT 7",
    "delete_experiment": f"WITH {_DELETED.replace('WHICH', chr(39).join(['experiment_id = ', 'exp1', '']))}, g_embedding_clusters AS (SELECT id FROM m_embedding_clusters WHERE embedding_id IN (FROM g_embeddings)), g_lyapunov_results AS (SELECT id FROM m_lyapunov_results WHERE experiment_id = 'exp1'), g_experiments AS (SELECT 'exp1' AS id) {_sql_deleted([*_SIX, 'experiments'])}",
    "delete_runs_of_model": f"WITH {_DELETED.replace('WHICH', chr(39).join(['list_contains(network, ', 'T1', ')']))}, g_embedding_clusters AS (SELECT id FROM m_embedding_clusters WHERE embedding_id IN (FROM g_embeddings) OR medoid_embedding_id IN (FROM g_embeddings)), g_lyapunov_results AS (SELECT id FROM m_lyapunov_results WHERE list_contains(network, 'T1')) {_sql_deleted(_SIX)}",
    "outlier_by_model": f"""WITH {model.SQL} SELECT v.embedding_model, c.layer, i.model, count(*) AS n, sum((medoid_embedding_id IS NULL)::INT)::BIGINT AS n_outliers
FROM m_embedding_clusters a JOIN m_clustering_results c ON c.id = clustering_result_id JOIN m_embeddings v ON v.id = embedding_id JOIN m_invocations i ON i.id = invocation_id GROUP BY ALL""",
    "embeddable_images": f"WITH {model.SQL} SELECT id, run_id, sequence_number, 'V0' AS embedding_model FROM m_invocations WHERE type = 'image' AND output_image IS NOT NULL",
    "missing_image_embeddings": f"WITH {model.SQL} SELECT id, run_id, sequence_number, 'V0' AS embedding_model FROM m_invocations WHERE type = 'image' AND output_image IS NOT NULL AND id NOT IN (SELECT invocation_id FROM m_embeddings WHERE embedding_model = 'V0')",
    "backfill_plan": f"""WITH {model.SQL}, us AS (SELECT DISTINCT id AS experiment_id, unnest(embedding_models) AS m FROM m_experiments),
gn AS (SELECT id, num_runs, prompts, unnest(networks) AS network FROM m_experiments), gp AS (SELECT id, num_runs, network, unnest(prompts) AS prompt FROM gn), gr AS (SELECT id, network, prompt, unnest(range(num_runs)) AS k FROM gp),
la AS (SELECT run_id, max(sequence_number) + 1 AS nxt FROM m_invocations GROUP BY run_id),
st AS (SELECT i.*, experiment_id FROM m_invocations i JOIN m_runs r ON r.id = run_id)
SELECT 'run' AS work, concat(g.id, '/', array_to_string(g.network, '|'), '/', prompt, '/', k) AS key, NULL::VARCHAR AS embedding_model FROM gr g LEFT JOIN m_runs r ON r.experiment_id = g.id AND r.network = g.network AND r.initial_prompt = prompt AND r.run_number = k WHERE r.id IS NULL
UNION ALL SELECT 'step', concat(id, '/', coalesce(nxt, 0)), NULL FROM m_runs LEFT JOIN la ON run_id = id WHERE coalesce(nxt, 0) < max_length
UNION ALL SELECT 'embedding', st.id, m FROM st JOIN us USING (experiment_id) LEFT JOIN m_embeddings v ON v.invocation_id = st.id AND v.embedding_model = m WHERE v.id IS NULL AND CASE m WHEN 'V0' THEN type = 'image' AND output_image IS NOT NULL ELSE type = 'text' AND output_text IS NOT NULL END
UNION ALL SELECT 'diagram', r.id, m FROM m_runs r JOIN us USING (experiment_id) LEFT JOIN m_persistence_diagrams p ON p.run_id = r.id AND p.embedding_model = m WHERE p.id IS NULL
UNION ALL SELECT 'exponent', concat(experiment_id, '/', array_to_string(network, '|'), '/', initial_prompt), m FROM (SELECT DISTINCT experiment_id, network, initial_prompt FROM m_runs) JOIN us USING (experiment_id)""",
    "vector_finalise_whole": """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 3)) AS v FROM embeddings)
SELECT vec_id, len(v)::BIGINT AS n, round(v[1] / CASE WHEN vec_id % 3 = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END, 6) AS first, round(v[64] / CASE WHEN vec_id % 3 = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END, 6) AS last FROM a""",
    "rule_violations": f"WITH {_FAULTY} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{name}' AS rule, id AS key FROM b_{t} WHERE NOT ({rule})" for t, name, rule in _RULES),
    "repeated_keys": f"WITH {model.SQL} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_keys, (2 * count(*))::BIGINT AS n_rows FROM m_{t} WHERE id LIKE '%1'" for t in model.UNIQUE),
    "integrity": f"""WITH {_FAULTY} SELECT 'missing output' AS finding, id AS key FROM b_invocations WHERE CASE type WHEN 'text' THEN output_text IS NULL ELSE output_image IS NULL END
UNION ALL SELECT 'sequence gap', run_id FROM b_invocations GROUP BY run_id HAVING count(*) <> max(sequence_number) + 1 OR count(DISTINCT sequence_number) <> max(sequence_number) + 1
UNION ALL SELECT 'vector without step', id FROM m_embeddings WHERE invocation_id NOT IN (SELECT id FROM b_invocations) UNION ALL SELECT 'step without run', id FROM b_invocations WHERE run_id NOT IN (SELECT id FROM b_runs)""",
    "paraphrase_curve": "WITH " + _CROSS.replace(",\npts AS", ",\nf9 AS (SELECT * FROM f1 WHERE network <> 'T1|I1' OR prompt = 'p1'),\npts AS").replace("vector::DOUBLE[] AS v FROM f1", "vector::DOUBLE[] AS v FROM f9") + f", {_MEAN_SAME} SELECT network, t, round(distance, 6) AS distance FROM fc UNION ALL SELECT network, t, 0.0 FROM ms WHERE network NOT IN (SELECT network FROM fc)",
    "regimes_between": "WITH " + _CROSS.replace(",\npts AS", ",\nf9 AS (SELECT * REPLACE (CASE WHEN substr(prompt, 2)::INT < 5 THEN 'exp0' ELSE 'exp1' END AS experiment_id) FROM f1),\npts AS").replace("vector::DOUBLE[] AS v FROM f1", "vector::DOUBLE[] AS v FROM f9").replace("JOIN pts a ON a.network", "JOIN pts a ON a.experiment_id = p.experiment_id AND a.network").replace("JOIN pts b ON b.network", "JOIN pts b ON b.experiment_id = p.experiment_id AND b.network") + f""", {_MEAN_SAME}
SELECT network, embedding_model, t AS step, round(distance, 6) AS distance, 'identical' AS regime FROM ms WHERE experiment_id = 'exp0' UNION ALL SELECT network, embedding_model, t, round(distance, 6), 'close' FROM fc WHERE experiment_id = 'exp0' UNION ALL SELECT network, embedding_model, t, round(distance, 6), 'distant' FROM fc WHERE experiment_id = 'exp1'""",
    "ftle_early_cross": f"WITH {_CROSS} SELECT network, prompt_1, prompt_2, round(regr_slope(y, t), 6) AS exponent, round(regr_intercept(y, t), 6) AS intercept, round(CASE WHEN max(y) > min(y) THEN regr_r2(y, t) END, 6) AS r_squared FROM (SELECT *, ln(greatest(distance, 1e-10)) AS y FROM cross_curve WHERE t < {EARLY}) GROUP BY ALL",
    "h0_diagrams": f"WITH {_BARS} SELECT run_id, 0::BIGINT AS dim, 0.0::DOUBLE AS birth, round(death, 6) AS death FROM bar UNION ALL SELECT DISTINCT run_id, 0, 0.0, NULL FROM pts",
    "mean_pool_groups": """WITH x AS (SELECT vec_id % 13 AS g, vec_id % 13 = 0 OR (vec_id % 13 = 1 AND vec_id % 2 = 0) AS zero, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT g, i::INT AS i, round(coalesce(avg(CASE WHEN NOT zero THEN x END), 0.0), 6) AS x FROM x GROUP BY ALL""",
    "transition_matrix_by_cell": f"WITH {_CELLS} SELECT cell, from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY cell, from_state), 6) AS p FROM tr",
    "occupancy": f"WITH {_CELLS} SELECT cell, state, n, round(n / sum(n) OVER (PARTITION BY cell), 6) AS share FROM (SELECT cell, state, count(*) AS n FROM ms WHERE state IS NOT NULL GROUP BY ALL)",
    "balance_by_cell": f"""WITH {_CELLS}, f AS (SELECT cell, least(from_state, to_state) AS state_1, greatest(from_state, to_state) AS state_2, sum(CASE WHEN from_state < to_state THEN n ELSE -n END) AS net FROM tr WHERE from_state <> to_state GROUP BY ALL)
SELECT f.cell, state_1, state_2, round(abs(net) / total, 8) AS violation FROM f JOIN (SELECT cell, sum(n) AS total FROM tr GROUP BY cell) USING (cell)""",
}

QUERIES = {n: _exporter(n.removeprefix("export_table_")) if n.startswith("export_table_") else globals()[n] for n in SQL}
