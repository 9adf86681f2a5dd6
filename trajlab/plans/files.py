"""Queries that write files or tables, read them back and answer from what they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.operators import divergence as D
from trajlab.operators import embedding as B
from trajlab.operators import export as E
from trajlab.operators import mutate as M
from trajlab.operators import trajectory as T
from trajlab.operators.graph import checkpointed, scratch
from trajlab.plans.model import _JOINED, _SCOPE, CHOSEN, NOW, _counts
from trajlab.plans.relational import _GRID
from trajlab.plans.trajectories import SQL as CURVES
from trajlab.plans.trajectories import _WITHIN, _report, r6
from trajlab.sources import frames, io, model
from trajlab.sources.store import Store



def _at() -> Column:
    return F.lit(NOW).cast("timestamp")


#: models of the queries: characters of a text, of a reversed text, and bytes of an image
REGISTRY = {
    "M0": B.Model("text", B.characters, batch=16, raw=True),
    "M1": B.Model("text", lambda: lambda texts: B.characters()([t[::-1] for t in texts])),
    "V0": B.Model("image", B.characters, batch=8, raw=True),
}


def dump_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Rows of the eight tables of an export, read from its files, and those that the writer counted."""
    with scratch(s, "dump") as folder:
        written = E.export(model.tables(s, d), CHOSEN, folder)
        told = s.createDataFrame([(name, n) for name, _, n in written], "table_name string, n_written long")
        return checkpointed(_counts(io.read_dump(s, folder)).join(told, "table_name"))


def csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """The table of exponents by way of its CSV files."""
    with scratch(s, "ftle") as folder:
        io.write_ftle_csv(_report(s, d), folder)
        back = checkpointed(io.read_ftle_csv(s, folder))
    return back.withColumn("ftle", r6("ftle")).withColumn("r_squared", r6("r_squared"))


def blob_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Vectors by way of float32 blobs; every seventh is missing."""
    e = frames.table(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("v"))
    blobs = io.blobs_of_vectors(e, "v").withColumn("n_bytes", F.octet_length("v").cast("long"))
    return io.vectors_of_blobs(blobs, "v").select("vec_id", "n_bytes", F.size(F.coalesce("v", F.array().cast("array<float>"))).cast("long").alias("n"), F.round(F.get("v", 0).cast("double"), 6).alias("first"), F.round(F.get("v", 63).cast("double"), 6).alias("last"))


def config_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Experiment settings read from JSON files, one each; a num_runs of 1 is left out of its file."""
    e = frames.experiments(s, d).select(F.col("experiment_id").alias("id"), "networks", "prompts", F.array(F.lit("M0")).alias("embedding_models"), "max_length", F.nullif("num_runs", F.lit(1).cast("long")).alias("num_runs"))
    with scratch(s, "configs") as folder:
        e.write.option("maxRecordsPerFile", 1).option("ignoreNullFields", True).json(folder)
        back = checkpointed(io.read_config(s, folder))
    network = F.explode("networks").alias("network")
    return back.select(network, F.array_join("prompts", ", ").alias("prompts"), "max_length", "num_runs").select(F.concat_ws("|", "network").alias("network"), "prompts", "max_length", "num_runs")


def embedded_missing(s: SparkSession, d: str) -> DataFrame:
    """The vectors that fill what three models lack, once those whose id ends in 3 are lost."""
    t = model.tables(s, d)
    t["embeddings"] = t["embeddings"].where(~F.col("id").endswith("3"))
    return B.filled(t, REGISTRY, _at()).select("id", "invocation_id", "embedding_model", F.size("vector").cast("long").alias("n"), F.round(F.get("vector", 0).cast("double"), 5).alias("first"), F.round(F.get("vector", 8).cast("double"), 5).alias("ninth"))


def appended_twice(s: SparkSession, d: str) -> DataFrame:
    """Filled vectors appended twice by their key: rows added each time, and rows per model at the end."""
    t = model.tables(s, d)
    kept = t["embeddings"].where(~F.col("id").endswith("3"))
    with scratch(s, "append") as folder:
        store, key = Store(s, folder), model.UNIQUE["embeddings"]
        store.append("embeddings", kept, "embedding_model", key)
        batch = checkpointed(B.filled(t | {"embeddings": kept}, REGISTRY, _at()))
        added = [store.append("embeddings", batch, "embedding_model", key) for _ in range(2)]
        found = store.read("embeddings").groupBy("embedding_model").agg(F.count("*").alias("n"))
        return checkpointed(found.select("*", F.lit(added[0]).cast("long").alias("n_first"), F.lit(added[1]).cast("long").alias("n_second")))


def _new_clustering(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One layer of model M0: vectors by the last digit of their id, the least the medoid."""
    e = t["embeddings"].where("embedding_model = 'M0'").select("id", F.substring("id", -1, 1).alias("g"))
    runs = t["clustering_results"].where("id = 'c0'").withColumn("id", F.lit("new-0"))
    medoid = e.groupBy("g").agg(F.min("id").alias("medoid_embedding_id"))
    assigned = e.join(medoid, "g").select(F.concat(F.lit("new-"), "id").alias("id"), F.col("id").alias("embedding_id"), F.lit("new-0").alias("clustering_result_id"), "medoid_embedding_id", _at().alias("inserted_at"), _at().alias("updated_at"), F.lit("M0").alias("_model"))
    return {"clustering_results": runs, "embedding_clusters": assigned}


def replaced_clusterings(s: SparkSession, d: str) -> DataFrame:
    """Layers and assignments once model M0's are replaced in one commit: (clustering_result_id, embedding_model,
    layer, n, n_clusters)."""
    t = model.tables(s, d)
    of = t["clustering_results"].select(F.col("id").alias("clustering_result_id"), F.col("embedding_model").alias("_model"))
    with scratch(s, "clusterings") as folder:
        store = Store(s, folder)
        M.clusterings_replaced(store, ["M0", "M1", "X0"], {"clustering_results": t["clustering_results"], "embedding_clusters": t["embedding_clusters"].join(of, "clustering_result_id").select(*t["embedding_clusters"].columns, "_model")})
        M.clusterings_replaced(store, ["M0"], _new_clustering(t))
        counts = store.read("embedding_clusters").groupBy("clustering_result_id").agg(F.count("*").alias("n"), F.countDistinct("medoid_embedding_id").alias("n_clusters"))
        runs = store.read("clustering_results").select(F.col("id").alias("clustering_result_id"), "embedding_model", "layer")
        return checkpointed(runs.join(counts, "clustering_result_id", "full"))


def replaced_exponents(s: SparkSession, d: str) -> DataFrame:
    """Stored exponents once those of one experiment are computed anew and replaced."""
    t = model.tables(s, d)
    old = t["lyapunov_results"].select("experiment_id", F.concat_ws("|", "network").alias("network"), "prompt", "embedding_model", F.col("lyapunov_data.exponent").alias("exponent"), F.col("lyapunov_data.num_pairs").alias("num_pairs"))
    fits = D.exponents(D.within_curves(T.points(E.trajectory_steps(E.scoped_tables(t, ["exp0"])))), T.CELL).select(*old.columns)
    with scratch(s, "exponents") as folder:
        store = Store(s, folder)
        M.exponents_replaced(store, ["exp0", "exp1", "exp2"], old)
        M.exponents_replaced(store, ["exp0"], fits)
        return checkpointed(store.read("lyapunov_results").withColumn("exponent", r6("exponent")))


def nulled_inputs(s: SparkSession, d: str) -> DataFrame:
    """Steps and their input, null where that is a step of a run to be deleted."""
    t = model.tables(s, d)["invocations"]
    doomed = t.where(F.col("run_id").endswith("-1") & (F.col("sequence_number") % 4 == 0)).select("id")
    return M.nulled(t, "input_invocation_id", doomed).select("id", "run_id", "input_invocation_id")


_LOST = f"""{_SCOPE}, lost AS (SELECT * FROM m_embeddings WHERE id NOT LIKE '%3'),
us AS (SELECT DISTINCT id AS experiment_id, unnest(embedding_models) AS m FROM m_experiments),
fill AS (SELECT i.id AS invocation_id, m, CASE m WHEN 'V0' THEN output_image WHEN 'M1' THEN reverse(output_text) ELSE output_text END AS c FROM m_invocations i JOIN m_runs r ON r.id = run_id JOIN us ON us.experiment_id = r.experiment_id
  LEFT JOIN lost v ON v.invocation_id = i.id AND v.embedding_model = m WHERE v.id IS NULL AND CASE m WHEN 'V0' THEN type = 'image' AND output_image IS NOT NULL ELSE type = 'text' AND output_text IS NOT NULL END)"""
_LENGTH = "sqrt(list_sum(list_transform(range(1, length(c) + 1), lambda i: (ord(substr(c, i, 1)) / 255.0::DOUBLE) ** 2)))"


def _shown(at: int) -> str:
    return f"round(coalesce(ord(nullif(substr(c, {at}, 1), '')), 0) / 255.0::DOUBLE / CASE m WHEN 'M1' THEN {_LENGTH} ELSE 1 END, 5)"


SQL = {
    "dump_roundtrip": f"WITH {_SCOPE} " + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n, count(*) AS n_written FROM x_{n}" for n in E.CONTRACT),
    "csv_roundtrip": CURVES["ftle_table"],
    "blob_roundtrip": "SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN 4 * len(embedding) END::BIGINT AS n_bytes, CASE WHEN vec_id % 7 <> 0 THEN len(embedding) ELSE 0 END::BIGINT AS n, CASE WHEN vec_id % 7 <> 0 THEN round(embedding[1]::DOUBLE, 6) END AS first, CASE WHEN vec_id % 7 <> 0 THEN round(embedding[64]::DOUBLE, 6) END AS last FROM embeddings",
    "config_roundtrip": f"WITH {_GRID} SELECT array_to_string(n, '|') AS network, array_to_string(list_sort(prompts), ', ') AS prompts, max_length, num_runs FROM (SELECT unnest(networks) AS n, prompts, max_length, num_runs FROM ex)",
    "embedded_missing": f"WITH {_LOST} SELECT concat(invocation_id, '-', m) AS id, invocation_id, m AS embedding_model, 256::BIGINT AS n, {_shown(1)} AS first, {_shown(9)} AS ninth FROM fill",
    "appended_twice": f"""WITH {_LOST}, al AS (SELECT embedding_model AS m FROM lost UNION ALL SELECT m FROM fill)
SELECT m AS embedding_model, count(*) AS n, (SELECT count(*) FROM fill) AS n_first, 0::BIGINT AS n_second FROM al GROUP BY m""",
    "replaced_clusterings": f"""WITH {model.SQL}, ne AS (SELECT id, right(id, 1) AS g FROM m_embeddings WHERE embedding_model = 'M0')
SELECT c.id AS clustering_result_id, c.embedding_model, layer, n, k AS n_clusters FROM m_clustering_results c LEFT JOIN (SELECT clustering_result_id, count(*) AS n, count(DISTINCT medoid_embedding_id) AS k FROM m_embedding_clusters GROUP BY 1) a ON clustering_result_id = c.id WHERE c.embedding_model <> 'M0'
UNION ALL SELECT 'new-0', 'M0', 0, count(*), count(DISTINCT g) FROM ne""",
    "replaced_exponents": "WITH " + _JOINED + _WITHIN[_WITHIN.index(",\npts AS") :] + """, new AS (SELECT experiment_id, network, prompt, embedding_model, round(regr_slope(y, t), 6) AS exponent, max(num_pairs) AS num_pairs FROM (SELECT *, ln(greatest(distance, 1e-10)) AS y FROM curve) GROUP BY ALL)
SELECT * FROM new WHERE experiment_id = 'exp0' UNION ALL SELECT experiment_id, array_to_string(network, '|'), prompt, embedding_model, round(exponent, 6), num_pairs FROM m_lyapunov_results WHERE experiment_id <> 'exp0'""",
    "nulled_inputs": f"WITH {model.SQL}, dm AS (SELECT id FROM m_invocations WHERE run_id LIKE '%-1' AND sequence_number % 4 = 0) SELECT id, run_id, CASE WHEN input_invocation_id NOT IN (FROM dm) THEN input_invocation_id END AS input_invocation_id FROM m_invocations",
}

QUERIES = {name: globals()[name] for name in SQL}
