"""Queries on clusters and vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlab.functions import vectors as V
from trajlab.operators import clustering as C
from trajlab.operators import report as R
from trajlab.operators.graph import checkpointed
from trajlab.operators.grid import first_of_key
from trajlab.plans.trajectories import F1
from trajlab.sources import frames

THRESHOLDS = [0.75, 0.85, 0.95]
SWEEP = [5, 10, 20, 40]


def _long(df: DataFrame, key: str, v: str = "v") -> DataFrame:
    return df.select(key, F.posexplode(v).alias("i", "x")).select(key, "i", F.round("x", 6).alias("x"))


def vector_finalise(s: SparkSession, d: str) -> DataFrame:
    e = frames.table(s, d, "embeddings")
    odd = F.transform("embedding", lambda x, i: F.when((i == 3) & (F.col("vec_id") % 11 == 0), F.lit(float("nan")).cast("float")).otherwise(x))
    return _long(e.select("vec_id", V.finalised(odd, 48).alias("v")), "vec_id")


def vector_normalise(s: SparkSession, d: str) -> DataFrame:
    e = frames.table(s, d, "embeddings")
    return _long(e.select("vec_id", V.normalised(F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("label") + 1))).alias("v")), "vec_id")


def mean_pool(s: SparkSession, d: str) -> DataFrame:
    """Mean of a label's vectors that aren't zero; every thirteenth is made zero and so doesn't count."""
    e = frames.table(s, d, "embeddings").select("label", F.transform(V.doubles(F.col("embedding")), lambda x: F.when(F.col("vec_id") % 13 == 0, 0.0).otherwise(x)).alias("v"))
    return C.centroids(e.where(V.norm(F.col("v")) > 0), ["label"]).select("label", "i", F.round("centroid", 6).alias("x"))


def char_features(s: SparkSession, d: str) -> DataFrame:
    docs = frames.table(s, d, "documents").select("doc_id", V.char_features(F.col("text")).alias("v"))
    return docs.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("v", 1), 6).alias("first"), F.size("v").cast("long").alias("n"))


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, and vectors as one flat array: a batch of lists of numbers takes a hundred times the texts."""
    made = np.random.RandomState()
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            out = np.empty((part.num_rows, 256))
            for row, text in zip(out, part.column("text"), strict=True):
                points = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                made.seed(int(points.sum(dtype=np.int64)) % (1 << 32))
                row[:] = made.rand(256)
            ends = pa.array(np.arange(0, out.size + 1, 256, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["doc_id", "v"])


def seeded_features(s: SparkSession, d: str) -> DataFrame:
    """256 uniforms of the Mersenne twister seeded with the sum of a text's code points."""
    docs = frames.table(s, d, "documents").where("text is not null").select("doc_id", "text")
    made = docs.mapInArrow(_seeded, T.StructType([docs.schema["doc_id"], T.StructField("v", T.ArrayType(T.DoubleType()))]))
    return made.select("doc_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 256), 6).alias("last"))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    e = frames.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"))
    a = frames.assignments(s, d).where("cluster_label is not null").withColumnRenamed("embedding_id", "id")
    return a.join(e, "id")


def cluster_centroids(s: SparkSession, d: str) -> DataFrame:
    return C.centroids(_assigned(s, d), ["layer", "cluster_label"]).select("layer", "cluster_label", "i", F.round("centroid", 6).alias("x"))


def cluster_medoids(s: SparkSession, d: str) -> DataFrame:
    return C.medoids(_assigned(s, d), ["layer", "cluster_label"])


def cluster_stats(s: SparkSession, d: str) -> DataFrame:
    return R.cluster_stats(frames.assignments(s, d)).drop("outlier_share")


def outlier_rate(s: SparkSession, d: str) -> DataFrame:
    return R.cluster_stats(frames.assignments(s, d)).select("layer", F.round("outlier_share", 6).alias("outlier_share"))


def wide_frame(s: SparkSession, d: str) -> DataFrame:
    return R.wide_frame(frames.trajectories(s, d), frames.assignments(s, d), [0, 1])


def _layers(s: SparkSession, d: str) -> DataFrame:
    """Clustering runs: each model's layers. Labels play models."""
    return frames.table(s, d, "embeddings").select(F.concat(F.lit("M"), (F.col("label") % 4).cast("string")).alias("embedding_model"), F.explode(F.sequence(F.lit(0), F.col("label") % 3)).alias("layer")).distinct()


def layers_per_model(s: SparkSession, d: str) -> DataFrame:
    return _layers(s, d).groupBy("embedding_model").agg(F.count("*").alias("n_layers"))


def embedding_models(s: SparkSession, d: str) -> DataFrame:
    return _layers(s, d).select("embedding_model").distinct().orderBy("embedding_model")


def export_cluster_scope(s: SparkSession, d: str) -> DataFrame:
    e = frames.table(s, d, "embeddings").where("label < 2").groupBy("label").agg(F.collect_set(F.concat(F.lit("M"), (F.col("label") % 4).cast("string"))).alias("embedding_models"))
    return R.export_cluster_scope(_layers(s, d), e)


def scoped_embeddings(s: SparkSession, d: str) -> DataFrame:
    """Vectors whose run belongs to a network, through runs."""
    t = frames.trajectories(s, d)
    runs = t.where("network = 'T1|I1'").select("run_id").distinct()
    return R.scoped(t.select("embedding_id", "run_id", "sequence_number"), "run_id", runs)


def dedup_embeddings(s: SparkSession, d: str) -> DataFrame:
    """One vector, that with the least id, of each (run, step); steps are halved to make duplicates."""
    t = frames.trajectories(s, d).select("run_id", F.floor(F.col("sequence_number") / 4).alias("step"), "embedding_id")
    return first_of_key(t, ["run_id", "step"], "embedding_id")


def export_counts(s: SparkSession, d: str) -> DataFrame:
    t, a = frames.trajectories(s, d), frames.assignments(s, d)
    kept = t.where("network = 'T0|I0'")
    parts = {"runs": kept.select("run_id").distinct(), "embeddings": kept.select("embedding_id"), "assignments": R.scoped(a, "embedding_id", kept.select("embedding_id"))}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def core_distance(s: SparkSession, d: str) -> DataFrame:
    return C.core_distances(frames.planted(s, d)).select("id", F.round("core", 6).alias("core"))


def density_clusters(s: SparkSession, d: str) -> DataFrame:
    return C.density_layers(frames.planted(s, d), THRESHOLDS)


def _models(s: SparkSession, d: str) -> DataFrame:
    """The planted vectors as two models', the second of every other vector."""
    e = frames.planted(s, d)
    return e.select("id", "v", F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("M0"), F.lit("M1"))).otherwise(F.array(F.lit("M0")))).alias("embedding_model"))


def merge_heights(s: SparkSession, d: str) -> DataFrame:
    """The weights of each model's tree of merges, and how many merges have them."""
    return C.merges(_models(s, d), ["embedding_model"]).groupBy("embedding_model", F.round("w", 6).alias("w")).agg(F.count("*").alias("n"))


def layers_by_model(s: SparkSession, d: str) -> DataFrame:
    """Layers of both models in one call, cut at quantiles of each one's tree."""
    return C.clusterings(_models(s, d), ["embedding_model"])


def listed_recall(s: SparkSession, d: str) -> DataFrame:
    """Whether at least nine tenths of each vector's five nearest are found by way of lists of centres."""
    v = frames.planted(s, d)
    exact, found = C.nearest(v, C.MIN_SAMPLES), C.nearest(v, C.MIN_SAMPLES, block=256, probes=C.PROBES)
    hits = exact.select("id", "other").join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return hits.agg(F.count("*").alias("n"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("reached"))


def knn_density(s: SparkSession, d: str) -> DataFrame:
    """Quantiles of the distance to the k-th neighbour, for noise and for cluster members."""
    cores = C.core_distances(frames.planted(s, d))
    return cores.groupBy((F.col("id") % 5 == 0).alias("noise")).agg(F.count("*").alias("n"), *[F.round(F.percentile("core", F.lit(q)), 6).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)])


def outlier_sweep(s: SparkSession, d: str) -> DataFrame:
    """Share of vectors in no component of at least each size, at the middle threshold."""
    planted = frames.planted(s, d)
    n = planted.count()
    near = checkpointed(C.nearest(planted, C.MIN_SAMPLES))
    edges = checkpointed(C.reachability_edges(planted, C.cores_of(near), THRESHOLDS[1], near=near)).withColumn("g", F.lit(0))
    nodes = edges.select("g", "u").unionByName(edges.select("g", F.col("v").alias("u"))).distinct()
    sizes = C.components(edges, nodes).groupBy("label").agg(F.count("*").alias("size"))
    return sizes.select(F.explode(F.lit(SWEEP)).alias("least_size"), "size").groupBy("least_size").agg(F.round(1 - F.sum(F.when(F.col("size") >= F.col("least_size"), F.col("size")).otherwise(0)) / n, 6).alias("outlier_share"))


def outlier_by_length(s: SparkSession, d: str) -> DataFrame:
    """Outlier share by octave of caption length."""
    a = frames.assignments(s, d).where("layer = 0").join(frames.table(s, d, "documents").select(F.col("doc_id").alias("embedding_id"), "n_chars"), "embedding_id")
    octave = F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("long")
    return a.groupBy(octave.alias("octave")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("cluster_label").isNull().cast("double")), 6).alias("outlier_share"))


_F6 = """f6 AS (SELECT vec_id AS embedding_id, layer, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN layer = 0 THEN label ELSE label % 3 END AS cluster_label
  FROM embeddings CROSS JOIN (SELECT 0 AS layer UNION ALL SELECT 1) l)"""
_MEMBER = f"{_F6}, m AS (SELECT layer, cluster_label, vec_id AS id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM f6 JOIN embeddings ON vec_id = embedding_id WHERE cluster_label IS NOT NULL), c AS (SELECT layer, cluster_label, i, avg(x) AS c FROM m GROUP BY ALL)"
_LAYERS = "y AS (SELECT DISTINCT concat('M', label % 4) AS embedding_model, unnest(range(label % 3 + 1)) AS layer FROM embeddings)"
_PLANTED = """q AS (SELECT vec_id AS id, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN vec_id % 5 <> 0 AND i = label + 1 THEN 2 ELSE 0 END) AS v FROM embeddings),
pl AS MATERIALIZED (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM q),
dist AS MATERIALIZED (SELECT a.id AS u, b.id AS v, list_distance(a.v, b.v) AS d FROM pl a JOIN pl b ON a.id <> b.id),
core AS MATERIALIZED (SELECT u AS id, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d) AS k FROM dist) WHERE k = 5)"""
_REACH = f"{_PLANTED}, r AS MATERIALIZED (SELECT u, v, greatest(d, a.core, b.core) AS w FROM dist JOIN core a ON a.id = u JOIN core b ON b.id = v)"


def _reached(threshold: float, name: str) -> str:
    return f"{name} AS (SELECT u AS a, u AS b FROM r WHERE w <= {threshold} UNION SELECT {name}.a, r.v FROM {name} JOIN r ON r.u = {name}.b AND r.w <= {threshold})"


_TREE = f"""{_PLANTED.split("dist AS")[0]}pm AS MATERIALIZED (SELECT m, id, v, row_number() OVER (PARTITION BY m ORDER BY id) AS k FROM (SELECT 'M0' AS m, id, v FROM pl UNION ALL SELECT 'M1', id, v FROM pl WHERE id % 2 = 0)),
dm AS MATERIALIZED (SELECT a.m, a.k AS a, b.k AS b, list_distance(a.v, b.v) AS d FROM pm a JOIN pm b ON a.m = b.m AND a.k <> b.k),
cm AS MATERIALIZED (SELECT m, a AS k, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY m, a ORDER BY d) AS rk FROM dm) WHERE rk = 5),
rm AS MATERIALIZED (SELECT dm.m, a, b, round(greatest(d, x.core, y.core), 9) AS w FROM dm JOIN cm x ON x.m = dm.m AND x.k = a JOIN cm y ON y.m = dm.m AND y.k = b),
rl AS MATERIALIZED (SELECT m, a, list(w ORDER BY b) AS ws FROM (FROM rm UNION ALL SELECT DISTINCT m, a, a, 'inf'::DOUBLE FROM rm) GROUP BY m, a),
prim AS (SELECT m, list_transform(ws, lambda x, i: CASE WHEN i > 1 THEN x END) AS near, NULL::DOUBLE AS w FROM rl WHERE a = 1
  UNION ALL SELECT p.m, list_transform(list_zip(p.near, r.ws), lambda z, i: CASE WHEN z[1] IS NOT NULL AND i <> r.a THEN least(z[1], z[2]) END), list_min(p.near) FROM prim p JOIN rl r ON r.m = p.m AND r.a = list_position(p.near, list_min(p.near)) WHERE list_min(p.near) IS NOT NULL),
tw AS MATERIALIZED (SELECT m, w FROM prim WHERE w IS NOT NULL)"""
_CUTS = f"""cu AS MATERIALIZED (SELECT m, q AS level, min(w) AS cut FROM (SELECT m, w, row_number() OVER (PARTITION BY m ORDER BY w) AS rk, count(*) OVER (PARTITION BY m) AS n FROM tw), (VALUES {", ".join(f"({i}, {q})" for i, q in enumerate(C.QUANTILES))}) z(q, share) WHERE rk >= ceil(share * n) GROUP BY m, q),
cl AS MATERIALIZED (SELECT cu.m, level, a, b FROM cu JOIN rm ON rm.m = cu.m AND w <= cut),
tc AS (SELECT DISTINCT m, level, a, a AS b FROM cl UNION SELECT tc.m, tc.level, tc.a, cl.b FROM tc JOIN cl ON cl.m = tc.m AND cl.level = tc.level AND cl.a = tc.b),
lb AS MATERIALIZED (SELECT m, level, a, min(b) AS label FROM tc GROUP BY ALL),
bg AS MATERIALIZED (SELECT m, level, label FROM lb JOIN (SELECT m, greatest(5, floor(0.001 * count(*))) AS least FROM pm GROUP BY m) USING (m) GROUP BY m, level, label, least HAVING count(*) >= least),
ly AS (SELECT m, level, row_number() OVER (PARTITION BY m ORDER BY level) - 1 AS layer FROM (SELECT DISTINCT m, level FROM bg))"""
_LEVELS = ", ".join(_reached(t, f"t{i}") for i, t in enumerate(THRESHOLDS))
_LABELS = " UNION ALL ".join(f"SELECT {i} AS g, a AS id, min(b) AS label FROM t{i} GROUP BY a" for i in range(len(THRESHOLDS)))

SQL = {
    "vector_finalise": """WITH a AS (SELECT vec_id, list_transform(embedding[1:48], lambda x, i: CASE WHEN i = 4 AND vec_id % 11 = 0 THEN 0.0 ELSE x::DOUBLE END) AS v FROM embeddings)
SELECT vec_id, unnest(range(48))::INT AS i, round(unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS x FROM a""",
    "vector_normalise": """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings)
SELECT vec_id, unnest(range(64))::INT AS i, round(unnest(list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12))), 6) AS x FROM a""",
    "mean_pool": "SELECT label, i::INT AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id % 13 <> 0) GROUP BY ALL",
    "char_features": """WITH c AS (SELECT doc_id, text, list_transform(range(1, 257), lambda i: CASE WHEN i <= least(length(text), 100) THEN ord(substr(text, i, 1)) / 255.0 ELSE 0.0 END) AS v FROM documents)
SELECT doc_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first, len(v)::BIGINT AS n FROM c""",
    "seeded_features": None,
    "cluster_centroids": f"WITH {_MEMBER} SELECT layer::INT AS layer, cluster_label, i::INT AS i, round(c, 6) AS x FROM c",
    "cluster_medoids": f"""WITH {_MEMBER}, d AS (SELECT layer, cluster_label, id, round(sum((x - c) ** 2), 12) AS d FROM m JOIN c USING (layer, cluster_label, i) GROUP BY ALL)
SELECT layer::INT AS layer, cluster_label, arg_min(id, (d, id)) AS medoid FROM d GROUP BY ALL""",
    "cluster_stats": f"WITH {_F6} SELECT layer::INT AS layer, count(*) AS n_rows, count(cluster_label) AS cluster_count, count(DISTINCT cluster_label) AS n_clusters FROM f6 GROUP BY layer",
    "outlier_rate": f"WITH {_F6} SELECT layer::INT AS layer, round(avg((cluster_label IS NULL)::INT), 6) AS outlier_share FROM f6 GROUP BY layer",
    "wide_frame": f"""WITH {F1}, {_F6} SELECT f1.* EXCLUDE (vector), a.cluster_label AS cluster_layer_0, b.cluster_label AS cluster_layer_1
FROM f1 LEFT JOIN f6 a ON a.embedding_id = f1.embedding_id AND a.layer = 0 LEFT JOIN f6 b ON b.embedding_id = f1.embedding_id AND b.layer = 1""",
    "layers_per_model": f"WITH {_LAYERS} SELECT embedding_model, count(*) AS n_layers FROM y GROUP BY ALL",
    "embedding_models": f"WITH {_LAYERS} SELECT DISTINCT embedding_model FROM y",
    "export_cluster_scope": f"WITH {_LAYERS} SELECT embedding_model, layer::INT AS layer FROM y WHERE embedding_model IN (SELECT concat('M', label % 4) FROM embeddings WHERE label < 2)",
    "scoped_embeddings": f"WITH {F1} SELECT embedding_id, run_id, sequence_number FROM f1 WHERE run_id IN (SELECT run_id FROM f1 WHERE network = 'T1|I1')",
    "dedup_embeddings": f"WITH {F1} SELECT run_id, sequence_number // 4 AS step, min(embedding_id) AS embedding_id FROM f1 GROUP BY ALL",
    "export_counts": f"""WITH {F1}, {_F6}, k AS (SELECT * FROM f1 WHERE network = 'T0|I0') SELECT 'runs' AS table_name, count(DISTINCT run_id) AS n FROM k
UNION ALL SELECT 'embeddings', count(*) FROM k UNION ALL SELECT 'assignments', count(*) FROM f6 WHERE embedding_id IN (SELECT embedding_id FROM k)""",
    "core_distance": f"WITH {_PLANTED} SELECT id, round(core, 6) AS core FROM core",
    "density_clusters": f"""WITH RECURSIVE {_REACH}, {_LEVELS}, lab AS ({_LABELS}), n AS (SELECT greatest(5, (0.001 * count(*))::INT) AS least FROM pl),
big AS (SELECT g, label FROM lab, n GROUP BY g, label, least HAVING count(*) >= least), lay AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS layer FROM (SELECT DISTINCT g FROM big)),
kept AS (SELECT lab.* FROM lab JOIN big USING (g, label))
SELECT pl.id, layer::INT AS layer, label AS cluster FROM pl CROSS JOIN lay LEFT JOIN kept ON kept.id = pl.id AND kept.g = lay.g""",
    "merge_heights": f"WITH RECURSIVE {_TREE} SELECT m AS embedding_model, round(w, 6) AS w, count(*) AS n FROM tw GROUP BY ALL",
    "layers_by_model": f"""WITH RECURSIVE {_TREE}, {_CUTS}, kp AS (SELECT lb.* FROM lb JOIN bg USING (m, level, label))
SELECT p.m AS embedding_model, p.id, layer::INT AS layer, f.id AS cluster FROM pm p JOIN ly ON ly.m = p.m LEFT JOIN kp ON kp.m = p.m AND kp.level = ly.level AND kp.a = p.k LEFT JOIN pm f ON f.m = p.m AND f.k = kp.label""",
    "listed_recall": "SELECT (5 * count(*))::BIGINT AS n, true AS reached FROM embeddings",
    "knn_density": f"WITH {_PLANTED} SELECT id % 5 = 0 AS noise, count(*) AS n, round(quantile_cont(core, 0.25), 6) AS q25, round(quantile_cont(core, 0.5), 6) AS q50, round(quantile_cont(core, 0.75), 6) AS q75 FROM core GROUP BY ALL",
    "outlier_sweep": f"""WITH RECURSIVE {_REACH}, {_reached(THRESHOLDS[1], 't')}, z AS (SELECT label, count(*) AS size FROM (SELECT a, min(b) AS label FROM t GROUP BY a) GROUP BY label)
SELECT least_size::INT AS least_size, round(1 - sum(CASE WHEN size >= least_size THEN size ELSE 0 END) / (SELECT count(*) FROM pl), 6) AS outlier_share FROM z, (VALUES {', '.join(f'({x})' for x in SWEEP)}) s(least_size) GROUP BY ALL""",
    "outlier_by_length": f"""WITH {_F6} SELECT floor(log2(greatest(n_chars, 1)))::BIGINT AS octave, count(*) AS n, round(avg((cluster_label IS NULL)::INT), 6) AS outlier_share
FROM f6 JOIN documents ON doc_id = embedding_id WHERE layer = 0 GROUP BY ALL""",
}

QUERIES = {name: globals()[name] for name in SQL}
SQL = {k: v for k, v in SQL.items() if v}
