"""Queries on trajectories: curves, exponents, reports, persistence, recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.operators import divergence as D
from trajlab.operators import topology as P
from trajlab.operators import trajectory as T
from trajlab.sources import frames

TAUS = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
EARLY = 4
RADIUS = 1.4


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def _points(s: SparkSession, d: str) -> DataFrame:
    return T.points(frames.trajectories(s, d))


def _report(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    return D.report(D.exponents(D.within_curves(p), T.CELL), D.exponents(D.cross_curves(p), D.PAIR))


def trajectory_points(s: SparkSession, d: str) -> DataFrame:
    return T.truncated(_points(s, d)).select("network", "prompt", "run_id", "t", "embedding_id", "num_timesteps", r6(F.element_at("v", 1)).alias("v_first"))


def divergence_curve(s: SparkSession, d: str) -> DataFrame:
    return D.within_curves(_points(s, d)).select("network", "prompt", "t", r6("distance").alias("distance"), "num_pairs")


def _fit(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key, r6("exponent").alias("exponent"), r6("r_squared").alias("r_squared"), "num_pairs", "num_timesteps")


def ftle_within(s: SparkSession, d: str) -> DataFrame:
    return _fit(D.exponents(D.within_curves(_points(s, d)), T.CELL), *T.CELL)


def ftle_early(s: SparkSession, d: str) -> DataFrame:
    return _fit(D.exponents(D.within_curves(_points(s, d)), T.CELL, EARLY), *T.CELL)


def cross_divergence_curve(s: SparkSession, d: str) -> DataFrame:
    return D.cross_curves(_points(s, d)).select("network", "prompt_1", "prompt_2", "t", r6("distance").alias("distance"), "num_pairs")


def ftle_cross(s: SparkSession, d: str) -> DataFrame:
    return _fit(D.exponents(D.cross_curves(_points(s, d)), D.PAIR), "network", "embedding_model", "prompt_1", "prompt_2")


def ftle_table(s: SparkSession, d: str) -> DataFrame:
    return _report(s, d).withColumn("ftle", r6("ftle")).withColumn("r_squared", r6("r_squared"))


def heatmap_cells(s: SparkSession, d: str) -> DataFrame:
    return D.heatmap(_report(s, d)).select("network", "row_label", "col_label", r6("ftle").alias("ftle"))


def heatmap_domain(s: SparkSession, d: str) -> DataFrame:
    top = F.max(F.abs("ftle"))
    return D.heatmap(_report(s, d)).groupBy("network").agg(r6(F.when(top > 0, top).otherwise(1.0)).alias("domain"))


def cell_separation(s: SparkSession, d: str) -> DataFrame:
    return D.separation(_report(s, d)).select("network", "embedding_model", *[r6(c).alias(c) for c in ("median_identical", "mad_identical", "median_paraphrase")], F.round("score", 4).alias("score"))


def best_cell(s: SparkSession, d: str) -> DataFrame:
    return D.best_cell(D.separation(_report(s, d))).select("network", "embedding_model", F.round("score", 4).alias("score"))


def mean_curve(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    key = ["experiment_id", "network", "embedding_model"]
    same = D.mean_curves(D.within_curves(p), key).withColumn("category", F.lit("identical"))
    other = D.first_pair_curves(D.cross_curves(p)).withColumn("category", F.lit("paraphrase"))
    return same.unionByName(other).select("network", "category", "t", r6("distance").alias("distance"))


def three_regime(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    return D.three_regimes(D.within_curves(p), D.cross_curves(p)).withColumn("distance", r6("distance"))


def relaxation_time(s: SparkSession, d: str) -> DataFrame:
    return D.relaxation(D.within_curves(_points(s, d)), T.CELL, TAUS).select("network", "prompt", "tau", r6("r_squared").alias("r_squared"))


def semantic_drift(s: SparkSession, d: str) -> DataFrame:
    steps = frames.trajectories(s, d)
    prompts = steps.where("sequence_number = 1 and run_number = 0").select("prompt", "embedding_model", "vector")
    return T.prompt_drift(T.points(steps), prompts).select("run_id", "t", F.round("drift", 4).alias("drift"))


def return_times(s: SparkSession, d: str) -> DataFrame:
    return T.return_times(_points(s, d), RADIUS).select("run_id", "n_returns", r6("mean_return").alias("mean_return"))


def rips_edges(s: SparkSession, d: str) -> DataFrame:
    return P.rips_edges(_points(s, d)).select("run_id", "num_edges", r6("radius").alias("radius"))


def h0_bars(s: SparkSession, d: str) -> DataFrame:
    return P.h0_bars(_points(s, d)).select("run_id", r6("death").alias("death"))


def h0_entropy(s: SparkSession, d: str) -> DataFrame:
    return P.entropy(P.h0_bars(_points(s, d))).select("run_id", r6("entropy").alias("entropy"), "n_bars")


def persistence_l1(s: SparkSession, d: str) -> DataFrame:
    pts = _points(s, d)
    runs = pts.select("run_id", "embedding_model", F.col("prompt").alias("cell")).distinct()
    return P.persistence_l1(P.h0_bars(pts), runs).select("run_1", "run_2", r6("l1").alias("l1"))


# ---------------------------------------------------------------- the same in SQL

F1 = """f1 AS (SELECT 'exp0' AS experiment_id, concat('T', label % 2, '|I', label % 2) AS network, concat('p', label) AS prompt,
  concat('r', label, '-', rn % 4) AS run_id, rn % 4 AS run_number, 2 * (rn // 4) + 1 AS sequence_number, 'M0' AS embedding_model, vec_id AS embedding_id, embedding AS vector
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings))"""
_PTS = f"""{F1},
pts AS (SELECT *, row_number() OVER (PARTITION BY run_id, embedding_model ORDER BY sequence_number) - 1 AS t, vector::DOUBLE[] AS v FROM f1),
len AS (SELECT experiment_id, network, prompt, embedding_model, run_id, count(*) AS n FROM pts GROUP BY ALL),
shortest AS (SELECT experiment_id, network, prompt, embedding_model, count(*) AS n_runs, min(n) AS m FROM len GROUP BY ALL)"""
_WITHIN = f"""{_PTS},
curve AS (SELECT a.experiment_id, a.network, a.prompt, a.embedding_model, a.t, avg(list_distance(a.v, b.v)) AS distance, count(*) AS num_pairs, any_value(m) AS num_timesteps
  FROM pts a JOIN pts b ON a.experiment_id = b.experiment_id AND a.network = b.network AND a.prompt = b.prompt AND a.embedding_model = b.embedding_model AND a.t = b.t AND a.run_id < b.run_id
  JOIN shortest s ON a.experiment_id = s.experiment_id AND a.network = s.network AND a.prompt = s.prompt AND a.embedding_model = s.embedding_model
  WHERE n_runs >= 2 AND m >= 2 AND a.t < m GROUP BY ALL)"""
_CROSS = f"""{_WITHIN},
pair AS (SELECT a.experiment_id, a.network, a.embedding_model, a.prompt AS prompt_1, b.prompt AS prompt_2, least(a.m, b.m) AS m
  FROM shortest a JOIN shortest b ON a.experiment_id = b.experiment_id AND a.network = b.network AND a.embedding_model = b.embedding_model AND a.prompt < b.prompt
  WHERE a.n_runs >= 2 AND b.n_runs >= 2 AND least(a.m, b.m) >= 2),
cross_curve AS (SELECT p.experiment_id, p.network, p.embedding_model, prompt_1, prompt_2, a.t, avg(list_distance(a.v, b.v)) AS distance, count(*) AS num_pairs, any_value(m) AS num_timesteps
  FROM pair p JOIN pts a ON a.network = p.network AND a.embedding_model = p.embedding_model AND a.prompt = prompt_1
  JOIN pts b ON b.network = p.network AND b.embedding_model = p.embedding_model AND b.prompt = prompt_2 AND a.t = b.t WHERE a.t < m GROUP BY ALL)"""


def _slope(source: str, key: str, where: str = "true") -> str:
    return f"""SELECT {key}, regr_slope(y, t) AS exponent, CASE WHEN max(y) > min(y) THEN regr_r2(y, t) END AS r_squared, max(num_pairs) AS num_pairs, max(num_timesteps) AS num_timesteps
  FROM (SELECT *, ln(greatest(distance, 1e-10)) AS y FROM {source}) WHERE {where} GROUP BY {key}"""


_CELL, _PAIR = "experiment_id, network, prompt, embedding_model", "experiment_id, network, embedding_model, prompt_1, prompt_2"
_REPORT = f"""{_CROSS},
report AS (SELECT experiment_id, network, embedding_model, 'identical' AS category, prompt AS prompt_or_pair, exponent AS ftle, r_squared, num_pairs, num_timesteps FROM ({_slope("curve", _CELL)})
  UNION ALL SELECT experiment_id, network, embedding_model, 'paraphrase', concat(prompt_1, ' || ', prompt_2), exponent, r_squared, num_pairs, num_timesteps FROM ({_slope("cross_curve", _PAIR)}))"""
_HEAT = f"""{_REPORT},
same AS (SELECT experiment_id, network, embedding_model, prompt_or_pair AS prompt, ftle FROM report WHERE category = 'identical'),
name AS (SELECT experiment_id, prompt, concat('p', dense_rank() OVER (PARTITION BY experiment_id ORDER BY prompt)) AS label FROM (SELECT DISTINCT experiment_id, prompt FROM same)),
other AS (SELECT network, split_part(prompt_or_pair, ' || ', 1) AS a, split_part(prompt_or_pair, ' || ', 2) AS b, ftle FROM report WHERE category = 'paraphrase'),
val AS (SELECT network, a, b, ftle FROM other UNION ALL SELECT network, b, a, ftle FROM other UNION ALL SELECT network, prompt, prompt, ftle FROM same),
heat AS (SELECT x.network, m.label AS row_label, n.label AS col_label, val.ftle FROM same x JOIN same y ON x.network = y.network JOIN name m ON m.prompt = x.prompt JOIN name n ON n.prompt = y.prompt
  LEFT JOIN val ON val.network = x.network AND val.a = x.prompt AND val.b = y.prompt)"""
_SEPARATION = f"""{_REPORT},
c AS (SELECT network, embedding_model, median(ftle) AS median_identical FROM report WHERE category = 'identical' GROUP BY ALL),
m AS (SELECT network, embedding_model, median(abs(ftle - median_identical)) AS mad_identical FROM report JOIN c USING (network, embedding_model) WHERE category = 'identical' GROUP BY ALL),
p AS (SELECT network, embedding_model, median(ftle) AS median_paraphrase FROM report WHERE category = 'paraphrase' GROUP BY ALL),
sep AS (SELECT *, CASE WHEN mad_identical > 0 THEN (median_paraphrase - median_identical) / mad_identical END AS score FROM c JOIN m USING (network, embedding_model) FULL JOIN p USING (network, embedding_model))"""
_MEAN = """mean_same AS (SELECT network, t, avg(distance) AS distance FROM (SELECT *, min(num_timesteps) OVER (PARTITION BY network, embedding_model) AS k FROM curve) WHERE t < k GROUP BY ALL)"""
_EDGES = f"""{_PTS},
edge AS MATERIALIZED (SELECT a.run_id, a.prompt, a.t AS u, b.t AS v, list_distance(a.v, b.v) AS w FROM pts a JOIN pts b ON a.run_id = b.run_id AND a.t < b.t)"""
#: an edge is in the minimum spanning tree iff no path has only shorter ones: minimax lengths by repeated squaring
_SQUARES = 6
_BARS = (
    _EDGES
    + ", b0 AS MATERIALIZED (SELECT run_id, u, v, w FROM edge UNION ALL SELECT run_id, v, u, w FROM edge UNION ALL SELECT run_id, t, t, 0.0 FROM pts)"
    + "".join(f", b{i + 1} AS MATERIALIZED (SELECT x.run_id, x.u, y.v, min(greatest(x.w, y.w)) AS w FROM b{i} x JOIN b{i} y ON x.run_id = y.run_id AND x.v = y.u GROUP BY ALL)" for i in range(_SQUARES))
    + f", bar AS (SELECT edge.run_id, edge.prompt, edge.w AS death FROM edge JOIN b{_SQUARES} b USING (run_id, u, v) WHERE edge.w = b.w)"
)
_FIT = "round(exponent, 6) AS exponent, round(r_squared, 6) AS r_squared, num_pairs, num_timesteps"
_TAUS = ", ".join(f"({t})" for t in TAUS)

SQL = {
    "trajectory_points": f"WITH {_PTS} SELECT network, prompt, run_id, t, embedding_id, m AS num_timesteps, round(v[1], 6) AS v_first FROM pts JOIN shortest USING ({_CELL}) WHERE n_runs >= 2 AND m >= 2 AND t < m",
    "divergence_curve": f"WITH {_WITHIN} SELECT network, prompt, t, round(distance, 6) AS distance, num_pairs FROM curve",
    "ftle_within": f"WITH {_WITHIN} SELECT {_CELL}, {_FIT} FROM ({_slope('curve', _CELL)})",
    "ftle_early": f"WITH {_WITHIN} SELECT {_CELL}, {_FIT} FROM ({_slope('curve', _CELL, f't < {EARLY}')})",
    "cross_divergence_curve": f"WITH {_CROSS} SELECT network, prompt_1, prompt_2, t, round(distance, 6) AS distance, num_pairs FROM cross_curve",
    "ftle_cross": f"WITH {_CROSS} SELECT network, embedding_model, prompt_1, prompt_2, {_FIT} FROM ({_slope('cross_curve', _PAIR)})",
    "ftle_table": f"WITH {_REPORT} SELECT * REPLACE (round(ftle, 6) AS ftle, round(r_squared, 6) AS r_squared) FROM report",
    "heatmap_cells": f"WITH {_HEAT} SELECT network, row_label, col_label, round(ftle, 6) AS ftle FROM heat",
    "heatmap_domain": f"WITH {_HEAT} SELECT network, round(CASE WHEN max(abs(ftle)) > 0 THEN max(abs(ftle)) ELSE 1.0 END, 6) AS domain FROM heat GROUP BY network",
    "cell_separation": f"WITH {_SEPARATION} SELECT network, embedding_model, round(median_identical, 6) AS median_identical, round(mad_identical, 6) AS mad_identical, round(median_paraphrase, 6) AS median_paraphrase, round(score, 4) AS score FROM sep",
    "best_cell": f"WITH {_SEPARATION} SELECT network, embedding_model, round(score, 4) AS score FROM sep WHERE score IS NOT NULL ORDER BY sep.score DESC, network, embedding_model LIMIT 1",
    "mean_curve": f"""WITH {_CROSS}, {_MEAN}, first_pair AS (SELECT network, embedding_model, min((prompt_1, prompt_2)) AS p FROM cross_curve GROUP BY ALL)
SELECT network, 'identical' AS category, t, round(distance, 6) AS distance FROM mean_same
UNION ALL SELECT c.network, 'paraphrase', t, round(distance, 6) FROM cross_curve c JOIN first_pair f ON c.network = f.network AND (prompt_1, prompt_2) = f.p""",
    "three_regime": f"""WITH {_CROSS}, {_MEAN}, e AS ({_slope('cross_curve', _PAIR)}),
k AS (SELECT network, arg_min((prompt_1, prompt_2), (exponent, prompt_1, prompt_2)) AS close, arg_max((prompt_1, prompt_2), (exponent, prompt_1, prompt_2)) AS distant FROM e GROUP BY network)
SELECT network, t AS step, round(distance, 6) AS distance, 'identical' AS regime FROM mean_same
UNION ALL SELECT c.network, t, round(distance, 6), 'close' FROM cross_curve c JOIN k ON c.network = k.network AND (prompt_1, prompt_2) = close
UNION ALL SELECT c.network, t, round(distance, 6), 'distant' FROM cross_curve c JOIN k ON c.network = k.network AND (prompt_1, prompt_2) = distant""",
    "relaxation_time": f"""WITH {_WITHIN}, fit AS (SELECT network, prompt, tau, regr_r2(distance, exp(-t / tau)) AS r2 FROM curve, (VALUES {_TAUS}) x(tau) GROUP BY ALL)
SELECT network, prompt, arg_max(tau, (r2, -tau))::DOUBLE AS tau, round(max(r2), 6) AS r_squared FROM fit GROUP BY network, prompt""",
    "semantic_drift": f"""WITH {_PTS}, p AS (SELECT prompt, v AS v0 FROM pts WHERE sequence_number = 1 AND run_number = 0)
SELECT run_id, t, round(sqrt(greatest(2 - 2 * list_cosine_similarity(v, v0), 0.0)), 4) AS drift FROM pts JOIN p USING (prompt)""",
    "return_times": f"""WITH {_PTS}, f AS (SELECT a.run_id, a.t, min(b.t - a.t) AS steps FROM pts a JOIN pts b ON a.run_id = b.run_id AND b.t - a.t >= 2 WHERE list_distance(a.v, b.v) < {RADIUS} GROUP BY ALL)
SELECT run_id, count(*) AS n_returns, round(avg(steps), 6) AS mean_return FROM f GROUP BY run_id""",
    "rips_edges": f"""WITH {_EDGES}, far AS (SELECT run_id, p, max(w) AS w FROM (SELECT run_id, u AS p, w FROM edge UNION ALL SELECT run_id, v, w FROM edge) GROUP BY ALL),
r AS (SELECT run_id, min(w) AS radius FROM far GROUP BY run_id) SELECT run_id, count(*) AS num_edges, round(any_value(radius), 6) AS radius FROM edge JOIN r USING (run_id) WHERE w <= radius GROUP BY run_id""",
    "h0_bars": f"WITH {_BARS} SELECT run_id, round(death, 6) AS death FROM bar",
    "h0_entropy": f"WITH {_BARS} SELECT run_id, round(-sum(p * ln(p)), 6) AS entropy, count(*) AS n_bars FROM (SELECT run_id, death / sum(death) OVER (PARTITION BY run_id) AS p FROM bar WHERE death > 0) GROUP BY run_id",
    "persistence_l1": f"""WITH {_BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY death DESC) AS k FROM bar),
runs AS (SELECT DISTINCT a.run_id AS run_1, b.run_id AS run_2 FROM pts a JOIN pts b ON a.prompt = b.prompt AND a.run_id < b.run_id),
d AS (SELECT run_1, run_2, k, death AS x FROM runs JOIN k ON run_id = run_1 UNION ALL SELECT run_1, run_2, k, -death FROM runs JOIN k ON run_id = run_2)
SELECT run_1, run_2, round(sum(x), 6) AS l1 FROM (SELECT run_1, run_2, k, abs(sum(x)) AS x FROM d GROUP BY ALL) GROUP BY ALL""",
}

QUERIES = {name: globals()[name] for name in SQL}
