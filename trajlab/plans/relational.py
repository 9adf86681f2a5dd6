"""Queries on runs, steps, symbols, status, checks and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.functions import scalars as S
from trajlab.operators import checks as K
from trajlab.operators import divergence as D
from trajlab.operators import grid as G
from trajlab.operators import mutate as M
from trajlab.operators import report as R
from trajlab.operators import symbolic as Y
from trajlab.operators import trajectory as T
from trajlab.plans.trajectories import _WITHIN
from trajlab.sources import frames

NOW, STALL = "2001-11-04 00:00:00", 90 * 86400


def _existing(s: SparkSession, d: str) -> DataFrame:
    return G.run_grid(frames.experiments(s, d)).where("run_number < 1")


def run_grid(s: SparkSession, d: str) -> DataFrame:
    return G.run_grid(frames.experiments(s, d)).withColumn("network", F.concat_ws("|", "network"))


def missing_runs(s: SparkSession, d: str) -> DataFrame:
    grid = G.run_grid(frames.experiments(s, d))
    return G.all_runs(grid, _existing(s, d)).withColumn("network", F.concat_ws("|", "network"))


def step_schedule(s: SparkSession, d: str) -> DataFrame:
    return G.step_schedule(G.run_grid(frames.experiments(s, d))).withColumn("network", F.concat_ws("|", "network"))


def runs_with_model(s: SparkSession, d: str) -> DataFrame:
    return G.runs_with_model(G.run_grid(frames.experiments(s, d)), "i1").groupBy("experiment_id").agg(F.count("*").alias("n_runs"))


def cascade_delete_model(s: SparkSession, d: str) -> DataFrame:
    """Rows that stay when runs with a model go: runs, their steps, and exponents of such networks."""
    runs = G.run_grid(frames.experiments(s, d)).withColumn("run_id", F.concat_ws("/", F.col("experiment_id").cast("string"), F.concat_ws("|", "network"), "prompt", F.col("run_number").cast("string")))
    steps = G.step_schedule(runs).withColumn("run_id", F.concat_ws("/", F.col("experiment_id").cast("string"), F.concat_ws("|", "network"), "prompt", F.col("run_number").cast("string")))
    gone = G.runs_with_model(runs, "i1").select("run_id")
    fits = runs.select("experiment_id", "network").distinct()
    kept = {"runs": M.without(runs, "run_id", gone), "steps": M.without(steps, "run_id", gone), "lyapunov_results": fits.where(~F.array_contains("network", "i1"))}
    out = None
    for name, df in kept.items():
        n = df.agg(F.count("*").alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
        out = n if out is None else out.unionByName(n)
    return out


def embeddable_invocations(s: SparkSession, d: str) -> DataFrame:
    return G.embeddable(frames.invocations(s, d), "M0", "text").select("id", "run_id", "sequence_number", "embedding_model")


def missing_embeddings(s: SparkSession, d: str) -> DataFrame:
    i = frames.invocations(s, d)
    return G.missing_embeddings(i, frames.embedded(i), "M0", "text").select("id", "run_id", "sequence_number", "embedding_model")


def missing_diagrams(s: SparkSession, d: str) -> DataFrame:
    i = frames.invocations(s, d)
    have = i.where("run_id % 3 = 0").select("run_id", F.lit("M0").alias("embedding_model")).distinct()
    return G.missing_diagrams(i, have, "M0")


def run_resume_state(s: SparkSession, d: str) -> DataFrame:
    return G.resume_state(frames.invocations(s, d))


def input_output_pairs(s: SparkSession, d: str) -> DataFrame:
    i = frames.invocations(s, d)
    source = i.select(F.col("id").alias("input_invocation_id"), F.col("output_text").alias("input_text"))
    return i.join(source, "input_invocation_id", "left").select("id", F.coalesce("input_text", "initial_prompt").alias("input_text"), "output_text")


def image_manifest(s: SparkSession, d: str) -> DataFrame:
    return R.image_manifest(frames.invocations(s, d))


def invocation_counts(s: SparkSession, d: str) -> DataFrame:
    return frames.invocations(s, d).groupBy("run_id").agg(F.count("*").alias("invocation_count"))


def export_invocations(s: SparkSession, d: str) -> DataFrame:
    return R.export_invocations(frames.invocations(s, d))


def export_lyapunov(s: SparkSession, d: str) -> DataFrame:
    curves = D.within_curves(T.points(frames.trajectories(s, d)))
    wide = R.export_lyapunov(curves, D.exponents(curves, T.CELL), T.CELL)
    return wide.select(*T.CELL, F.round("exponent", 6).alias("exponent"), F.round("r_squared", 6).alias("r_squared"), "num_pairs", "num_timesteps", F.posexplode("divergence_curve").alias("t", "distance")).withColumn("distance", F.round("distance", 6))


def prompt_rows(s: SparkSession, d: str) -> DataFrame:
    return G.prompt_rows(frames.invocations(s, d), "M0")


def sequence_gaps(s: SparkSession, d: str) -> DataFrame:
    """On orders: line numbers from 1, so a whole order counts them from 0."""
    i = frames.table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") - 1).cast("long").alias("sequence_number"))
    return G.sequence_gaps(i)


def downsample(s: SparkSession, d: str) -> DataFrame:
    return G.downsampled(frames.invocations(s, d), 2, [1, 4]).select("id", "run_id", "sequence_number")


def fixed_points(s: SparkSession, d: str) -> DataFrame:
    return Y.fixed_points(frames.symbols(s, d))


def milestoned_states(s: SparkSession, d: str) -> DataFrame:
    return Y.milestoned(frames.symbols(s, d)).select("run_id", "t", "state")


def transition_matrix(s: SparkSession, d: str) -> DataFrame:
    return Y.transitions(Y.milestoned(frames.symbols(s, d))).withColumn("p", F.round("p", 6))


def dwell_times(s: SparkSession, d: str) -> DataFrame:
    return Y.dwell_times(Y.milestoned(frames.symbols(s, d)))


def transit_share(s: SparkSession, d: str) -> DataFrame:
    return Y.transit_share(frames.symbols(s, d)).withColumn("share", F.round("share", 6))


def balance_violation(s: SparkSession, d: str) -> DataFrame:
    return Y.balance_violation(Y.milestoned(frames.symbols(s, d))).withColumn("violation", F.round("violation", 8))


def scalar_strings(s: SparkSession, d: str) -> DataFrame:
    p = frames.table(s, d, "part")
    name = F.concat_ws(" ", F.col("p_name"), F.col("p_brand"))
    blank = F.when(F.col("p_partkey") % 7 == 0, F.lit(" \t\n")).otherwise(F.col("p_name"))
    return p.select("p_partkey", S.short_id(name).alias("short_id"), S.slug(name).alias("slug"), F.concat_ws(" -> ", "p_type", "p_brand").alias("joined"), F.split("p_brand", "#")[1].alias("part"), S.padded(F.col("p_partkey")).alias("padded"), S.abbreviated(F.col("p_type"), {"ECONOMY": "E", "PROMO": "P"}).alias("abbreviated"), S.or_empty_mark(blank).alias("marked"))


def durations(s: SparkSession, d: str) -> DataFrame:
    e = frames.table(s, d, "events")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", S.iso_micros(F.col("ts")).alias("iso"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("shown"), F.round(S.seconds_between(start, F.col("ts")), 6).alias("seconds"))


def json_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """A JSON field read, written back as JSON, and read again; a null payload stays null."""
    e = frames.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("props"))
    read = F.from_json("props", "k bigint")
    back = F.to_json(F.struct(F.array("k", F.col("event_id")).alias("a")))
    return e.withColumn("k", read["k"]).withColumn("again", F.from_json(back, "a array<bigint>")["a"][0]).select("event_id", "k", "again")


def experiment_status(s: SparkSession, d: str) -> DataFrame:
    out = R.experiment_status(frames.spine(s, d), F.lit(NOW).cast("timestamp"), STALL)
    return out.select("experiment_id", "status", "n_steps", "n_done", F.date_format("last_activity", "yyyy-MM-dd").alias("last_activity"))


def experiment_counts(s: SparkSession, d: str) -> DataFrame:
    spine = frames.spine(s, d)
    c = frames.table(s, d, "customer").select(F.col("c_custkey").alias("experiment_id"))
    o = frames.table(s, d, "orders").select(F.col("o_custkey").alias("experiment_id"))
    return R.experiment_counts(c, runs=o, steps=spine, done=spine.where("completed_at is not null"))


def violations(s: SparkSession, d: str) -> DataFrame:
    steps = K.violations(frames.spine(s, d), "steps", K.step_rules() | K.required("started_at"), F.concat_ws("-", F.col("run_id").cast("string"), F.col("sequence_number").cast("string")))
    runs = frames.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("max_length"))
    more = K.violations(runs, "runs", {"max_length > 1000": F.col("max_length") > 1000}, F.col("run_id"))
    return steps.unionByName(more)


def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    return K.duplicate_keys(frames.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphan_rows(s: SparkSession, d: str) -> DataFrame:
    """Events of users, and orders of customers, that aren't there (customers of one segment are left out)."""
    c = frames.table(s, d, "customer").where("c_mktsegment <> 'BUILDING'")
    o = K.orphans(frames.table(s, d, "orders"), "o_custkey", c, "c_custkey").select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("key"))
    e = K.orphans(frames.table(s, d, "events"), "user_id", c, "c_custkey").select(F.lit("events").alias("table_name"), F.col("event_id").alias("key"))
    return o.unionByName(e)


def cascade_delete_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows that stay and go, by table, when every seventh customer goes."""
    tables = {"customer": frames.table(s, d, "customer"), "orders": frames.table(s, d, "orders"), "lineitem": frames.table(s, d, "lineitem")}
    steps = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    out = None
    for name, (stays, goes) in M.cascade(tables, steps, "customer", tables["customer"].where("c_custkey % 7 = 0")).items():
        n = stays.select(F.lit(True).alias("stays")).unionByName(goes.select(F.lit(False).alias("stays"))).agg(F.sum(F.col("stays").cast("long")).alias("n_left"), F.sum((~F.col("stays")).cast("long")).alias("n_gone")).select(F.lit(name).alias("table_name"), "n_left", "n_gone")
        out = n if out is None else out.unionByName(n)
    return out


_GRID = """net AS (SELECT c_nationkey, list(DISTINCT [lower(c_mktsegment), concat('i', c_nationkey % 3)]) AS networks FROM customer GROUP BY c_nationkey),
pr AS (SELECT p_size % 25 AS n, list(DISTINCT concat('size ', p_size)) AS prompts FROM part GROUP BY 1),
ex AS (SELECT c_nationkey::BIGINT AS experiment_id, networks, prompts, (c_nationkey % 3 + 1)::BIGINT AS num_runs, (c_nationkey % 5 + 2)::BIGINT AS max_length FROM net JOIN pr ON c_nationkey = n),
g1 AS (SELECT experiment_id, unnest(networks) AS net, prompts, num_runs, max_length FROM ex),
g2 AS (SELECT experiment_id, net, unnest(prompts) AS prompt, num_runs, max_length FROM g1),
grid AS (SELECT experiment_id, net, array_to_string(net, '|') AS network, prompt, unnest(range(num_runs)) AS run_number, max_length FROM g2)"""
_STEPS = "st AS (SELECT experiment_id, network, net, prompt, run_number, max_length, unnest(range(max_length)) AS step FROM grid)"
F2 = """f2 AS (SELECT concat(conv_id, '-', turn) AS id, conv_id AS run_id, turn AS sequence_number, CASE WHEN role = 'assistant' THEN 'text' ELSE 'image' END AS type, role AS model, text AS output_text,
  CASE WHEN turn > 0 THEN concat(conv_id, '-', turn - 1) END AS input_invocation_id, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS initial_prompt, 8 AS max_length FROM conversations)"""
F3 = "f3 AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CASE WHEN event_type <> 'error' THEN event_type END AS core, event_type AS caption FROM events)"
_STATES = f"""{F3},
ms AS (SELECT run_id, t, coalesce(last_value(core IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(core IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS state FROM f3),
tr AS (SELECT from_state, to_state, count(*) AS n FROM (SELECT state AS from_state, lead(state) OVER (PARTITION BY run_id ORDER BY t) AS to_state FROM ms) WHERE to_state IS NOT NULL GROUP BY ALL)"""
F5 = """f5 AS (SELECT c_custkey AS experiment_id, o_orderkey AS run_id, l_linenumber AS sequence_number, CASE WHEN c_custkey % 10 <> 0 THEN o_orderdate END AS started_at, CASE WHEN o_orderstatus <> 'O' THEN l_shipdate END AS completed_at
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)"""
_CELL = "experiment_id, network, prompt, embedding_model"

SQL = {
    "run_grid": f"WITH {_GRID} SELECT experiment_id, network, prompt, run_number, max_length FROM grid",
    "missing_runs": f"WITH {_GRID} SELECT experiment_id, network, prompt, run_number, run_number >= 1 AS is_new FROM grid",
    "step_schedule": f"WITH {_GRID}, {_STEPS} SELECT experiment_id, network, prompt, run_number, step, net[step % len(net) + 1] AS model, CASE WHEN step + 1 < max_length THEN net[(step + 1) % len(net) + 1] END AS next_model FROM st",
    "runs_with_model": f"WITH {_GRID} SELECT experiment_id, count(*) AS n_runs FROM grid WHERE list_contains(net, 'i1') GROUP BY ALL",
    "cascade_delete_model": f"""WITH {_GRID}, {_STEPS} SELECT 'runs' AS table_name, count(*) AS n_left FROM grid WHERE NOT list_contains(net, 'i1')
UNION ALL SELECT 'steps', count(*) FROM st WHERE NOT list_contains(net, 'i1') UNION ALL SELECT 'lyapunov_results', count(*) FROM (SELECT DISTINCT experiment_id, network FROM grid WHERE NOT list_contains(net, 'i1'))""",
    "embeddable_invocations": f"WITH {F2} SELECT id, run_id, sequence_number, 'M0' AS embedding_model FROM f2 WHERE type = 'text' AND output_text IS NOT NULL",
    "missing_embeddings": f"WITH {F2} SELECT id, run_id, sequence_number, 'M0' AS embedding_model FROM f2 WHERE type = 'text' AND output_text IS NOT NULL AND (run_id + sequence_number) % 3 <> 0",
    "missing_diagrams": f"WITH {F2} SELECT DISTINCT run_id, 'M0' AS embedding_model FROM f2 WHERE run_id % 3 <> 0",
    "run_resume_state": f"""WITH {F2}, l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence_number DESC) AS k FROM f2)
SELECT run_id, sequence_number + 1 AS next_sequence, id AS input_invocation_id, output_text AS next_input, max_length::BIGINT AS max_length FROM l WHERE k = 1 AND sequence_number + 1 < max_length""",
    "input_output_pairs": f"WITH {F2} SELECT a.id, coalesce(b.output_text, a.initial_prompt) AS input_text, a.output_text FROM f2 a LEFT JOIN f2 b ON b.id = a.input_invocation_id",
    "image_manifest": f"""WITH {F2} SELECT a.run_id, a.sequence_number, concat(a.model, '/', left(regexp_replace(regexp_replace(lower(a.initial_prompt), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40), '/run_', a.run_id, '/seq_', lpad(a.sequence_number::VARCHAR, 3, '0'), '.avif') AS path,
  CASE WHEN coalesce(b.output_text, a.initial_prompt) IS NULL OR regexp_full_match(coalesce(b.output_text, a.initial_prompt), '\\s*') THEN '[empty]' ELSE coalesce(b.output_text, a.initial_prompt) END AS caption, concat(a.model, ' -> ', a.run_id) AS headline
FROM f2 a LEFT JOIN f2 b ON b.id = a.input_invocation_id WHERE a.type = 'image'""",
    "invocation_counts": f"WITH {F2} SELECT run_id, count(*) AS invocation_count FROM f2 GROUP BY run_id",
    "export_invocations": f"WITH {F2} SELECT id, run_id::VARCHAR AS run_id, sequence_number, type, model, output_text, input_invocation_id FROM f2",
    "export_lyapunov": f"""WITH {_WITHIN}, fit AS (SELECT {_CELL}, round(regr_slope(y, t), 6) AS exponent, round(CASE WHEN max(y) > min(y) THEN regr_r2(y, t) END, 6) AS r_squared FROM (SELECT *, ln(greatest(distance, 1e-10)) AS y FROM curve) GROUP BY {_CELL})
SELECT {_CELL}, exponent, r_squared, num_pairs, num_timesteps, t::INT AS t, round(distance, 6) AS distance FROM curve JOIN fit USING ({_CELL})""",
    "prompt_rows": f"""WITH {F2} SELECT id, run_id, sequence_number, concat(id, '-M0') AS embedding_id, output_text FROM f2
UNION ALL SELECT concat('prompt-', run_id), run_id, -1, concat('prompt-', run_id, '-M0'), min(initial_prompt) FROM f2 GROUP BY run_id""",
    "sequence_gaps": """SELECT l_orderkey AS run_id, count(*) AS n_steps, count(DISTINCT l_linenumber) AS n_distinct, max(l_linenumber)::BIGINT AS n_expected FROM lineitem GROUP BY l_orderkey HAVING count(*) <> max(l_linenumber) OR count(DISTINCT l_linenumber) <> max(l_linenumber)""",
    "downsample": f"WITH {F2} SELECT id, run_id, sequence_number FROM f2 WHERE sequence_number % 2 = 0 AND run_id NOT IN (1, 4)",
    "fixed_points": f"""WITH {F3}, c AS (SELECT run_id, t, CASE WHEN lag(caption) OVER (PARTITION BY run_id ORDER BY t) IS DISTINCT FROM caption THEN t END AS changed FROM f3),
r AS (SELECT run_id, max(t) AS last, max(changed) AS at_step FROM c GROUP BY run_id) SELECT run_id, at_step < last AS absorbed, CASE WHEN at_step < last THEN at_step END AS absorbed_at FROM r""",
    "milestoned_states": f"WITH {_STATES} SELECT run_id, t, state FROM ms",
    "transition_matrix": f"WITH {_STATES} SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS p FROM tr",
    "dwell_times": f"""WITH {_STATES}, c AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR lag(state) OVER w IS DISTINCT FROM state THEN 1 ELSE 0 END AS fresh FROM ms WINDOW w AS (PARTITION BY run_id ORDER BY t))
SELECT run_id, min(state) AS state, min(t) AS start, count(*) AS length FROM (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY t) AS k FROM c) GROUP BY run_id, k""",
    "transit_share": f"WITH {F3} SELECT run_id, count(*) AS n_steps, sum((core IS NULL)::INT)::BIGINT AS n_transit, round(sum((core IS NULL)::INT) / count(*), 6) AS share FROM f3 GROUP BY run_id",
    "balance_violation": f"""WITH {_STATES} SELECT least(from_state, to_state) AS state_1, greatest(from_state, to_state) AS state_2, round(abs(sum(CASE WHEN from_state < to_state THEN n ELSE -n END)) / (SELECT sum(n) FROM tr), 8) AS violation FROM tr WHERE from_state <> to_state GROUP BY 1, 2""",
    "scalar_strings": """WITH n AS (SELECT *, concat(p_name, ' ', p_brand) AS name, CASE WHEN p_partkey % 7 = 0 THEN ' ' || chr(9) || chr(10) ELSE p_name END AS blank FROM part)
SELECT p_partkey, left(name, 8) AS short_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, concat(p_type, ' -> ', p_brand) AS joined, split_part(p_brand, '#', 2) AS part,
  CASE WHEN p_partkey < 100 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS padded, CASE p_type WHEN 'ECONOMY' THEN 'E' WHEN 'PROMO' THEN 'P' ELSE p_type END AS abbreviated, CASE WHEN regexp_full_match(blank, '\\s*') THEN '[empty]' ELSE blank END AS marked FROM n""",
    "durations": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 6) AS seconds FROM events",
    "json_roundtrip": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (props->>'$.k')::BIGINT END AS k, CASE WHEN event_id % 5 <> 0 THEN (props->>'$.k')::BIGINT END AS again FROM events",
    "experiment_status": f"""WITH {F5}, e AS (SELECT experiment_id, min(started_at) AS s, count(*) AS n_steps, count(completed_at) AS n_done, coalesce(max(completed_at), max(started_at)) AS l FROM f5 GROUP BY ALL)
SELECT experiment_id, CASE WHEN s IS NULL THEN 'pending' WHEN n_done = n_steps THEN 'completed' WHEN epoch(TIMESTAMP '{NOW}') - epoch(l) > {STALL} THEN 'stalled' ELSE 'running' END AS status, n_steps, n_done, strftime(l, '%Y-%m-%d') AS last_activity FROM e""",
    "experiment_counts": f"""WITH {F5}, o AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT experiment_id AS c, count(*) AS n, count(completed_at) AS k FROM f5 GROUP BY 1)
SELECT c_custkey AS experiment_id, coalesce(o.n, 0) AS runs, coalesce(s.n, 0) AS steps, coalesce(s.k, 0) AS done FROM customer LEFT JOIN o ON o.c = c_custkey LEFT JOIN s ON s.c = c_custkey""",
    "violations": f"""WITH {F5} SELECT 'steps' AS table_name, rule, concat(run_id, '-', sequence_number) AS key FROM f5, (VALUES ('completed_at >= started_at'), ('started_at not null')) r(rule)
WHERE CASE rule WHEN 'started_at not null' THEN started_at IS NULL ELSE completed_at < started_at END UNION ALL SELECT 'runs', 'max_length > 1000', o_orderkey::VARCHAR FROM orders WHERE o_totalprice <= 1000""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "orphan_rows": """WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'orders' AS table_name, o_orderkey AS key FROM orders WHERE o_custkey NOT IN (FROM c) UNION ALL SELECT 'events', event_id FROM events WHERE user_id NOT IN (FROM c)""",
    "cascade_delete_counts": """WITH o AS (SELECT o_orderkey, o_custkey % 7 = 0 AS gone FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) OR o_custkey % 7 <> 0),
l AS (SELECT coalesce(gone, false) AS gone FROM lineitem LEFT JOIN o ON o_orderkey = l_orderkey)
SELECT 'customer' AS table_name, sum((c_custkey % 7 <> 0)::INT)::BIGINT AS n_left, sum((c_custkey % 7 = 0)::INT)::BIGINT AS n_gone FROM customer
UNION ALL SELECT 'orders', sum((NOT gone)::INT)::BIGINT, sum(gone::INT)::BIGINT FROM o UNION ALL SELECT 'lineitem', sum((NOT gone)::INT)::BIGINT, sum(gone::INT)::BIGINT FROM l""",
}

QUERIES = {name: globals()[name] for name in SQL}
