"""Rules that are easy to get wrong, on small frames."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlab.functions import scalars as S
from trajlab.functions import vectors as V
from trajlab.operators import blocks
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
from trajlab.sources import io

STEP = "experiment_id string, network string, prompt string, run_id string, sequence_number long, embedding_model string, embedding_id long, vector array<float>"


def steps(spark, runs):
    """runs: {(prompt, run): vectors}; odd sequence numbers as text steps have."""
    rows = [("e", "n", p, r, 2 * i + 1, "M", 1000 * k + i, [float(x) for x in v]) for k, ((p, r), vs) in enumerate(runs.items()) for i, v in enumerate(vs) if v is not None]
    return T.points(spark.createDataFrame(rows, STEP))


def test_position_not_sequence_number(spark):
    p = steps(spark, {("p", "a"): [[0], None, [2]]})
    assert [(r.sequence_number, r.t) for r in p.orderBy("t").collect()] == [(1, 0), (5, 1)]


def test_small_cells_go(spark):
    p = steps(spark, {("p", "a"): [[0], [1]], ("q", "b"): [[0]], ("q", "c"): [[0], [1]]})
    assert D.within_curves(p).count() == 0


def test_flat_curve_has_no_r_squared(spark):
    p = steps(spark, {("p", "a"): [[0], [0], [0]], ("p", "b"): [[1], [1], [1]]})
    (r,) = D.exponents(D.within_curves(p), T.CELL).collect()
    assert r.exponent == pytest.approx(0) and r.r_squared is None and r.num_pairs == 1 and r.num_timesteps == 3


def test_zero_distance_is_held(spark):
    p = steps(spark, {("p", "a"): [[0], [0]], ("p", "b"): [[0], [1]]})
    (r,) = D.exponents(D.within_curves(p), T.CELL).collect()
    assert r.exponent == pytest.approx(-math.log(1e-10))


def test_known_exponent_across_prompts(spark):
    rng = np.random.default_rng(0)
    runs = {}
    for k in range(8):
        runs[("a", f"a{k}")] = rng.normal(0, 0.01, (60, 4)).tolist()
        b = rng.normal(0, 0.01, (60, 4))
        b[:, 0] += np.exp(0.05 * np.arange(60))
        runs[("b", f"b{k}")] = b.tolist()
    (r,) = D.exponents(D.cross_curves(steps(spark, runs)), D.PAIR).collect()
    assert abs(r.exponent - 0.05) < 0.005 and r.r_squared > 0.999 and r.num_pairs == 64


def test_persistence(spark):
    p = steps(spark, {("p", "a"): [[0], [1], [4], [4]], ("p", "b"): [[0], [2], [3], [9]]})
    bars = P.h0_bars(p)
    assert sorted((r.run_id, r.death) for r in bars.collect()) == [("a", 0), ("a", 1), ("a", 3), ("b", 1), ("b", 2), ("b", 6)]
    e = {r.run_id: r.entropy for r in P.entropy(bars).collect()}
    assert e["a"] == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)))
    runs = p.select("run_id", "embedding_model", F.col("prompt").alias("cell")).distinct()
    assert P.persistence_l1(bars, runs).first().l1 == 3 + 1 + 1


def test_medoid_is_near_plain_mean(spark):
    df = spark.createDataFrame([(1, 1, [0.0]), (1, 2, [1.0]), (1, 3, [5.0])], "c int, id long, v array<double>")
    assert C.medoids(df, ["c"]).first().medoid == 2


def test_density_layers(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(5 * (i % 2), 0.1), 0.0]) for i in range(30)] + [(99, [50.0, 50.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = C.density_layers(df, [1.0]).collect()
    assert len(found) == 31 and {r.cluster for r in found} == {0, 1, None}
    assert [r.cluster for r in found if r.id == 99] == [None]
    assert C.density_layers(df.limit(15), [1.0]).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, float("nan"), 4.0],), ([0.0, 0.0, 0.0],), ([float("inf"), 1.0, 0.0],)], "v array<float>")
    assert [r.v for r in df.select(V.finalised(F.col("v")).alias("v")).collect()] == [[0.6, 0.0, 0.8], [0.0] * 3, [0.0, 1.0, 0.0]]


def test_strings(spark):
    df = spark.createDataFrame([("  A b--C! ", 7), (" \t", 1234), (None, 0)], "s string, n long")
    assert [tuple(r) for r in df.select(S.slug(F.col("s")), S.padded(F.col("n")), S.or_empty_mark(F.col("s"))).collect()] == [("a_b_c", "007", "  A b--C! "), ("", "1234", "[empty]"), (None, "000", "[empty]")]


def test_grid_and_backfill(spark):
    e = spark.createDataFrame([(1, [["A", "B"], ["C"]], ["x", "y", "z"], 4, 3)], "experiment_id long, networks array<array<string>>, prompts array<string>, num_runs long, max_length long")
    grid = G.run_grid(e)
    assert grid.count() == 24
    assert G.missing_runs(grid, grid.where("run_number < 2")).count() == 12
    assert G.all_runs(grid, grid.where("run_number < 2")).count() == 24
    assert [(r.step, r.model, r.next_model) for r in G.step_schedule(grid.where("run_number = 0 and prompt = 'x' and size(network) = 2")).orderBy("step").collect()] == [(0, "A", "B"), (1, "B", "A"), (2, "A", None)]
    assert G.runs_with_model(grid, "C").count() == 12


def test_rules_at_their_bounds(spark):
    t = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(0, t, t), (-1, t, t), (1, t, t - dt.timedelta(hours=1)), (2, None, t)], "sequence_number long, started_at timestamp, completed_at timestamp")
    found = K.violations(df, "steps", K.step_rules(), F.col("sequence_number")).collect()
    assert sorted((r.key, r.rule) for r in found) == [("-1", "sequence_number >= 0"), ("1", "completed_at >= started_at")]
    assert K.valid(df, K.step_rules()).count() == 2
    out = spark.createDataFrame([("text", "a", None), ("text", "a", b"x"), ("image", None, b"x"), ("image", None, None)], "type string, output_text string, output_image binary")
    assert K.violations(out, "i", K.output_rules(), F.col("type")).count() == 2
    e = spark.createDataFrame([(1, 1, [["a"]], ["p"], ["m"]), (0, 1, [[]], ["p"], ["m"]), (1, 0, [], [], None)], "max_length long, num_runs long, networks array<array<string>>, prompts array<string>, embedding_models array<string>")
    assert sorted(r.rule for r in K.violations(e, "e", K.experiment_rules(), F.lit("k")).collect()) == ["max_length > 0", "networks non-empty", "networks non-empty", "num_runs > 0", "prompts non-empty"]


def test_status(spark):
    now = dt.datetime(2024, 1, 2)
    h = dt.timedelta(hours=1)
    rows = [(1, None, None), (2, now - 5 * h, now - 4 * h), (3, now - 5 * h, None), (4, now - h / 2, None)]
    df = spark.createDataFrame(rows, "experiment_id long, started_at timestamp, completed_at timestamp")
    out = R.experiment_status(df, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert [r.status for r in out.orderBy("experiment_id").collect()] == ["pending", "completed", "stalled", "running"]


def test_symbols(spark):
    df = spark.createDataFrame([(1, i, c, c or "x") for i, c in enumerate([None, "a", None, "b", "b"])] + [(2, 0, None, "x")], "run_id long, t long, core string, caption string")
    states = Y.milestoned(df)
    assert [r.state for r in states.orderBy("run_id", "t").collect()] == ["a", "a", "a", "b", "b", None]
    assert sorted((r.state, r.length) for r in Y.dwell_times(states.where("run_id = 1")).collect()) == [("a", 3), ("b", 2)]
    assert {(r.from_state, r.to_state): r.p for r in Y.transitions(states).collect()} == {("a", "a"): 2 / 3, ("a", "b"): 1 / 3, ("b", "b"): 1.0}
    assert [(r.absorbed, r.absorbed_at) for r in Y.fixed_points(df).orderBy("run_id").collect()] == [(True, 3), (False, None)]


def test_deletes(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent long")
    doomed = spark.createDataFrame([(1,)], "id long")
    assert sorted(r.id for r in M.without(df, "parent", doomed).collect()) == [1, 3]
    assert sorted((r.id, r.parent) for r in M.nulled(df, "parent", doomed).collect() if r.parent) == [(3, 2)]


def test_heatmap_keeps_a_zero(spark):
    rows = [("e", "n", "M", "identical", p, 1.0) for p in "ab"] + [("e", "n", "M", "paraphrase", "a || b", 0.0)]
    cells = D.heatmap(spark.createDataFrame(rows, "experiment_id string, network string, embedding_model string, category string, prompt_or_pair string, ftle double"))
    assert {(r.row_label, r.col_label): r.ftle for r in cells.collect()} == {("p1", "p1"): 1, ("p2", "p2"): 1, ("p1", "p2"): 0, ("p2", "p1"): 0}


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"networks": [["a"]], "prompts": ["p"],\n "embedding_models": ["m"], "max_length": 4, "other": 1}')
    assert io.read_config(spark, str(tmp_path / "c.json")).first().num_runs == 1
    (tmp_path / "d.json").write_text('{"networks": [["a"]]}')
    with pytest.raises(ValueError, match="prompts, embedding_models, max_length"):
        io.read_config(spark, str(tmp_path / "d.json"))
    df = spark.createDataFrame([("e", 'a,"b', "m", "identical", "p", -2.69e-5, None, 3, 4)], io.FTLE)
    io.write_ftle_csv(df, str(tmp_path / "csv"))
    assert io.read_ftle_csv(spark, str(tmp_path / "csv")).collect() == df.collect()
    blobs = spark.createDataFrame([(np.array([1, 2], "<f4").tobytes(),), (None,)], "v binary")
    assert [r.v for r in io.vectors_of_blobs(blobs, "v").collect()] == [[1.0, 2.0], None]
    assert io.write_dump({"t": df}, str(tmp_path / "dump"))[0][2] == 1
    assert io.read_dump(spark, str(tmp_path / "dump"), ["t"])["t"].count() == 1


def model_tables(spark):
    from trajlab.sources import model

    return model.tables(spark, "/root/testdata/sf0.001")


def test_ids(spark):
    e = model_tables(spark)["experiments"]
    assert E.by_prefix(e, "exp").first().id == "exp0"
    with pytest.raises(ValueError, match="'nothing'"):
        E.by_prefix(e, "nothing")
    assert {r.id for r in E.by_id(e, "exp1", "gone").collect()} == {"exp1"}


def test_export_writes_eight_tables(spark, tmp_path):
    t = model_tables(spark)
    n = {name: rows for name, _, rows in E.export(t, ["exp0"], str(tmp_path), models=["M1"])}
    assert set(n) == set(io.TABLES) and n["lyapunov_results"] == 0 and n["clustering_results"] == 1
    back = io.read_dump(spark, str(tmp_path))
    assert all(back[name].count() == n[name] for name in n)
    assert "output_image" not in back["invocations"].columns and dict(back["runs"].dtypes)["network"] == "string"
    assert {r.embedding_model for r in back["embeddings"].collect()} == {"M1"}


def test_embed_with_any_callable(spark):
    def lengths(batches):
        loaded = 10.0  # as a model would be, once a task
        for texts in batches:
            yield texts.map(lambda s: [loaded, float(len(s))])

    t = E.exported(model_tables(spark), ["exp1"], text_models={"M0": E.embedder(lengths)})
    rows = t["embeddings"].where("id like 'prompt-%'").collect()
    assert rows and all(r.vector == [10.0, 8.0] and r.id == f"{r.invocation_id}-M0" for r in rows)
    none = E.prompt_rows(E.scoped_tables(model_tables(spark), ["exp1"]), {"V0": E.embedder(lengths)})
    assert none["invocations"].count() == none["embeddings"].count() == 0


def test_exported_steps_are_in_order_through_the_files(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        E.export(model_tables(spark), ["exp0", "exp1"], str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{tmp_path}/invocations.parquet/part-*"))
    rows = [tuple(r.values()) for f in files for r in pq.read_table(f, columns=["run_id", "sequence_number"]).to_pylist()]
    assert len(files) > 1 and len(rows) > 100 and rows == sorted(rows)


@pytest.fixture
def store(spark, tmp_path):
    from trajlab.sources.store import Store

    return Store(spark, str(tmp_path / "store"))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_replacing_leaves_nothing_behind(spark, store):
    rows = spark.createDataFrame([("a", 1), ("b/ =", 2), (None, 3)], "m string, x int")
    store.replace(t=(rows, "m", ["a", "b/ ="]))
    assert rows_of(store.read("t")) == [("a", 1), ("b/ =", 2)]
    store.replace(t=(spark.createDataFrame([("a", 9), ("c", 4)], "m string, x int"), "m", ["a"]))
    assert rows_of(store.read("t")) == [("a", 9), ("b/ =", 2)] and rows_of(store.read("t", "a")) == [("a", 9)]
    store.replace(t=(rows.limit(0), "m", ["a"]))
    assert rows_of(store.read("t")) == [("b/ =", 2)] and store.read("t", "a").count() == 0
    store.replace(t=(rows.limit(0), "m", ["b/ ="]))
    assert store.read("t").count() == 0 and store.read("t").columns == ["m", "x"]
    assert rows_of(store.read("t", version=1)) == [("a", 1), ("b/ =", 2)]


def test_a_change_that_fails_before_it_is_published_is_none(spark, store, monkeypatch):
    """Layers and assignments change together or not at all; what was written in vain goes."""
    def layers(n):
        runs = spark.createDataFrame([(f"r{n}", "A"), (f"q{n}", "B")], "id string, embedding_model string")
        assigned = spark.createDataFrame([(f"x{i}{n}", "A" if i < 3 else "B") for i in range(5)], "id string, _model string")
        return {"clustering_results": runs, "embedding_clusters": assigned}

    def now():
        return rows_of(store.read("clustering_results")), rows_of(store.read("embedding_clusters"))

    M.clusterings_replaced(store, ["A", "B"], layers(1))
    before = now()
    publish = type(store).publish
    monkeypatch.setattr(type(store), "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        M.clusterings_replaced(store, ["A"], layers(2))
    assert now() == before and store.version() == 1
    monkeypatch.setattr(type(store), "publish", publish)
    broken = layers(2) | {"embedding_clusters": layers(2)["embedding_clusters"].withColumn("id", F.raise_error(F.lit("lost")))}
    with pytest.raises(Exception, match="lost"):
        M.clusterings_replaced(store, ["A"], broken)
    assert now() == before
    n_folders = len(store._listed("clustering_results"))
    M.clusterings_replaced(store, ["A"], layers(2))
    assert now() == ([("q1", "B"), ("r2", "A")], [("x02",), ("x12",), ("x22",), ("x31",), ("x41",)])
    store.vacuum()
    assert now()[0] == [("q1", "B"), ("r2", "A")] and len(store._listed("clustering_results")) <= n_folders
    assert store._listed("_commits")[-1].startswith("000000000002") and len([n for n in store._listed("_commits") if n.endswith(".json")]) == 1
    M.clusterings_replaced(store, ["B"], {k: v.limit(0) for k, v in layers(3).items()})
    assert now() == ([("r2", "A")], [("x02",), ("x12",), ("x22",)])


def test_two_changes_at_once_conflict(spark, store):
    from trajlab.sources.store import Conflict

    rows = spark.createDataFrame([("a", 1)], "m string, x int")
    store.replace(t=(rows, "m", ["a"]))
    state = store.state()
    store.replace(t=(rows, "m", ["a"]))
    with pytest.raises(Conflict):
        store.publish(state, 1)
    assert store.version() == 2 and rows_of(store.read("t")) == [("a", 1)]


def test_a_batch_appended_twice_is_there_once(spark, store):
    key = ["invocation_id", "embedding_model"]
    batch = spark.createDataFrame([("1", "i", "A", [1.0]), ("2", "i", "A", [2.0]), ("3", "i", "B", [3.0]), ("4", None, "A", [4.0])], "id string, invocation_id string, embedding_model string, vector array<double>")
    assert store.append("embeddings", batch, "embedding_model", key) == 2
    assert store.append("embeddings", batch, "embedding_model", key) == 0 and store.version() == 1
    more = spark.createDataFrame([("0", "i", "A", [0.0]), ("9", "j", "C", [9.0])], batch.schema)
    assert store.append("embeddings", more, "embedding_model", key) == 1
    assert sorted(r.id for r in store.read("embeddings").collect()) == ["1", "3", "9"]
    assert store.append("embeddings", batch.limit(0), "embedding_model", key) == 0
    store.replace(embeddings=(more, "embedding_model", ["A"]))
    assert sorted(r.id for r in store.read("embeddings").collect()) == ["0", "3", "9"]


def test_new_clustering_of_a_model(spark, store):
    """Layers of vectors become the two tables, and take the place of the model's old ones alone."""
    rng = np.random.default_rng(2)
    rows = [(m, f"{m}{i:03d}", rng.normal(10 * (i % 2), 0.3, 3).tolist()) for m in "AB" for i in range(40)] + [("C", f"C{i}", [0.0, 0.0, float(i)]) for i in range(9)]
    vectors = spark.createDataFrame(rows, "embedding_model string, id string, v array<double>")
    found = C.clusterings(vectors, ["embedding_model"], [0.9])
    new = C.clustering_tables(found, vectors, "density", {"quantiles": "0.9"}, F.lit("2024-01-01").cast("timestamp"))
    M.clusterings_replaced(store, ["A", "B", "C"], new)
    assert [(r.id, r.layer) for r in store.read("clustering_results").orderBy("id").collect()] == [("density-A-0", 0), ("density-B-0", 0)]
    got = store.read("embedding_clusters").collect()
    assert len(got) == 80 and all((r.medoid_embedding_id or r.embedding_id)[0] == r.embedding_id[0] for r in got)
    medoids = {r.medoid_embedding_id for r in got if r.embedding_id[0] == "A"} - {None}
    assert len(medoids) == 2 and {int(m[1:]) % 2 for m in medoids} == {0, 1}
    M.clusterings_replaced(store, ["A"], {k: v.limit(0) for k, v in new.items()})
    assert store.read("embedding_clusters").count() == 40 and store.read("clustering_results").count() == 1


def test_deleting_writes_what_stays_in_one_commit(spark, store):
    t = model_tables(spark)
    tags = {"experiments": "id", "runs": "experiment_id", "invocations": "type", "embeddings": "embedding_model", "persistence_diagrams": "embedding_model", "lyapunov_results": "experiment_id", "embedding_clusters": "clustering_result_id"}
    for name, tag in tags.items():
        store.append(name, t[name], tag, ["id"])
    before = {n: store.read(n).count() for n in tags}
    rows = M.experiments_deleted({n: store.read(n) for n in tags}, E.by_id(store.read("experiments"), "exp1"))
    want = {r.table_name: (r.n_left, r.n_gone) for r in M.counted(rows).collect()}
    M.deleted(store, rows, tags)
    assert {n: (store.read(n).count(), before[n] - store.read(n).count()) for n in tags} == want and all(x[1] > 0 for x in want.values())
    assert store.read("runs").where("experiment_id = 'exp1'").count() == 0 and store.version() == 8
    assert K.orphans(store.read("embedding_clusters"), "embedding_id", store.read("embeddings"), "id").count() == 0


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    """Text and image bytes go to the models of their kind in batches; what isn't registered or of another kind stays."""
    from trajlab.operators import embedding as B

    seen = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{seen}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def embed(contents):
            assert 0 < len(contents) <= 3
            return np.array([[len(c), float(isinstance(c, bytes)), float("nan")] for c in contents])

        return embed

    models = {"T": B.Model("text", load, batch=3), "I": B.Model("image", load, batch=3, raw=True)}
    rows = [(f"s{i}", "T" if i % 2 else "I", "abc" if i % 2 else None, None if i % 2 else b"abcd") for i in range(40)] + [("s40", "other", "x", b"x")]
    wanted = spark.createDataFrame(rows, "id string, embedding_model string, output_text string, output_image binary").repartition(8)
    got = {r.invocation_id: r for r in B.embedded(wanted, models).collect()}
    assert len(got) == 40 and all(r.vector == pytest.approx([1.0, 0.0, 0.0]) for r in got.values() if r.embedding_model == "T")
    assert all(r.vector[:2] == [4.0, 1.0] and math.isnan(r.vector[2]) for r in got.values() if r.embedding_model == "I")
    import os

    loads = [f.split("-")[1] for f in os.listdir(seen)]
    assert all(loads.count(p) <= 2 for p in loads)


def test_filled_vectors_are_missing_no_more(spark, store):
    from trajlab.operators import embedding as B
    from trajlab.plans.files import REGISTRY

    t = model_tables(spark)
    t["embeddings"] = t["embeddings"].where("embedding_model <> 'V0'")
    store.append("embeddings", t["embeddings"], "embedding_model", ["invocation_id", "embedding_model"])
    new = B.filled(t, REGISTRY, F.lit("2024-01-01").cast("timestamp"))
    n = new.count()
    assert n > 0 and store.append("embeddings", new, "embedding_model", ["invocation_id", "embedding_model"]) == n
    kinds = {k: m.kind for k, m in REGISTRY.items()}
    assert B.missing(t | {"embeddings": store.read("embeddings")}, kinds).count() == 0
    assert {r[0] for r in new.select(F.size("vector")).distinct().collect()} == {256}


@pytest.mark.parametrize("wide", [3, 256])
def test_curves_of_wide_cells(spark, wide):
    """Cells cut into blocks of runs have the curves that they have whole."""
    rng = np.random.default_rng(1)
    runs = {(p, f"{p}{k}"): rng.normal(0, 1, (4 + k % 2, 3)).tolist() for p, m in (("a", 11), ("b", 7), ("c", 2)) for k in range(m)}
    p = steps(spark, runs)
    x = {q: np.array([v[:4] for (r, _), v in runs.items() if r == q], np.float32).astype(float) for q in "abc"}
    same = {(r.prompt, r.t): (r.distance, r.num_pairs) for r in D.within_curves(p, wide).collect()}
    for q, v in x.items():
        for t in range(4):
            d = all_distances(v[:, t])[np.triu_indices(len(v), 1)]
            assert same[q, t] == (pytest.approx(d.mean()), len(d))
    cross = {(r.prompt_1, r.prompt_2, r.t): (r.distance, r.num_pairs) for r in D.cross_curves(p, wide).collect()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        for t in range(4):
            d = np.sqrt(((x[a][:, None, t] - x[b][None, :, t]) ** 2).sum(2))
            assert cross[a, b, t] == (pytest.approx(d.mean()), d.size)


def test_a_wide_cell_is_many_keys(spark):
    """One cell of 5,000 runs: no task of the join has over ten times the median's rows."""
    n = 5000
    rows = spark.range(2 * n).select(F.lit("e").alias("experiment_id"), F.lit("n").alias("network"), F.lit("p").alias("prompt"), F.concat(F.lit("r"), (F.col("id") % n).cast("string")).alias("run_id"), (F.col("id") / n).cast("long").alias("sequence_number"), F.lit("M").alias("embedding_model"), F.col("id").alias("embedding_id"), F.array((F.col("id") % n).cast("float")).alias("vector"))
    got = {r.t: r for r in D.within_curves(T.points(rows)).collect()}
    assert {t: r.num_pairs for t, r in got.items()} == {0: n * (n - 1) // 2, 1: n * (n - 1) // 2}
    assert got[0].distance == pytest.approx((n + 1) / 3)
    own, blocks = D._block("run_id", F.lit(n), D.WIDE)
    sizes = [r["count"] for r in rows.where("sequence_number = 0").select(own.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j")).groupBy("i", "j").count().collect()]
    assert len(sizes) == 400 and max(sizes) <= 2 * sorted(sizes)[200]


def test_run_rules(spark):
    df = spark.createDataFrame([(1, 0, ["a"], "p"), (0, -1, [], "")], "max_length long, run_number long, network array<string>, initial_prompt string")
    assert len(K.violations(df, "runs", K.run_rules(), F.lit("k")).collect()) == 4


def test_times_shown(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),), (None,)], "t timestamp")
    assert [tuple(r) for r in df.select(S.shown_time(F.col("t")), S.exif_time(F.col("t"))).collect()] == [("2024-01-02 03:04:05", "2024:01:02 03:04:05"), ("-", "")]


def walk(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    x = {r: rng.integers(0, 4, (m, 2)).astype(float) for r, m in (("a", n), ("b", n // 2), ("c", 1))}
    return x, steps(spark, {("p", r): v.tolist() for r, v in x.items()})


def all_distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


@pytest.mark.parametrize("block", [7, 1024])
def test_blocks_see_every_pair_of_a_run_once(spark, block):
    """First returns, radius and edge counts of runs cut into blocks, as all pairs give them."""
    x, p = walk(spark)
    got = {r.run_id: (r.n_returns, r.mean_return) for r in T.return_times(p, 1.2, 3, block).collect()}
    edges = {r.run_id: (r.num_edges, r.radius) for r in P.rips_edges(p, block).collect()}
    assert set(edges) == {"a", "b"}
    for run in "ab":
        d = all_distances(x[run])
        first = [min(k) for i in range(len(d)) if (k := [j - i for j in range(i + 3, len(d)) if d[i, j] < 1.2])]
        assert got[run] == (len(first), pytest.approx(np.mean(first)))
        radius = np.round(d, 9).max(1).min()
        assert edges[run] == ((np.round(d, 9)[np.triu_indices(len(d), 1)] <= radius).sum(), pytest.approx(radius))


def heights(w):
    """The weights of a least spanning tree of a full matrix, plainly."""
    near, out, left = w[0].copy(), [], set(range(1, len(w)))
    while left:
        at = min(left, key=lambda i: near[i])
        left.remove(at)
        out.append(near[at])
        near = np.minimum(near, w[at])
    return sorted(out)


@pytest.mark.parametrize("block", [5, 16, 1024])
def test_bars_of_runs_in_blocks(spark, block):
    """Coinciding points give bars of no length, whatever the blocks."""
    x, p = walk(spark)
    bars = {}
    for r in P.h0_bars(p, block).collect():
        bars.setdefault(r.run_id, []).append(r.death)
    assert set(bars) == {"a", "b"} and all(sorted(bars[r]) == pytest.approx(heights(all_distances(x[r])), abs=0) for r in "ab")


def test_least_forest_of_many_clouds(spark):
    """Boruvka's rounds against Kruskal's order, with equal weights, long chains, loops and apart pieces."""
    from trajlab.operators import spanning as N
    from trajlab.operators.graph import components

    rng = np.random.default_rng(8)
    rows = [("chain", i, i + 1, 1.0) for i in range(40)] + [("fall", i, i + 1, float(i)) for i in range(40)] + [("one", 1, 2, 0.5), ("two", 1, 2, 0.5), ("two", 1, 2, 0.25), ("two", 8, 9, 0.5)]
    rows += [("dense", i, j, float(rng.integers(0, 6))) for i in range(25) for j in range(i + 1, 25) if rng.random() < 0.6]
    edges = spark.createDataFrame(rows, "g string, u long, v long, w double")
    want = []
    label = {}
    for g, u, v, w in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        a, b = label.setdefault((g, u), (g, u)), label.setdefault((g, v), (g, v))
        if a != b:
            want.append((g, u, v, w))
            label = {k: min(a, b) if x in (a, b) else x for k, x in label.items()}
    for most in (0, 30, 1000):
        assert sorted(map(tuple, N.least_forest(edges, ["g"], most).select("g", "u", "v", "w").collect())) == sorted(want)
        got = components(edges, edges.select("g", "u").union(spark.createDataFrame([("one", 2), ("one", 77)], "g string, u long")), "g", most)
        assert {(r.g, r.u): r.label for r in got.collect()} == {k: label.get(k, k)[1] for k in {(g, u) for g, u, _, _ in rows} | {("one", 2), ("one", 77)}}
    assert N.least_forest(edges.limit(0), ["g"]).count() == 0
    cuts = {(r.g, r.level): r.cut for r in N.quantile_cuts(edges.where("g in ('fall', 'one')"), ["g"], [0.75, 0.25]).collect()}
    assert cuts == {("fall", 0): 9.0, ("fall", 1): 29.0, ("one", 0): 0.5, ("one", 1): 0.5}


def test_several_models_at_once(spark):
    """Each model is cut at quantiles of its own tree; blocks change nothing; a small model has no layer."""
    rng = np.random.default_rng(9)
    x = {"A": np.concatenate([rng.normal(c, 0.1, (20, 3)) for c in (0, 3, 9)] + [rng.normal(0, 30, (5, 3))]), "B": np.concatenate([rng.normal(c, 2.0, (15, 3)) for c in (0, 40)]), "C": rng.normal(0, 1, (15, 3))}
    df = spark.createDataFrame([(m, 100 * k + i, v.tolist()) for k, (m, vs) in enumerate(x.items()) for i, v in enumerate(vs)], "embedding_model string, id long, v array<double>")
    key = ["embedding_model"]
    tree = C.merges(df, key, block=17)
    for m, vs in x.items():
        d = all_distances(vs)
        core = np.sort(d, 1)[:, 5]
        assert sorted(r.w for r in tree.where(F.col("embedding_model") == m).collect()) == pytest.approx(heights(np.maximum(np.maximum(core[:, None], core[None]), d)), abs=1e-8)
    found = {}
    for r in C.clusterings(df, key, block=17).collect():
        found.setdefault((r.embedding_model, r.layer), {})[r.id] = r.cluster
    assert set(m for m, _ in found) == {"A", "B"} and all(len(v) == len(x[m]) for (m, _), v in found.items())
    # clusters of A lie each in one of its crowds of twenty
    assert all(c // 20 == i // 20 and i < 60 for (m, _), v in found.items() if m == "A" for i, c in v.items() if c is not None)
    assert max(len(set(v.values()) - {None}) for (m, _), v in found.items() if m == "A") == 3
    whole = {(r.embedding_model, r.layer, r.id): r.cluster for r in C.clusterings(df, key).collect()}
    assert whole == {(m, k, i): c for (m, k), v in found.items() for i, c in v.items()}


def curved(n, seed=0):
    """Points of a bent sheet of three dimensions in forty, as embeddings lie, a third of them in one spot."""
    rng = np.random.default_rng(seed)
    z = rng.uniform(-1, 1, (n, 3))
    z[: n // 3] *= 0.05
    turn = rng.normal(0, 1, (6, 40))
    return np.concatenate([z, np.sin(2 * z)], 1) @ turn


def test_neighbours_by_lists_of_centres(spark):
    """Nine tenths of the nearest are found, distances are exact, and each point meets a bounded number of lists."""
    x = curved(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = all_distances(x)
    want = np.argsort(d, 1)[:, 1:6]
    got = C.nearest(df, 5, block=128, probes=6).collect()
    assert len(got) == 15000 and all(abs(r.d - d[r.id, r.other]) < 1e-9 for r in got)
    hits = {(r.id, r.other) for r in got}
    assert sum((i, int(j)) in hits for i in range(3000) for j in want[i]) / 15000 >= 0.9
    lists = C.listed(df.withColumn("g", F.lit(1)), ["g"], 6, 128)
    assert lists.count() == 6 * 3000 and lists.select("id", "_list").distinct().count() == 6 * 3000
    assert lists.select("_list").distinct().count() > 100


def test_clusters_by_lists_of_centres(spark):
    """Beyond the size where all meet all, crowds are still told apart."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.2, (300, 6)) + c for c in np.eye(6)[:4] * 10])
    df = spark.createDataFrame([("M", i, v.tolist()) for i, v in enumerate(x)], "embedding_model string, id long, v array<double>")
    tree = C.merges(df, ["embedding_model"], block=128, exact=1000, probes=4)
    cuts = spark.createDataFrame([("M", 0, 3.0)], "embedding_model string, level int, cut double")
    got = {r.id: r.cluster for r in C.layers(df, tree, cuts, ["embedding_model"]).collect()}
    assert [len({got[i] for i in range(300 * k, 300 * k + 300)}) for k in range(4)] == [1] * 4 and len(set(got.values())) == 4


def test_forests_connect_what_all_pairs_do(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (90, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    cores = C.core_distances(df, 3, block=20)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, 3]
    assert {r.id: r.core for r in cores.collect()} == pytest.approx(dict(enumerate(core)))
    edges = [(r.u, r.v, r.w) for r in C.reachability_edges(df, cores, 0.6, block=20).collect()]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)

    def parts(pairs):
        label = list(range(90))
        for u, v in pairs:
            a, b = label[u], label[v]
            label = [min(a, b) if c in (a, b) else c for c in label]
        return label

    for radius in (0.2, 0.35, 0.6):
        assert parts([(u, v) for u, v, w in edges if w <= radius]) == parts([(i, j) for i in range(90) for j in range(i) if reach[i, j] <= radius])


def test_lone_prompt_has_a_zero_curve(spark):
    p = steps(spark, {("p", "a"): [[0], [1], [2]], ("p", "b"): [[1], [3], [5]]})
    got = D.paraphrase_curves(D.within_curves(p), D.cross_curves(p)).orderBy("t").collect()
    assert [(r.t, r.distance) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_pool_of_zeros(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (2, [float("nan"), 4.0]), (2, [2.0, 0.0])], "g int, v array<double>")
    assert sorted((r.g, r.i, r.x) for r in C.mean_pooled(df, ["g"]).collect()) == [(1, 0, 0.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 2.0)]


def test_blocks_of_a_cloud_are_few(spark):
    """A point is sent a bounded number of times, however many tiles a cloud has; all pairs still meet."""
    df = spark.createDataFrame([("g", i, [float(i)]) for i in range(300)], "g string, id long, v array<double>")
    sent = blocks.dealt(df, ["g"], [], block=2).select(F.sum(F.size("_rows")).alias("n")).first().n
    assert sent <= 300 * blocks.SIDES
    pairs = blocks.meet(df, ["g"], lambda a, b: {"n": np.array([len(a["v"]) * (len(a["v"]) - 1) // 2 if b is None else len(a["v"]) * len(b["v"])])}, "n long", block=2)
    assert pairs.agg(F.sum("n")).first()[0] == 300 * 299 // 2


def test_nearest_among_copies_and_far_points(spark):
    """Near copies beside a far point: single precision alone can't tell them apart. Ties go to the least id."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1e-6, (60, 5)) + 1, np.ones((20, 5)), rng.normal(0, 1, (40, 5)), [[1e4] * 5]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r.id, r["rank"]): (r.other, r.d) for r in C.nearest(df, 4, block=16).collect()}
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert len(got) == 4 * len(x)
    for i in range(len(x)):
        for k in range(4):
            other, far = got[i, k + 1]
            assert far == pytest.approx(d[i, order[i, k]], rel=1e-9, abs=0)
            assert other == order[i, k] or abs(d[i, other] - far) < 1e-12


def test_a_value_of_a_row_is_computed_once(spark):
    """A finalised vector's norm was computed for each of its numbers: then this took minutes."""
    df = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(2048)), lambda i: (i + F.col("id")).cast("float")).alias("v"))
    began = time.time()
    got = df.select(V.finalised(F.col("v"), 2048).alias("v")).agg(F.sum(V.norm(F.col("v")))).first()[0]
    assert got == pytest.approx(400) and time.time() - began < 30


def test_trees_of_apart_crowds_by_few_edges(spark):
    """Crowds that no nearest joins, copies among them: the tree has the right heights, and what pairs of blocks
    give is a few edges a point, however many tiles there are. Ids may be texts."""
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(c, 0.2, (50, 3)) for c in (0, 5, 11)] + [np.ones((20, 3)) * 30, rng.normal(0, 20, (10, 3))])
    df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    d = all_distances(x)
    core = np.sort(d, 1)[:, 5]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    assert sorted(r.w for r in C.merges(df.withColumn("g", F.lit(1)), ["g"], block=4).collect()) == pytest.approx(heights(reach), abs=1e-8)
    edges = [(int(r.u), int(r.v), r.w) for r in C.reachability_edges(df, C.core_distances(df, block=4), 9.0, block=4).collect()]
    assert len(edges) < 6 * len(x)
    for radius in (0.3, 1.0, 9.0):
        label = list(range(len(x)))
        for u, v, w in edges:
            if w <= radius:
                a, b = label[u], label[v]
                label = [min(a, b) if c in (a, b) else c for c in label]
        want = list(range(len(x)))
        for u, v in zip(*np.nonzero(np.triu(reach <= radius, 1)), strict=True):
            a, b = want[u], want[v]
            want = [min(a, b) if c in (a, b) else c for c in want]
        assert label == want


def test_paths_beyond_the_order_of_one_task(spark, monkeypatch):
    """Clouds too large to be put in order in one task give the same forest."""
    from trajlab.operators import spanning

    x = np.random.default_rng(4).normal(0, 1, (80, 3))
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, v array<double>")
    ordered = sorted(r.w for r in C.merges(df, ["g"], block=8).collect())
    monkeypatch.setattr(spanning, "ORDERED", 10)
    assert sorted(r.w for r in C.merges(df, ["g"], block=8).collect()) == pytest.approx(ordered)


def test_features_of_characters(spark):
    """Each character was sought from the text's start, and the text's length taken for each of the 256 numbers."""
    texts = ["", "a", "abc", "x" * 100, "y" * 101, "é€😀z", "ab\0c", None, " \n", "z" * 12_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", V.char_features(F.col("s")).alias("v"))
    began = time.time()
    got = {r.i: r.v for r in df.collect()}
    assert time.time() - began < 8
    for i, s in enumerate(texts):
        head = [None] * 100 if s is None else [ord(c) / 255.0 for c in s[:100]]
        assert got[i] == head + [0.0] * (256 - len(head))


def test_seeded_features_are_made_in_small_batches():
    import pyarrow as pa

    from trajlab.plans.clusters import _seeded

    texts = [f"text {i} é😀" for i in range(1000)]
    made = list(_seeded(iter([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])])))
    assert sum(b.num_rows for b in made) == 1000 and max(b.num_rows for b in made) <= 256
    v = made[-1].column("v")[-1].as_py()
    assert v == np.random.RandomState(sum(map(ord, texts[-1]))).rand(256).tolist()


def test_embedding_is_dealt_to_several_tasks(spark):
    from trajlab.operators import embedding as B

    wanted = spark.range(0, 200, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("M").alias("embedding_model"), F.lit("text").alias("output_text"), F.lit(None).cast("binary").alias("output_image"))
    made = B.embedded(wanted, {"M": B.Model("text", B.characters)})
    assert made.count() == 200 and made.select(F.spark_partition_id()).distinct().count() > 1


def test_blocks_of_one_key_meet_in_several_tasks(spark):
    df = spark.createDataFrame([(m, i, [float(i)]) for m in "AB" for i in range(200)], "m string, id long, v array<double>")
    from pyspark import TaskContext

    made = blocks.meet(df, ["m"], lambda a, b: {"task": np.array([TaskContext.get().partitionId()])}, "task long", block=10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = {r.m: r.n for r in made.groupBy("m").agg(F.countDistinct("task").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert min(per.values()) > 1


def test_lists_reach_the_recall_where_nothing_bends(spark):
    """Noise of many dimensions, where the first lists have too few of the nearest."""
    x = np.random.default_rng(6).normal(0, 1, (3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = all_distances(x)
    want = np.argsort(d, 1)[:, 1:6]
    got = {(r.id, r.other) for r in C.nearest(df, 5, block=64, probes=2).collect()}
    assert sum((i, int(j)) in got for i in range(len(x)) for j in want[i]) >= 0.9 * want.size


def scaled_down(monkeypatch, f, size=100):
    """Defaults of f that are sizes of large inputs, brought down to the size of a test."""
    monkeypatch.setattr(f, "__defaults__", tuple(size if isinstance(x, int) and x >= 50_000 else x for x in f.__defaults__))


def noise_and_reach(spark, n=300, k=5):
    """Noise of many dimensions, where lists of centres lose pairs, and its mutual reachability."""
    x = np.random.default_rng(8).normal(0, 1, (n, 24))
    d = all_distances(x)
    core = np.sort(d, 1)[:, k]
    return spark.createDataFrame([("M", i, v.tolist()) for i, v in enumerate(x)], "embedding_model string, id long, v array<double>"), np.maximum(np.maximum(core[:, None], core[None]), d)


def test_layers_are_whole_at_every_size(spark, monkeypatch):
    """Beyond a number of vectors of a model, only those that shared a list of centres met."""
    df, reach = noise_and_reach(spark)
    scaled_down(monkeypatch, C.merges)
    got = {}
    for r in C.clusterings(df, ["embedding_model"], block=32).collect():
        got.setdefault(r.layer, {})[r.id] = r.cluster
    w, want = np.round(heights(reach), 9), []
    for q in C.QUANTILES:
        near = (np.round(reach, 9) <= w[math.ceil(q * len(w)) - 1]) | np.eye(len(reach), dtype=bool)
        label = np.arange(len(reach))
        while ((new := np.where(near, label, len(label)).min(1)) < label).any():
            label = new
        size = np.bincount(label, minlength=len(label))[label]
        if (size >= 5).any():
            want.append({i: int(a) if n >= 5 else None for i, (a, n) in enumerate(zip(label, size, strict=True))})
    assert want and got == dict(enumerate(want))


def test_heights_are_whole_at_every_size(spark, monkeypatch):
    """As the layers: the tree's weights don't depend on a size either, and its edges join all vectors."""
    df, reach = noise_and_reach(spark)
    scaled_down(monkeypatch, C.merges)
    tree = C.merges(df, ["embedding_model"], block=32).collect()
    assert sorted(r.w for r in tree) == pytest.approx(heights(reach), abs=1e-8)
    assert len({x for r in tree for x in (r.u, r.v)}) == len(reach) == len(tree) + 1


def test_tiles_are_searched_in_either_order():
    g = np.random.default_rng(2).random((7, 5)).astype(np.float32)
    for t in (g, g.T, g[:1], g[:, :1].T):
        for limit in (np.linspace(0, 1, len(t), dtype=np.float32), np.full(t.shape, 0.5, np.float32)):
            want = np.argwhere(t < (limit if limit.ndim == 2 else limit[:, None]))
            assert sorted(zip(*blocks.below(t, limit), strict=True)) == sorted(map(tuple, want.tolist()))
