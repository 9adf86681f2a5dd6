"""Deletes as rewrites: the rows that stay, table by table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlab.operators.graph import checkpointed
from trajlab.sources.store import Store

Tables = dict[str, DataFrame]


def without(df: DataFrame, column: str, doomed: DataFrame) -> DataFrame:
    """Rows whose column isn't among the one column of doomed; a null reference stays."""
    return df.join(doomed.select(F.col(doomed.columns[0]).alias(column)).distinct(), column, "left_anti")


def cascade(tables: dict[str, DataFrame], steps: list[tuple[str, str, str, str]], root: str, doomed: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What stays and what goes of each table when the rows `doomed` (of table root) go.

    steps: (child, reference, parent, key) from the root down; a child's rows go when their reference is
    among the keys of the parent's rows that go.
    """
    gone = {root: doomed}
    out = {root: (tables[root].join(doomed, tables[root].columns, "left_anti"), doomed)}
    for child, reference, parent, key in steps:
        keys = gone[parent].select(F.col(key).alias(reference)).distinct()
        gone[child] = tables[child].join(keys, reference, "left_semi")
        out[child] = (tables[child].join(keys, reference, "left_anti"), gone[child])
    return out


def nulled(df: DataFrame, column: str, doomed: DataFrame) -> DataFrame:
    """df with the column null where it refers to one of doomed."""
    d = doomed.select(F.col(doomed.columns[0]).alias(column), F.lit(True).alias("_doomed")).distinct()
    kept = df.join(d, column, "left")
    return kept.withColumn(column, F.when(F.col("_doomed").isNull(), F.col(column))).select(*df.columns)


def clusterings_replaced(store: Store, models: list[str], new: Tables) -> int:
    """All clustering of these models goes and `new` (clustering_results, and embedding_clusters tagged by `_model`)
    comes, layers and assignments in one commit; a model without new rows is left without any."""
    return store.replace(clustering_results=(new["clustering_results"], "embedding_model", models), embedding_clusters=(new["embedding_clusters"], "_model", models))


def exponents_replaced(store: Store, experiments: list[str], new: DataFrame) -> int:
    """The exponents of these experiments go and `new` comes, in one commit."""
    return store.replace(lyapunov_results=(new, "experiment_id", experiments))


def flagged(df: DataFrame, *doomed: tuple[str, DataFrame]) -> DataFrame:
    """df with `_goes`: whether a reference is among the ids that go, for (reference, ids); df is read once, and a
    null reference never is."""
    out, marks = df, []
    for i, (reference, ids) in enumerate(doomed):
        marks.append(f"_m{i}")
        out = out.join(ids.select(F.col("id").alias(f"_r{i}"), F.lit(True).alias(marks[-1])).distinct(), F.col(reference) == F.col(f"_r{i}"), "left")
    goes = F.coalesce(*marks, F.lit(False))
    return out.select(*df.columns, goes.alias("_goes"))


def stays(rows: DataFrame) -> DataFrame:
    return rows.where("not _goes").drop("_goes")


def goes(rows: DataFrame) -> DataFrame:
    return rows.where("_goes").drop("_goes")


def _ids(rows: DataFrame) -> DataFrame:
    """The ids that go of a flagged table, computed once for all tables below it."""
    return checkpointed(goes(rows).select("id"))


def _down(tables: Tables, runs: DataFrame, medoids: bool) -> Tables:
    """The tables below flagged runs, flagged."""
    doomed = _ids(runs)
    steps = flagged(tables["invocations"], ("run_id", doomed))
    vectors = flagged(tables["embeddings"], ("invocation_id", _ids(steps)))
    lost = _ids(vectors)
    assigned = flagged(tables["embedding_clusters"], ("embedding_id", lost), *([("medoid_embedding_id", lost)] if medoids else []))
    return {"embedding_clusters": assigned, "embeddings": vectors, "persistence_diagrams": flagged(tables["persistence_diagrams"], ("run_id", doomed)), "invocations": steps, "runs": runs}


def experiments_deleted(tables: Tables, doomed: DataFrame) -> Tables:
    """The tables flagged by what goes with the experiments whose ids doomed has, from assignments up to the
    experiments; their exponents go too. Clusterings belong to no experiment and stay."""
    ids = checkpointed(doomed.select("id").distinct())
    return _down(tables, flagged(tables["runs"], ("experiment_id", ids)), False) | {"lyapunov_results": flagged(tables["lyapunov_results"], ("experiment_id", ids)), "experiments": flagged(tables["experiments"], ("id", ids))}


def runs_of_model_deleted(tables: Tables, model: str) -> Tables:
    """The tables flagged by what goes with the runs that have a model in their network: their steps, vectors and
    diagrams, the exponents of such networks, and assignments of their vectors or to a medoid among them."""
    has = F.coalesce(F.array_contains("network", model), F.lit(False)).alias("_goes")
    return _down(tables, tables["runs"].select("*", has), True) | {"lyapunov_results": tables["lyapunov_results"].select("*", has)}


def counted(rows: Tables) -> DataFrame:
    """(table_name, n_left, n_gone) of flagged tables."""
    out = None
    for name, df in rows.items():
        marks = df.select(F.lit(name).alias("table_name"), F.col("_goes").cast("long").alias("gone"))
        out = marks if out is None else out.unionByName(marks)
    return out.groupBy("table_name").agg(F.sum(1 - F.col("gone")).alias("n_left"), F.sum("gone").alias("n_gone"))


def deleted(store: Store, rows: Tables, tags: dict[str, str]) -> int:
    """Write what stays of flagged tables over what a store has, all in one commit. tags: each table's tag column."""
    changes = {}
    for name, df in rows.items():
        left = stays(df)
        values = sorted({t for t, _ in store.state()[name] if t})
        changes[name] = (left, tags[name], values)
    return store.replace(**changes)
