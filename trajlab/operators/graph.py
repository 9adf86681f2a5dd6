"""Connected components of all graphs of a frame at once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a local session without one gets its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="trajlab-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared one, which goes at the end."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: edges of a graph up to which one task has all of it; beyond, rounds over all graphs
WHOLE = 200_000


def parted(df: DataFrame, g: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups with up to `most` rows, and those of the others. Groups are counted in part by each task."""
    large = df.groupBy(*g).count().where(F.col("count") > most).select(*g)
    return df.join(large, g, "left_anti"), df.join(large, g, "left_semi")


def joined_ends(u: list, v: list) -> list[int]:
    """Which edges join two parts when taken in order."""
    root: dict = {}

    def top(x):
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    out = []
    for i, (a, b) in enumerate(zip(u, v, strict=True)):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(i)
    return out


def _labelled(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    u, v = (table.column(c).to_pylist() for c in ("u", "v"))
    root = {x: x for x in [*u, *v]}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(u, v, strict=True):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    kind = table.schema.field("u").type
    nodes = list(root)
    return pa.table([*(pa.array([k.as_py()] * len(nodes), k.type) for k in keys), pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], [*(c for c in table.schema.names if c not in ("u", "v")), "u", "label"])


def components(edges: DataFrame, nodes: DataFrame, g: str | list[str] = "g", most: int = WHOLE) -> DataFrame:
    """edges (g, u, v), nodes (g, u): (g, u, label), the least node that edges reach. A graph of up to `most` edges
    is labelled in one task. In larger ones labels fall to the least of the neighbours and of the label's own
    label until none does, all graphs at once."""
    g = [g] if isinstance(g, str) else g
    edges = checkpointed(edges.select(*g, "u", "v").distinct())
    few, many = parted(edges, g, most)
    node = edges.schema["u"].dataType
    out = T.StructType([*(edges.schema[c] for c in g), T.StructField("u", node), T.StructField("label", node)])
    found = few.groupBy(*g).applyInArrow(_labelled, out)
    if not many.isEmpty():
        found = found.unionByName(_spread(many, g))
    alone = nodes.select(*g, "u").distinct().join(found, [*g, "u"], "left")
    return alone.select(*g, "u", F.coalesce("label", "u").alias("label"))


def _spread(edges: DataFrame, g: list[str]) -> DataFrame:
    both = checkpointed(edges.select(*g, "u", "v").unionByName(edges.select(*g, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.select(*g, "u").distinct().withColumn("label", F.col("u"))
    while True:
        near = both.join(labels.select(*g, F.col("u").alias("v"), "label"), [*g, "v"]).groupBy(*g, "u").agg(F.min("label").alias("near"))
        lower = labels.join(near, [*g, "u"]).select(*g, "u", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        beyond = lower.select(*g, F.col("u").alias("label"), F.col("label").alias("beyond"))
        new = checkpointed(lower.join(beyond, [*g, "label"]).select(*g, "u", "before", F.least("label", "beyond").alias("label")))
        if new.where("label < before").isEmpty():
            return new.select(*g, "u", "label")
        labels = new.drop("before")
