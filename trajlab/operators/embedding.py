"""Vectors of steps that have none, by the model that each experiment asks for."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlab.functions.vectors import DIMENSIONS, finalised

#: contents (texts, or bytes of images) of a batch to their vectors, a row each
Embed = Callable[[list], np.ndarray]


@dataclass(frozen=True)
class Model:
    """A model that embeds contents of a kind, `text` or `image`. load is called once in a Python worker, whatever the
    number of tasks and batches, and gives the function for its batches of at most `batch` contents. Vectors of a
    raw model are stored as they come; others are finalised (see vectors.finalised)."""

    kind: str
    load: Callable[[], Embed]
    batch: int = 32
    raw: bool = False
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


def characters(size: int = DIMENSIONS, most: int = 100) -> Embed:
    """Code point, or byte, divided by 255 of the first `most` of a content, then zeros; not clipped at 1."""
    def embed(contents: list) -> np.ndarray:
        out = np.zeros((len(contents), size))
        for row, content in zip(out, contents, strict=True):
            points = [x if isinstance(x, int) else ord(x) for x in content[:most]]
            row[: len(points)] = np.array(points) / 255
        return out

    return embed


_LOADED: dict[str, Embed] = {}


def _loaded(model: Model) -> Embed:
    """The model's function, kept by the worker from task to task."""
    if model.token not in _LOADED:
        _LOADED[model.token] = model.load()
    return _LOADED[model.token]


def _embedded(batches: Iterator[pa.RecordBatch], models: dict[str, Model]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("embedding_model").to_pylist()
        vectors: list = [None] * len(names)
        for name in dict.fromkeys(names):
            at = [i for i, n in enumerate(names) if n == name]
            content = batch.column({"text": "output_text", "image": "output_image"}[models[name].kind]).take(pa.array(at)).to_pylist()
            for a in range(0, len(at), models[name].batch):
                part = content[a : a + models[name].batch]
                made = np.asarray(_loaded(models[name])(part), np.float32)
                if len(made) != len(part):
                    raise ValueError(f"{name}: {len(made)} vectors for {len(part)} contents")
                for i, v in zip(at[a:], made, strict=False):
                    vectors[i] = v
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding_model"), pa.array(vectors, pa.list_(pa.float32()))], ["invocation_id", "embedding_model", "vector"])


def embedded(wanted: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(invocation_id, embedding_model, vector) of rows (id, embedding_model, output_text, output_image) whose model
    is registered. A task takes its rows by model, in batches of the model's size. Rows are dealt to all tasks first:
    contents are short, and a join that ends in few partitions would leave the models to a few tasks."""
    rows = wanted.where(F.col("embedding_model").isin(*models)).select("id", "embedding_model", "output_text", "output_image")
    spark = wanted.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "id", "embedding_model")
    # one model's contents behind another's, so a batch of rows has few models
    made = rows.sortWithinPartitions("embedding_model").mapInArrow(lambda it: _embedded(it, models), "invocation_id string, embedding_model string, vector array<float>")
    raw = [n for n, m in models.items() if m.raw]
    done = finalised(F.col("vector")).cast("array<float>")
    return made.withColumn("vector", F.when(F.col("embedding_model").isin(*raw), F.col("vector")).otherwise(done))


def missing(tables: dict[str, DataFrame], kinds: dict[str, str]) -> DataFrame:
    """Steps with `embedding_model` for each model of their experiment that hasn't embedded them though it could: the
    step is of the model's kind and has that output. One join for all models. kinds: text or image for each."""
    used = tables["experiments"].select(F.col("id").alias("experiment_id"), F.explode("embedding_models").alias("embedding_model")).distinct()
    kind = F.create_map(*[F.lit(x) for item in kinds.items() for x in item])
    used = used.where(F.col("embedding_model").isin(*kinds)).withColumn("type", kind[F.col("embedding_model")])
    owners = tables["runs"].select(F.col("id").alias("run_id"), "experiment_id").join(used, "experiment_id")
    has = F.when(F.col("type") == "text", F.col("output_text").isNotNull()).otherwise(F.col("output_image").isNotNull())
    able = tables["invocations"].where(has).join(owners, ["run_id", "type"])
    there = tables["embeddings"].select(F.col("invocation_id").alias("id"), "embedding_model")
    return able.join(there, ["id", "embedding_model"], "left_anti")


def filled(tables: dict[str, DataFrame], models: dict[str, Model], at: Column) -> DataFrame:
    """Rows for the embeddings table: a vector for each step and model that `missing` finds, stamped with `at`. Appended
    by key (see Store.append) a second time they add nothing, and once there they are missing no more."""
    made = embedded(missing(tables, {n: m.kind for n, m in models.items()}), models)
    stamps = [at.alias(c) for c in ("started_at", "completed_at", "inserted_at", "updated_at")]
    return made.select(F.concat_ws("-", "invocation_id", "embedding_model").alias("id"), "invocation_id", "embedding_model", "vector", *stamps)
