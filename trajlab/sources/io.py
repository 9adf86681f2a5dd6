"""Readers and writers of the data model's files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["experiments", "runs", "invocations", "embeddings", "persistence_diagrams", "lyapunov_results", "clustering_results", "embedding_clusters"]
CONFIG = "networks array<array<string>>, prompts array<string>, embedding_models array<string>, max_length bigint, num_runs bigint"
REQUIRED = ["networks", "prompts", "embedding_models", "max_length"]
FTLE = "experiment_id string, network string, embedding_model string, category string, prompt_or_pair string, ftle double, r_squared double, num_pairs bigint, num_timesteps bigint"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Experiment settings from JSON objects, a file each; num_runs is 1 where absent, other keys don't
    count, and a file without one of REQUIRED is an error."""
    df = spark.read.schema(CONFIG).json(path, multiLine=True)
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    lacking = df.select(missing.alias("m")).where("m <> ''").first()
    if lacking:
        raise ValueError(f"{path}: no {lacking.m}")
    return df.withColumn("num_runs", F.coalesce("num_runs", F.lit(1).cast("long")))


def read_dump(spark: SparkSession, folder: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables or TABLES}


def write_dump(frames: dict[str, DataFrame], folder: str, order: dict[str, list[str]] | None = None) -> list[tuple[str, str, int]]:
    """A zstd parquet folder for each table; (table, path, rows), the rows counted as they are written. order: columns
    that a table's rows ascend by through its files in order of their names, ranges sorted side by side."""
    out = []
    for name, df in frames.items():
        seen, path, by = Observation(), f"{folder}/{name}.parquet", (order or {}).get(name)
        df = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
        out.append((name, path, seen.get["n"]))
    return out


def read_ftle_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=FTLE, quote='"', escape='"')


def write_ftle_csv(table: DataFrame, path: str) -> None:
    """Fixed header; a null is empty; a value with a comma, quote or line feed is quoted, quotes doubled."""
    columns = [f.split()[0] for f in FTLE.split(", ")]
    table.select(*columns).write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def _floats(blobs: pa.Array) -> pa.Array:
    """Blobs as lists over one buffer; a null stays one."""
    sizes = pc.fill_null(pc.binary_length(blobs), 0).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(sizes % 4)
    if len(odd):
        raise ValueError(f"a vector of {sizes[odd[0]]} bytes isn't one of float32 numbers")
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes // 4)]).astype(np.int32), pa.int32(), mask=np.concatenate([pc.is_null(blobs).to_numpy(zero_copy_only=False), [False]]))
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(b for b in blobs.to_pylist() if b), "<f4")))


def _blobs(vectors: pa.Array) -> pa.Array:
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4"), pc.list_value_length(vectors).to_pylist()
    out, at = [], 0
    for n in sizes:
        out.append(None if n is None else flat[at : at + n].tobytes())
        at += n or 0
    return pa.array(out, pa.binary())


def vectors_of_blobs(df: DataFrame, column: str) -> DataFrame:
    """A column of little-endian float32 blobs as arrays; a null stays one."""
    return df.withColumn(column, F.arrow_udf(_floats, T.ArrayType(T.FloatType()))(column))


def blobs_of_vectors(df: DataFrame, column: str) -> DataFrame:
    """A column of float arrays as little-endian float32 blobs; a null stays one."""
    return df.withColumn(column, F.arrow_udf(_blobs, T.BinaryType())(column))
