"""Small things every operator of this subpackage shares: input columns, row keys, the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.files import removed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Where the setting is absent a local session (tests) gets a temporary folder;
    a cluster without the setting is an error, as a machine-local folder would
    lose files there.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trajlab-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def keyed(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, a hash of the text and the text. Rows are told apart by the first two, which
    join null-safely, so a null or repeated doc_id neither drops nor multiplies rows; rows
    equal in both are copies with equal results."""
    return documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text", *more)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


class Scratch:
    """Tables that an operator keeps in the shared folder while it runs, to cut lineage. As a context it
    removes what is left of them, also when a step fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(df for df, _ in self.tables))

    def stored(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        folder = fresh_dir(self.spark, name)
        try:
            df.write.option("compression", codec).parquet(folder)
        except BaseException:
            removed(self.spark, folder)
            raise
        found = self.spark.read.parquet(folder)
        self.tables.append((found, folder))
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for folder in [folder for df, folder in self.tables if any(df is x for x in tables)]:
            removed(self.spark, folder)
        self.tables = [(df, folder) for df, folder in self.tables if not any(df is x for x in tables)]

    def result(self, df: DataFrame) -> DataFrame:
        """The rows of df, computed now; the tables go."""
        kept = checkpointed(df)
        self.drop(*(x for x, _ in self.tables))
        return kept


def freed(spark: SparkSession) -> None:
    """Let Spark's cleaner take the shuffle files of finished steps now, before a step that shuffles
    texts again; by itself it does so whenever the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def parts_for(spark: SparkSession, n_bytes: int, each: int = 32 << 20) -> int:
    """A number of shuffle partitions of about `each` bytes, never under the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))
