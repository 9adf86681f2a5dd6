"""Data-quality rules: (table, rule, key) rows of what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, table: str, rules: dict[str, Column], key: Column) -> DataFrame:
    """One row for each rule (a condition that must hold; null passes) that a row of df breaks."""
    broken = F.filter(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.lit(table).alias("table_name"), F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def valid(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break no rule."""
    for rule in rules.values():
        df = df.where(F.coalesce(rule, F.lit(True)))
    return df


def experiment_rules() -> dict[str, Column]:
    def full(c: str) -> Column:
        return F.size(c) > 0

    return {"max_length > 0": F.col("max_length") > 0, "num_runs > 0": F.col("num_runs") > 0, "networks non-empty": full("networks") & F.forall("networks", lambda n: F.size(n) > 0), "prompts non-empty": full("prompts"), "embedding_models non-empty": full("embedding_models")}


def run_rules() -> dict[str, Column]:
    return {"max_length > 0": F.col("max_length") > 0, "run_number >= 0": F.col("run_number") >= 0, "network non-empty": F.size("network") > 0, "initial_prompt non-empty": F.length("initial_prompt") > 0}


def step_rules() -> dict[str, Column]:
    return {"sequence_number >= 0": F.col("sequence_number") >= 0} | time_rules()


def output_rules() -> dict[str, Column]:
    text, image = F.col("output_text").isNotNull(), F.col("output_image").isNotNull()
    return {"output matches type": F.when(F.col("type") == "text", text & ~image).when(F.col("type") == "image", image & ~text).otherwise(False)}


def time_rules() -> dict[str, Column]:
    return {"completed_at >= started_at": F.col("completed_at") >= F.col("started_at")}


def required(*columns: str) -> dict[str, Column]:
    return {f"{c} not null": F.col(c).isNotNull() for c in columns}


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of child whose reference is set and isn't in parent."""
    p = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(p, column, "left_anti")
