"""The session settings that the queries assume."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """UTC times, adaptive execution (joins re-planned, partitions coalesced, skew split). On a cluster
    set spark.checkpoint.dir to a folder that all executors share. What intermediate results wrote there goes once
    nothing refers to it."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.sql.shuffle.partitions": str(partitions)}
    return SparkSession.builder.master(master).config(map=conf | more).getOrCreate()
