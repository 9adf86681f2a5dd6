"""Connected components by label propagation, all in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlab.llm.tables import checkpointed


def labelled(members: DataFrame) -> DataFrame:
    """members (g, node): nodes that share a g are connected. Returns (node, label), where the label is
    the least node of the component.

    A round gives every group the least label of its nodes and every node the least label of its groups,
    then the label of its label; rounds end when no label falls. Each round's labels are checkpointed. A
    large group is summed in part by each task before it meets.
    """
    members = checkpointed(members.select("g", "node").distinct())
    labels = members.groupBy("node").agg(F.min("node").alias("label"))
    while True:
        least = members.join(labels, "node").groupBy("g").agg(F.min("label").alias("label"))
        lower = members.join(least, "g").groupBy("node").agg(F.min("label").alias("label"))
        beyond = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = checkpointed(lower.join(beyond, "label").select("node", F.least("label", "beyond").alias("label")))
        before = labels.select("node", F.col("label").alias("before"))
        if new.join(before, "node").where("label < before").isEmpty():
            return new
        labels = new
