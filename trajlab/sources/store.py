"""Tables in a folder whose changes are published by one commit.

Rows are written to new folders, and a numbered commit file then says which folders
each table is made of. A reader sees the tables of one commit; what is written but not
published is seen by nobody, and a commit may change several tables. Folders carry the
value of a tag (a model, an experiment), so replacing one value's rows writes and
drops those alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.operators.graph import checkpointed

#: a table's entries: (tag value as text, folder)
Entries = list[tuple[str, str]]


class Conflict(Exception):
    """Another commit was published since this one began."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ commits

    def _listed(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max((int(n.split(".")[0]) for n in self._listed("_commits") if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict[str, Entries]:
        """The folders of each table at a commit, the last one by default."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_commits/{version:012d}.json"))
        try:
            return {t: [tuple(e) for e in x] for t, x in json.loads(bytes(stream.readAllBytes())).items()}
        finally:
            stream.close()

    def publish(self, state: dict[str, Entries], after: int) -> int:
        """Make `state` the commit behind `after`, by one rename; a commit that is there already is a Conflict."""
        part = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}.part")
        final = self._path(f"{self.root}/_commits/{after + 1:012d}.json")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise Conflict(f"commit {after + 1} is there already")
        return after + 1

    # ------------------------------------------------------------ rows

    def read(self, table: str, *tags: str, version: int | None = None) -> DataFrame:
        """A table's rows, or those of some tag values, whose folders alone are read. A table without a folder is
        a KeyError."""
        entries = self.state(version)[table]
        folders = [f for tag, f in entries if not tags or tag in tags]
        if folders:
            return self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders))
        return self.spark.read.parquet(f"{self.root}/{entries[0][1]}").limit(0)

    def _written(self, table: str, df: DataFrame, tag: str, values: list[str], drop_tag: bool) -> Entries:
        """Rows of df with these tag values, in a folder for each, under names of their own."""
        folder = f"{table}/{uuid.uuid4().hex}"
        where = F.array_position(F.lit(values), F.col(tag).cast("string")) if values else F.lit(0)
        rows = df.withColumn("_tag", where.cast("int")).where("_tag > 0")
        rows = rows.drop(tag) if drop_tag else rows
        rows.write.option("compression", "zstd").partitionBy("_tag").parquet(f"{self.root}/{folder}")
        there = set(self._listed(folder))
        found = [(v, f"{folder}/_tag={i}") for i, v in enumerate(values, 1) if f"_tag={i}" in there]
        if not found:
            # a table keeps its columns when it has no row
            rows.drop("_tag").limit(0).write.parquet(f"{self.root}/{folder}/none")
            found = [("", f"{folder}/none")]
        return found

    def replace(self, **changes: tuple[DataFrame, str, list[str]]) -> int:
        """For each table (rows, tag, values): the rows with these values of column `tag` go, those of the frame
        that have them come, the others stay. All tables change in one commit or none does. A tag named with
        underscore in front isn't kept as a column. A value of which the frame has no row is left without any."""
        after = self.version()
        state = self.state(after)
        for table, (df, tag, values) in changes.items():
            values = [str(v) for v in values]
            new = self._written(table, df, tag, values, tag.startswith("_"))
            kept = [e for e in state.get(table, []) if e[0] not in values and e[0]]
            state[table] = [e for e in new if e[0]] + kept or new
        return self.publish(state, after)

    def append(self, table: str, df: DataFrame, tag: str, key: list[str]) -> int:
        """Add the rows of df whose key no row of the table has, one for each key (that with the least id). A batch
        that is appended again adds nothing. Rows with a null in the key are left out. Returns the rows added."""
        after = self.version()
        state = self.state(after)
        others = [c for c in df.columns if c not in key]
        order = F.col("id") if "id" in df.columns else F.to_json(F.struct(*df.columns))
        one = df.dropna(subset=key).groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_r") if others else F.lit(0).alias("_r"))
        batch = one.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])
        values = sorted(str(r[0]) for r in df.select(tag).distinct().collect() if r[0] is not None)
        if table in state:
            batch = batch.join(self.read(table, *values, version=after).select(*key), key, "left_anti")
        batch = checkpointed(batch)
        n = batch.count()
        if n or table not in state:
            new = self._written(table, batch, tag, values, False)
            state[table] = [e for e in state.get(table, []) if e[0]] + [e for e in new if e[0]] or new
            self.publish(state, after)
        return n

    def vacuum(self, keep: int = 1) -> None:
        """Drop commits before the last `keep`, and folders that no commit left has: those of replaced rows, and of
        changes that never were published. Not while another change is under way."""
        last = self.version()
        used = {f.rpartition("/")[0] for v in range(max(1, last - keep + 1), last + 1) for e in self.state(v).values() for _, f in e}
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path(f"{self.root}/_commits/{v:012d}.json"), False)
        for table in self._listed(""):
            if not table.startswith("_"):
                for folder in self._listed(table):
                    if f"{table}/{folder}" not in used:
                        self._fs.delete(self._path(f"{self.root}/{table}/{folder}"), True)
        for name in self._listed("_commits"):
            if name.endswith(".part"):
                self._fs.delete(self._path(f"{self.root}/_commits/{name}"), False)
