"""Merkle manifest of a dataset, with hash states kept before each child slot.

Rows become leaves, the leaves of a tree key a tree in order, and the trees' roots one
tree above them. A parent is the SHA-256 of its children's digests as text. Beside its
digest a parent retains a copy of the hash state before each child slot; to fold a
changed leaf upwards, the state of its slot is resumed with the replacement and the
siblings right of it, so what stands left of it isn't hashed again.

Trees are cut into blocks of fanout ** k leaves. A block is built, kept and folded in
one task and hands one digest to the next stage, where blocks are leaves; a tree of n
leaves takes log(n) / log(block) stages, whatever its share of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlab.llm import midstate as M
from trajlab.llm.tables import Scratch, quoted, table
from trajlab.llm.text import released, string_view

FANOUT = 2
#: leaves of a block at most
BLOCK = 4096
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(columns: list[Column]) -> Column:
    """Lowercase hexadecimal SHA-256 of the values in a row: `-` for a null, else the UTF-8 length, a colon
    and the value (integers in decimal)."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height(fanout: int, block: int) -> int:
    """Levels of a full block."""
    k = 1
    while fanout ** (k + 1) <= block:
        k += 1
    return k


class Tree:
    """The levels of one block, with the retained states. levels[0] is what it was built on; states[l][s] has
    the state before slot s of each parent on level l + 1."""

    def __init__(self, leaves: np.ndarray, fanout: int, rise: int | None):
        """rise: levels above the leaves, also where a lone node goes up alone; None: until one node is left."""
        self.fanout, self.levels, self.states = fanout, [leaves], []
        while len(self.levels) <= rise if rise is not None else self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            n = below.shape[1]
            parents = -(-n // fanout)
            state, kept = M.fresh(parents), []
            for s in range(fanout):
                kept.append(state)
                mine = below[:, s::fanout]
                state = np.concatenate([M.taken(state[:, : mine.shape[1]], mine), state[:, mine.shape[1] :]], 1)
            last = n - (parents - 1) * fanout
            self.states.append(kept)
            self.levels.append(np.concatenate([M.finished(state[:, :-1], fanout), M.finished(state[:, -1:], last)], 1))

    @property
    def root(self) -> np.ndarray:
        return self.levels[-1]

    def packed(self) -> tuple[bytes, bytes]:
        """The nodes of all levels in a row, and the states of all levels and slots."""
        return b"".join(map(M.packed, self.levels)), b"".join(M.packed(x) for kept in self.states for x in kept)

    @classmethod
    def read(cls, nodes: bytes, states: bytes, n: int, fanout: int) -> Tree:
        """A block from what packed() gave; n: the number of leaves."""
        tree = cls.__new__(cls)
        tree.fanout, tree.levels, tree.states = fanout, [], []
        flat, kept = M.unpacked(nodes), M.unpacked(states)
        at = done = 0
        while at < flat.shape[1]:
            if tree.levels:
                parents = -(-n // fanout)
                tree.states.append([kept[:, done + s * parents : done + (s + 1) * parents] for s in range(fanout)])
                done += fanout * parents
                n = parents
            tree.levels.append(flat[:, at : at + n])
            at += n
        return tree

    def paths(self) -> list[bytes]:
        """For each leaf, level by level: its slot and the number of children there (two bytes each), the state
        before the slot, and the digests of the siblings from left to right."""
        f, n = self.fanout, self.levels[0].shape[1]
        found: list[list[bytes]] = [[] for _ in range(n)]
        node = list(range(n))
        for below, kept in zip(self.levels, self.states, strict=False):
            digests, states, width = M.packed(below), [M.packed(x) for x in kept], below.shape[1]
            for i in range(n):
                parent, slot = divmod(node[i], f)
                first, count = parent * f, min(f, width - parent * f)
                others = [digests[32 * j : 32 * j + 32] for j in range(first, first + count) if j != node[i]]
                found[i].append(slot.to_bytes(2) + count.to_bytes(2) + states[slot][32 * parent : 32 * parent + 32] + b"".join(others))
                node[i] = parent
        return [b"".join(x) for x in found]

    def folded(self, leaves: np.ndarray) -> np.ndarray:
        """The root that each leaf, in its own place, gives with the siblings of this tree."""
        f, now, node = self.fanout, leaves, np.arange(leaves.shape[1])
        for below, kept in zip(self.levels, self.states, strict=False):
            parent, slot = node // f, node % f
            count = np.minimum(f, below.shape[1] - parent * f)
            state = M.taken(np.stack(kept)[slot, :, parent].T, now)
            for s in range(1, f):
                at = np.flatnonzero((slot < s) & (s < count))
                state[:, at] = M.taken(state[:, at], below[:, parent[at] * f + s])
            now = np.empty_like(state)
            for c in np.unique(count):
                at = np.flatnonzero(count == c)
                now[:, at] = M.finished(state[:, at], int(c))
            node = parent
        return now

    def siblings(self) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, places, 64) bytes: each leaf's siblings' digests as text, level by level and left to right, and
        which places hold one."""
        f, n = self.fanout, self.levels[0].shape[1]
        found, there, node = [], [], np.arange(n)
        for below in self.levels[:-1]:
            parent, slot = node // f, node % f
            shown = M.texts(below)
            for j in range(f - 1):
                other = parent * f + j + (j >= slot)
                there.append(other < below.shape[1])
                found.append(shown[np.minimum(other, below.shape[1] - 1)])
            node = parent
        return (np.stack(found, 1), np.stack(there, 1)) if found else (np.empty((n, 0, 64), np.uint8), np.empty((n, 0), bool))


def steps(path: bytes) -> Iterator[tuple[int, int, bytes, list[bytes]]]:
    """(slot, children, state, siblings) of a path, from the leaf up."""
    at = 0
    while at < len(path):
        slot, count = int.from_bytes(path[at : at + 2]), int.from_bytes(path[at + 2 : at + 4])
        yield slot, count, path[at + 4 : at + 36], [path[at + 36 + 32 * j : at + 68 + 32 * j] for j in range(count - 1)]
        at += 36 + 32 * (count - 1)


def raised(digests: np.ndarray, path: bytes) -> np.ndarray:
    """The digests folded on along a path that they share."""
    n = digests.shape[1]
    for slot, count, state, others in steps(path):
        now = M.taken(np.repeat(M.unpacked(state), n, 1), digests)
        for right in others[slot:]:
            now = M.taken(now, np.repeat(M.unpacked(right), n, 1))
        digests = M.finished(now, count)
    return digests


# ---------------------------------------------------------------- in tasks


def _digests(column: pa.Array) -> np.ndarray:
    data, _ = string_view(column)
    return data.reshape(-1, 32).copy().view(">u4").T.astype(np.uint32)


def _with(batch: pa.RecordBatch, **more: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.binary()) for v in more.values())], [*batch.schema.names, *more])


def _members(batch: pa.RecordBatch) -> Iterator[pa.StructArray]:
    """The members of each row's block."""
    column = batch.column("members")
    flat, at = column.flatten(), 0
    for n in column.value_lengths().to_pylist():
        yield flat.slice(at, n)
        at += n


@released
def _built(batches: Iterator[pa.RecordBatch], fanout: int, rise: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, states, roots = [], [], []
        for members, total in zip(_members(batch), batch.column("total").to_pylist(), strict=True):
            tree = Tree(_digests(members.field("digest")), fanout, rise if total > fanout**rise else None)
            a, b = tree.packed()
            nodes.append(a)
            states.append(b)
            roots.append(M.packed(tree.root))
        yield _with(batch, nodes=nodes, states=states, root=roots)


def _trees(batch: pa.RecordBatch, fanout: int) -> Iterator[Tree]:
    for nodes, states, n in zip(batch.column("nodes").to_pylist(), batch.column("states").to_pylist(), batch.column("members").value_lengths().to_pylist(), strict=True):
        yield Tree.read(nodes, states, n, fanout)


@released
def _descended(batches: Iterator[pa.RecordBatch], fanout: int, name: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each member of a block: its path to the top, what the block's row says, the member's field `name`."""
    for batch in batches:
        for row, (tree, members) in enumerate(zip(_trees(batch, fanout), _members(batch), strict=True)):
            tail, n = batch.column("tail")[row].as_py(), len(members)
            told = {c: pa.array([batch.column(c)[row].as_py()] * n, batch.column(c).type) for c in ("tree", "subroot", "top") if c in batch.schema.names}
            told |= {"tail": pa.array([x + tail for x in tree.paths()], pa.binary()), name: members.field(name)}
            yield pa.RecordBatch.from_arrays([told[c] for c in names], names)


def _shown(digests: np.ndarray) -> pa.Array:
    n = digests.shape[1]
    return pa.StringArray.from_buffers(n, pa.py_buffer((64 * np.arange(n + 1)).astype(np.int32)), pa.py_buffer(M.texts(digests).tobytes()))


_FOLDED = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@released
def _verified(batches: Iterator[pa.RecordBatch], fanout: int, carried: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, (tree, members) in enumerate(zip(_trees(batch, fanout), _members(batch), strict=True)):
            tail, subroot, top = (batch.column(c)[row].as_py() for c in ("tail", "subroot", "top"))
            leaves, n = tree.levels[0], len(members)
            start, changed = leaves.copy(), members.field("changed")
            at = np.flatnonzero(changed.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                start[:, at] = _digests(changed.drop_null())
            found = raised(tree.folded(start), tail)
            near, there = tree.siblings()
            above = b"".join(x.hex().encode() for *_, others in steps(tail) for x in others)
            proofs = [hashlib.sha256((near[i] if there[i].all() else near[i][there[i]]).tobytes() + above).hexdigest() for i in range(n)]
            same = (found == M.unpacked(top)).all(0)
            yield pa.RecordBatch.from_arrays(
                [*(members.field(c) for c in carried), _shown(leaves), pa.array([subroot.hex()] * n), pa.array([top.hex()] * n), pa.array(proofs, pa.string()), _shown(found), pa.array(same)],
                [*carried, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


# ---------------------------------------------------------------- the manifest


def _placed(scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with i, the place in their tree by `order`, and total, the number of rows of the tree. Ranges of
    (tree, order) are sorted side by side; a range's rows of a tree follow those of the ranges before it."""
    sorted_ = scratch.stored(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    w = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sorted_.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("total"))
    return sorted_.join(runs, ["tree", "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


class Manifest:
    """The blocks of all trees, stage by stage, and of the tree above them.

    stages and top: tables (tree, block, total, members, nodes, states, root), from the leaves up; the tree key
    is empty for a null and the value behind `=` otherwise, which sorts bytewise with the null first. members
    are the block's nodes in order with their digests; at the leaves also what `carried` names and `changed`."""

    def __init__(self, scratch: Scratch, leaves: DataFrame, order: list[str], carried: list[str], fanout: int = FANOUT, block: int = BLOCK):
        """leaves (tree, digest, changed, *carried): digests of 32 bytes; changed: what replaces a leaf, or null.
        Leaves of a tree ascend by `order`, nulls first, then by digest."""
        if not 2 <= fanout < 1 << 16:
            raise ValueError("fanout is 2 to 65,535")
        self.scratch, self.fanout, self.rise, self.carried = scratch, fanout, height(fanout, block), carried
        # copies hold their place by a number, so that a range can end among them
        numbered = scratch.stored(leaves.withColumn("_copy", F.monotonically_increasing_id()), "leaves")
        self.stages = self._grown(_placed(scratch, numbered, [*order, "digest", "_copy"], "sorted"), [*carried, "changed"])
        roots = self.stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
        self.top = self._grown(_placed(scratch, roots, ["name"], "roots"), ["name"])

    def _grown(self, nodes: DataFrame, fields: list[str]) -> list[DataFrame]:
        size, stages = self.fanout**self.rise, []
        fanout, rise = self.fanout, self.rise
        while True:
            packed = F.array_sort(F.collect_list(F.struct("i", "digest", *fields))).alias("members")
            blocks = nodes.groupBy("tree", F.floor(F.col("i") / size).alias("block")).agg(F.max("total").alias("total"), packed)
            schema = T.StructType([*blocks.schema.fields, *(T.StructField(c, T.BinaryType()) for c in ("nodes", "states", "root"))])
            stages.append(self.scratch.stored(blocks.mapInArrow(lambda it: _built(it, fanout, rise), schema), "blocks"))
            if (stages[-1].agg(F.max("total")).first()[0] or 0) <= size:
                return stages
            nodes = stages[-1].select("tree", F.col("block").alias("i"), F.ceil(F.col("total") / size).alias("total"), F.col("root").alias("digest"))
            fields = []

    def verified(self) -> DataFrame:
        """A row for each leaf: carried, leaf, subroot, root, proof_sha256 (of the siblings up to the root, as
        text), folded_root (of the changed leaf, else the leaf, with the kept siblings), verified."""
        fanout = self.fanout

        def down(stage: DataFrame, tails: DataFrame, name: str) -> DataFrame:
            here = stage.join(tails, ["tree", "block"])
            kinds = {"tree": "string", **{c: "binary" for c in ("tail", "subroot", "top") if c in here.columns}, name: "string" if name == "name" else "long"}
            return here.mapInArrow(lambda it: _descended(it, fanout, name, [*kinds]), ", ".join(f"{k} {v}" for k, v in kinds.items()))

        tails = self.top[-1].select("tree", "block", F.lit(b"").alias("tail"), F.col("root").alias("top"))
        for stage in reversed(self.top[1:]):
            tails = down(stage, tails, "i").withColumnRenamed("i", "block")
        tails = down(self.top[0], tails, "name").select(F.col("name").alias("tree"), "tail", "top")
        tails = self.stages[-1].select("tree", "block", F.col("root").alias("subroot")).join(tails, "tree")
        for stage in reversed(self.stages[1:]):
            tails = down(stage, tails, "i").withColumnRenamed("i", "block")
        carried = self.carried
        member = self.stages[0].schema["members"].dataType.elementType
        types = ", ".join(f"{quoted(c)} {member[c].dataType.simpleString()}" for c in carried)
        return self.stages[0].join(tails, ["tree", "block"]).mapInArrow(lambda it: _verified(it, fanout, carried), f"{types}, {_FOLDED}")


def leaves(documents: DataFrame, columns: list[str], tree: str, carried: list[str], changes: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, digest, changed, *carried): the leaf of each row over `columns`, and where `where` holds what it is
    with `changes` made to them."""
    was = [F.col(quoted(c)) for c in columns]
    now = [(changes or {}).get(c, F.col(quoted(c))) for c in columns]
    changed = F.unhex(F.when(where, encoded(now))) if where is not None else F.lit(None).cast("binary")
    key = F.when(F.col(quoted(tree)).isNull(), "").otherwise(F.concat(F.lit("="), F.col(quoted(tree)).cast("string")))
    return documents.select(key.alias("tree"), F.unhex(encoded(was)).alias("digest"), changed.alias("changed"), *[F.col(quoted(c)) for c in carried])


def verified(documents: DataFrame, columns: list[str] = COLUMNS, tree: str = "lang", key: str = "doc_id", changes: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """The manifest of documents, and each row's leaf folded up through it; see Manifest.verified.

    columns make a leaf, tree parts the rows into trees, key orders them. A null in any column is a value of
    its own; null and repeated keys keep a leaf each (nulls first, equal keys by their leaf, equal rows side by
    side); an empty text is a value of no bytes. Other columns play no part. One row is its own subroot and,
    alone in the table, the root; an empty table gives no row. changes: what rows become where `where` holds;
    their folded root then differs and they aren't verified.
    """
    with Scratch(documents.sparkSession) as scratch:
        rows = leaves(documents, columns, tree, [key], changes, where)
        return scratch.result(Manifest(scratch, rows, [key], [key], fanout, block).verified())


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and folded root; where 7 divides the crc32 of doc_id as text, n_chars is
    one more when the leaf is folded (a null n_chars or doc_id changes nothing)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = verified(table(spark, sf_dir, "documents"), changes={"n_chars": F.col("n_chars") + 1}, where=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: the same in DuckDB SQL
OP11_SQL = """WITH RECURSIVE b AS (SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT) AS digits FROM documents),
c AS (SELECT * EXCLUDE (digits), xor(list_reduce(digits, lambda c, x: list_reduce(range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END, xor(c, x)), 4294967295::UBIGINT), 4294967295::UBIGINT) AS crc FROM b),
l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (
  SELECT doc_id, coalesce(concat('=' || lang), '') AS tree, sha256(concat({head}, {told_n}, {text})) AS leaf, sha256(concat({head}, {told_bent}, {text})) AS bent FROM c)),
lv AS (SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l0
  UNION ALL SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY tree, level, i // 2, n),
t0 AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM lv WHERE n = 1),
tp AS (SELECT 0 AS level, i, h, count(*) OVER () AS n FROM t0 UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tp WHERE n > 1 GROUP BY level, i // 2, n),
fo AS (SELECT tree, i AS k, 0 AS level, i, bent AS h, '' AS proof FROM l0
  UNION ALL SELECT f.tree, f.k, f.level + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 1 THEN concat(s.h, f.h) ELSE concat(f.h, s.h) END), concat(f.proof, s.h)
  FROM fo f JOIN lv o ON o.tree = f.tree AND o.level = f.level AND o.i = f.i AND o.n > 1 LEFT JOIN lv s ON s.tree = f.tree AND s.level = f.level AND s.i = xor(f.i, 1)),
ft AS (SELECT f.tree, k, 0 AS level, t0.i, f.h, proof FROM fo f JOIN lv o ON o.tree = f.tree AND o.level = f.level AND o.i = f.i AND o.n = 1 JOIN t0 ON t0.tree = f.tree
  UNION ALL SELECT f.tree, f.k, f.level + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 1 THEN concat(s.h, f.h) ELSE concat(f.h, s.h) END), concat(f.proof, s.h)
  FROM ft f JOIN tp o ON o.level = f.level AND o.i = f.i AND o.n > 1 LEFT JOIN tp s ON s.level = f.level AND s.i = xor(f.i, 1))
SELECT doc_id, leaf, t0.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM ft f JOIN tp r ON r.level = f.level AND r.i = f.i AND r.n = 1 JOIN l0 ON l0.tree = f.tree AND l0.i = f.k JOIN t0 ON t0.tree = f.tree""".format(
    head=", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}) END" for c in ("doc_id", "source", "lang")),
    told_n="CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END",
    told_bent="CASE WHEN n_chars IS NULL THEN '-' WHEN crc % 7 = 0 THEN concat(strlen((n_chars + 1)::VARCHAR), ':', n_chars + 1) ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END",
    text="CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END",
)
