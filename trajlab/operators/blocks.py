"""All pairs of a cloud's points, by pairs of bounded blocks.

A cloud is what shares a key (a run, a model, a list of centres); its points are dealt
into at most SIDES blocks, larger ones for a larger cloud, and each two blocks meet in a
task of their own, tile by tile. So a point is sent SIDES times at most, however many
there are. The task gives what it reduces its pairs to (nearest ones, counts, minima, a
forest), so no row is a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: points of a tile; a task holds the distances of two at a time
BLOCK = 1024
#: blocks of a cloud at most, as long as a block has up to MOST points
SIDES, MOST = 16, 32_768

Side = dict[str, "np.ndarray | pa.Array"]
Found = dict[str, "np.ndarray | pa.Array"]
Step = Callable[[Side, "Side | None"], Found]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of two sets of vectors, as a product of matrices; what that leaves inexact, as the
    points nearly coincide, is taken from the differences."""
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    square = size - 2 * x @ y.T
    i, j = np.nonzero(square <= 1e-4 * size)
    for a in range(0, len(i), 1 << 16):
        p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        square[p, q] = ((x[p] - y[q]) ** 2).sum(1)
    return np.sqrt(np.maximum(square, 0.0))


class Halves:
    """Squared distances of x to y by tiles in single precision, of which no one is off by more than `slack`; exact
    ones of some pairs. Both are in units of `unit`."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        full = np.isfinite(x).all(1)
        centre = x[full].mean(0) if full.any() else np.zeros(x.shape[1])
        self.x, self.y = x, y
        with np.errstate(invalid="ignore"):
            size = max((float(np.abs(z[np.isfinite(z)], dtype=float).max(initial=0.0)) for z in (x - centre, y - centre)), default=0.0)
            self.unit = size * size or 1.0
            p, q = (((z - centre) / np.sqrt(self.unit)).astype(np.float32) for z in (x, y))
            sp, sq = (p * p).sum(1), (q * q).sum(1)
        self.left = np.column_stack([p, sp, np.ones_like(sp)])
        self.right = np.column_stack([-2 * q, np.ones_like(sq), sq])
        most = max((float(z[np.isfinite(z)].max(initial=0.0)) for z in (sp, sq)), default=0.0)
        self.slack = (x.shape[1] + 16) * 2.0**-21 * most

    def tile(self, a: int, b: int, block: int) -> np.ndarray:
        return self.left[a : a + block] @ self.right[b : b + block].T

    def squares(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows i of x to rows j of y."""
        parts = [((self.x[i[a : a + (1 << 16)]] - self.y[j[a : a + (1 << 16)]]) ** 2).sum(1) for a in range(0, len(i), 1 << 16)]
        return np.concatenate(parts) if parts else np.empty(0)


def below(g: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is below its row's limit, or below the limits one by one, in the order of g's memory;
    g may be a transposed tile. Few are, so the mask is searched flat."""
    if g.flags.c_contiguous:
        return divmod(np.flatnonzero(g < (limit[:, None] if limit.ndim == 1 else limit)), g.shape[1])
    j, i = divmod(np.flatnonzero(g.T < limit.T), g.shape[0])
    return i, j


def between(a: Side, b: Side | None) -> np.ndarray:
    """Distances of all points of a block to those of another; of a block to itself, where a point has none to
    itself (NaN)."""
    d = distances(a["v"], (b or a)["v"])
    if b is None:
        np.fill_diagonal(d, np.nan)
    return d


def _side(rows: pa.Array) -> Side:
    """A block's fields: vectors (v) as a matrix, numbers as arrays, ids as they are."""
    fields = {f.name: rows.field(f.name) for f in rows.type}
    out: Side = {"id": fields.pop("id")}
    flat = fields.pop("v").flatten().to_numpy(zero_copy_only=False)
    out["v"] = flat.reshape(len(rows), -1) if len(rows) else np.empty((0, 1))
    return out | {n: x.to_numpy(zero_copy_only=False) for n, x in fields.items()}


def n_blocks(n: Column, block: int) -> Column:
    return F.greatest(F.ceil(n / MOST), F.least(F.ceil(n / block), F.lit(SIDES))).cast("int")


def dealt(points: DataFrame, key: list[str], fields: list[str], block: int = BLOCK, place: str | None = None) -> DataFrame:
    """(key, _i, _j, _second, _rows): each block of a cloud's points (id, v, *fields) at each pair of blocks that
    it is in; see n_blocks. A task that meets a pair gets two such rows. place: a field that numbers a cloud's
    points from 0; then blocks are ranges of it."""
    count = F.count("*")
    sizes = points.groupBy(*key).agg(n_blocks(count, block).alias("_n"), count.alias("_count"))
    own = F.pmod(F.xxhash64("id"), F.col("_n")) if place is None else range_of(F.col(place), F.col("_n"), F.col("_count"))
    # dealt out by block: else the join's partitions, one for each cloud, would serve for the blocks too
    parts = points.join(sizes, key).withColumn("_own", own.cast("int")).repartition(*key, "_own")
    blocks = parts.groupBy(*key, "_own").agg(F.first("_n").alias("_n"), F.collect_list(F.struct("id", "v", *fields)).alias("_rows"))
    spread = blocks.select(*key, "_own", "_rows", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
    return spread.select(*key, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).alias("_second"), "_rows")


def range_of(place: Column, n: Column, count: Column) -> Column:
    """Which of n ranges of equal length, over count places, a place is in."""
    return F.floor(place * n / count)


def cut(side: Side, block: int) -> list[Side]:
    return [{k: x[a : a + block] for k, x in side.items()} for a in range(0, len(side["id"]), block)]


def _tiled(step: Step, a: Side, b: Side | None, block: int) -> Found | None:
    """What step makes of each two tiles, one behind another."""
    if b is None:
        tiles = cut(a, block)
        found = [step(x, None if i == j else y) for i, x in enumerate(tiles) for j, y in enumerate(tiles) if i <= j]
    else:
        others = cut(b, block)
        found = [step(x, y) for x in cut(a, block) for y in others]
    joined = {c: [f[c] if isinstance(f[c], pa.Array) else pa.array(f[c]) for f in found] for c in (found[0] if found else ())}
    return {c: pa.concat_arrays(x) for c, x in joined.items()} or None


def meet(points: DataFrame, key: list[str], step: Step, schema: str, fields: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(key, *schema): what step makes of each two tiles of up to `block` points of a cloud, and of each tile with
    itself (then its second argument is None). points: (key, id, v, *fields), v an array of doubles, all of a
    cloud equally long."""
    return meet_blocks(points, key, lambda keys, i, j, a, b: _tiled(step, a, b, block), schema, fields, block)


def meet_blocks(points: DataFrame, key: list[str], step: Callable[[tuple, int, int, Side, "Side | None"], Found | None], schema: str, fields: list[str] | None = None, block: int = BLOCK, place: str | None = None) -> DataFrame:
    """As meet, but step has two whole blocks, of MOST points at most as long as a cloud has SIDES * MOST: it is
    called with the cloud's key, the numbers of the blocks and their points, and cuts them itself."""
    fields = fields or []
    made = T.StructType.fromDDL(schema)
    out = T.StructType([*(points.schema[k] for k in key), *made.fields])
    n_keys, names = len(key), [f.name for f in made.fields]

    def called(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sides = {second: _side(rows) for second, rows in zip(table.column("_second").to_pylist(), _blocks(table.column("_rows")), strict=True)}
        told = tuple(k.as_py() for k in keys)
        i, j = told[n_keys:]
        # a block that the dealing left empty meets nothing
        found = step(told[:n_keys], i, j, sides[False], sides.get(True)) if i == j or len(sides) == 2 else None
        n = len(next(iter(found.values()))) if found else 0
        own = [pa.array([k.as_py()] * n, k.type) for k in keys[:n_keys]]
        return pa.table([*own, *(pa.array(found[c]) if found else pa.array([]) for c in names)], [*key, *names])

    return dealt(points, key, fields, block, place).repartition(*key, "_i", "_j").groupBy(*key, "_i", "_j").applyInArrow(called, out)


def _blocks(column: pa.ChunkedArray) -> Iterator[pa.Array]:
    for chunk in column.chunks:
        flat, at = chunk.flatten(), 0
        for n in chunk.value_lengths().to_pylist():
            yield flat.slice(at, n)
            at += n
