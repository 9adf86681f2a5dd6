"""Windows of a text that start anywhere else in the corpus too: the routing shared by two operators.

A window is `window` consecutive units (bytes or words) of one text. Its anchor
is the leftmost of its `gram`-unit pieces with the least hash, so equal windows
have equal anchors wherever they stand. The windows with one anchor in a text
form a segment; the segments of an anchor are the only text in which its windows can
repeat. So:

1. segments are counted by anchor (partial sums first); an anchor that occurs
   once has no repeat;
2. of the others, one segment of each distinct content is fetched from its text
   and brought to its anchor, where a block of anchors is indexed and searched
   by the operator's own method (`Matcher`), which is told of copies;
3. an anchor with more than `hot` segments would make a block too large: its
   distinct segments are cut into pieces of a few windows, and pieces with the
   same units in the middle of all their windows (the core) go to a block of
   their own. Where even a core has more than `hot` different pieces, its windows
   are counted by hash (partial sums first), so that no group meets in one task.

Copies of a segment travel as one; segments are taken as copies by a 64-bit hash
of all their units. Every text is read whole, and what a task holds is bounded by
a block or by one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlab.llm.tables import Scratch, keyed, same_row
from trajlab.llm.text import NOT_SPACE, Words, packed, range_hashes, released, slices, string_view, unpacked, window_hashes

#: segments of an anchor, or pieces of a core, that are indexed together
HOT = 4096
#: units of a block, which the index's packed keys hold
BLOCK_UNITS = 1 << 19
#: starts hashed at a time
CHUNK = 1 << 20
#: windows of a piece of a hot anchor's segment
STARTS = 12
#: bits of an anchor's key that give its place in a chunk
PLACE = np.uint64((1 << 21) - 1)

#: (units of each segment, number of windows of each, whether it has copies) to runs (segment, first start, end of
#: starts) of windows that start elsewhere in the block, or in a copy
Matcher = Callable[[list[np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Windows:
    """unit: "bytes" or "words". gram: units whose hash can be an anchor."""

    unit: str
    window: int
    gram: int

    @property
    def starts(self) -> int:
        """Windows of a piece; all of them have units in common."""
        return min(STARTS, max(1, self.window // 2))

    def raw(self) -> Windows:
        """The same over columns that hold units, eight bytes each, where units are words."""
        return Windows(self.unit if self.unit == "bytes" else "hashes", self.window, self.gram)

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts in a row, and the range of each text."""
        if self.unit == "bytes":
            return string_view(column)
        if self.unit == "hashes":
            data, offsets = string_view(column)
            return np.ascontiguousarray(data).view(np.uint64), offsets // 8
        w = Words(column, NOT_SPACE)
        return w.hashes(), w.rows


def segments(values: np.ndarray, offsets: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """text, first start, number of starts, anchor and content hash of each segment."""
    span = w.window - w.gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(0, len(values) - w.window + 1), CHUNK):
        part = values[a : a + CHUNK + w.window - 1]
        grams = window_hashes(part, w.gram)
        n = len(part) - w.window + 1
        # leftmost least hash of each `span` grams: minima, with the place in the low bits, from both ends
        # of blocks of `span`. Equal windows get it at equal places, and no two of them the same one.
        key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        blocks = np.concatenate([key, np.full(-len(grams) % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & PLACE).astype(np.int64)
        start = np.arange(a, a + n)
        text = np.searchsorted(offsets, start, "right") - 1
        whole = start + w.window <= offsets[text + 1]
        start, text, place = start[whole], text[whole], place[whole]
        if not len(start):
            continue
        fresh = np.ones(len(start), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(start)))
        lo = start[first]
        found.append((text[first], lo - offsets[text[first]], count, grams[place[first]], range_hashes(values, lo, lo + count - 1 + w.window)))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@released
def _segments(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        text, lo, n, anchor, content = segments(*w.units(batch.column("text")), w)
        take = pa.array(text, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], ["doc_id", "text_key", "lo", "n", "anchor", "content"])


@released
def _fetched(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted segment: (anchor, content, n, many, hot, segment)."""
    names = ["anchor", "content", "n", "many", "hot"]
    for batch in batches:
        wanted, blobs = batch.column("wanted"), batch.column("blob")
        for r in range(batch.num_rows):
            (text,) = unpacked(blobs.slice(r, 1))
            rows = pa.RecordBatch.from_struct_array(wanted[r].values)
            lo, n = rows.column("lo").to_numpy(), rows.column("n").to_numpy()
            if w.unit == "bytes":
                begin, end = lo, lo + n - 1 + w.window
            else:
                words = Words(pa.array([text], pa.binary()), NOT_SPACE)
                begin, end = words.starts[lo], words.ends[lo + n - 2 + w.window]
            pieces = pa.array([text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pieces], [*names, "segment"])


@released
def _matched(batches: Iterator[pa.RecordBatch], w: Windows, matcher: Matcher) -> Iterator[pa.RecordBatch]:
    """Rows come in order of anchor. Whole anchors are gathered into blocks and searched."""

    def searched(rows: pa.Table) -> pa.RecordBatch:
        values, offsets = w.units(rows.column("segment").combine_chunks())
        n = rows.column("n").to_numpy().astype(np.int64)
        many = rows.column("many").to_numpy(zero_copy_only=False).astype(bool)
        row, a, b = matcher([values[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], n, many)
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([rows.column("anchor").combine_chunks().take(take), rows.column("content").combine_chunks().take(take), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["anchor", "content", "a", "b"])

    held: list[pa.RecordBatch] = []
    group: list[pa.RecordBatch] = []
    held_size = group_size = 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        sizes = np.diff(string_view(batch.column("segment"))[1]) + 1
        cuts = np.flatnonzero(np.concatenate([[last is None or anchor[0] != last], anchor[1:] != anchor[:-1]]))
        edges = np.unique(np.concatenate([[0], cuts, [len(anchor)]]))
        new = set(cuts.tolist())
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if x in new:
                if held and held_size + group_size > BLOCK_UNITS:
                    yield searched(pa.Table.from_batches(held))
                    held, held_size = [], 0
                held += group
                held_size += group_size
                group, group_size = [], 0
            group.append(batch.slice(x, y - x))
            group_size += int(sizes[x:y].sum())
        last = anchor[-1]
    if held and held_size + group_size > BLOCK_UNITS:
        yield searched(pa.Table.from_batches(held))
        held = []
    if held or group:
        yield searched(pa.Table.from_batches(held + group))


@released
def _pieces(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """Each segment in pieces of w.starts windows, numbered (r) from its anchor, with the hash of the units
    that all windows of the piece have in common (core) and of all its units (whole), and these units."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            values, offsets = w.units(part.column("segment"))
            n = part.column("n").to_numpy().astype(np.int64)
            anchor = part.column("anchor").to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(len(n)), np.diff(offsets))[: max(0, len(values) - w.gram + 1)]
            same = np.flatnonzero(window_hashes(values, w.gram) == anchor[owner])
            # the anchor is its segment's first piece with that hash; ranges of starts are counted back from it
            p = same[np.searchsorted(same, offsets[:-1])] - offsets[:-1]
            last, first = p // w.starts, (p - n + 1) // w.starts
            per = last - first + 1
            row = np.repeat(np.arange(len(n)), per)
            r = last[row] - (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per))
            end = p[row] - r * w.starts
            a = np.maximum(0, end - w.starts + 1)
            m = np.minimum(n[row] - 1, end) - a + 1
            lo = offsets[:-1][row] + a
            # a range cut short by its segment has the core of the full one within its units
            core = range_hashes(values, offsets[:-1][row] + end, offsets[:-1][row] + end - w.starts + 1 + w.window)
            whole = range_hashes(values, lo, lo + m - 1 + w.window)
            take = pa.array(row)
            many = part.column("many").to_numpy(zero_copy_only=False)
            pieces = [values[x:y].tobytes() for x, y in zip(lo.tolist(), (lo + m - 1 + w.window).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("anchor").take(take), part.column("content").take(take), pa.array(a, pa.int32()), pa.array(m, pa.int32()), pa.array(r, pa.int32()), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(np.where(many, 2, 1)[row], pa.int64()), pa.array(pieces, pa.binary())], ["anchor", "content", "a", "m", "r", "core", "whole", "weight", "piece"])


def _exploded(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """Each window of each piece with its hash."""
    kind = np.uint8 if w.unit == "bytes" else np.uint64
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            values = np.frombuffer(b"".join(part.column("segment").to_pylist()), kind)
            m = part.column("n").to_numpy().astype(np.int64)
            sizes = m + w.window - 1
            row = np.repeat(np.arange(len(m)), m)
            at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            h = window_hashes(values, w.window)[(np.cumsum(sizes) - sizes)[row] + at]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("anchor").take(take), part.column("content").take(take), pa.array(at, pa.int32()), pa.array(h.view(np.int64)), pa.array(np.where(part.column("many").to_numpy(zero_copy_only=False), 2, 1)[row], pa.int64())], ["anchor", "content", "a", "h", "weight"])


_FOUND = "anchor long, content long, a int, b int"


def _searched(classes: DataFrame, w: Windows, matcher: Matcher, raw: bool = False) -> DataFrame:
    """(anchor, content, a, b): runs of repeated windows of classes (anchor, content, n, many, segment) by the
    operator's method."""
    given = w.raw() if raw else w
    return classes.select("anchor", "content", "n", "many", "segment").repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(lambda it: _matched(it, given, matcher), _FOUND)


def _crowded(pieces: DataFrame, w: Windows, matcher: Matcher, hot: int, scratch: Scratch) -> DataFrame:
    """The same for hot anchors' classes, by way of pieces."""
    parts = pieces.mapInArrow(lambda it: _pieces(it, w), "anchor long, content long, a int, m int, r int, core long, whole long, weight long, piece binary")
    parts = scratch.stored(parts.withColumn("key", F.xxhash64("anchor", "r", "core")), "parts")
    groups = scratch.stored(parts.groupBy("key").agg(F.sum("weight").alias("total"), F.count("*").alias("n_parts")).where("total > 1"), "cores")
    shared = parts.join(groups, "key")
    classes = scratch.stored(shared.groupBy(F.col("key").alias("anchor"), F.col("whole").alias("content")).agg(F.first("m").alias("n"), (F.sum("weight") > 1).alias("many"), F.first("piece").alias("segment"), F.first("n_parts").alias("n_parts")), "core-classes")
    usual = _searched(classes.where(F.col("n_parts") <= hot), w, matcher, raw=True)
    windows = classes.where(F.col("n_parts") > hot).select("anchor", "content", "n", "many", "segment").mapInArrow(lambda it: _exploded(it, w), "anchor long, content long, a int, h long, weight long")
    again = windows.groupBy("anchor", "h").agg(F.sum("weight").alias("weight")).where("weight > 1").select("anchor", "h")
    counted = windows.join(again, ["anchor", "h"]).select("anchor", "content", "a", (F.col("a") + 1).alias("b"))
    found = scratch.stored(usual.unionByName(counted).select(F.col("anchor").alias("key"), F.col("content").alias("whole"), F.col("a").alias("x"), F.col("b").alias("y")), "core-runs")
    return parts.select("anchor", "content", "a", "key", "whole").join(found, ["key", "whole"]).select("anchor", "content", (F.col("a") + F.col("x")).alias("a"), (F.col("a") + F.col("y")).alias("b"))


def repeated(documents: DataFrame, w: Windows, matcher: Matcher, hot: int = HOT) -> DataFrame:
    """doc_id, text_key, spans: ranges of units (a, b) covered by windows that start elsewhere too,
    for the rows that have any; the ranges may touch and overlap.

    A null, empty or short text has no window; an empty table gives no rows. Repeated rows are occurrences of
    their own, so they repeat each other whole; a null doc_id is a document like any other. Of equal windows
    (ties) all are repeats, the first one too.
    """
    docs = keyed(documents)
    with Scratch(documents.sparkSession) as scratch:
        rows = scratch.stored(docs.mapInArrow(lambda it: _segments(it, w), "doc_id long, text_key long, lo int, n int, anchor long, content long"), "rows")
        # tables of their own, so that the rows of a frequent anchor are dealt to several tasks where they are joined
        anchors = scratch.stored(rows.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1").select("anchor", (F.col("total") > hot).alias("hot")), "anchors")
        shared = scratch.stored(rows.join(anchors, "anchor"), "segments")
        scratch.drop(rows, anchors)

        classes = shared.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "text_key", "lo", "n", "hot")).alias("at"), (F.count("*") > 1).alias("many"))
        wanted = classes.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(F.collect_list(F.struct("anchor", "content", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"), "many", F.col("at.hot").alias("hot"))).alias("wanted"))
        blobs = docs.mapInArrow(packed, "doc_id long, text_key long, blob binary")
        texts = blobs.join(wanted, same_row(blobs, wanted)).select("wanted", "blob")
        # repeated rows fetch a segment once each: its copies are known already, so one of them will do
        pieces = scratch.stored(texts.mapInArrow(lambda it: _fetched(it, w), "anchor long, content long, n int, many boolean, hot boolean, segment binary"), "pieces")
        once = pieces.where("hot").dropDuplicates(["anchor", "content"])
        found = _searched(pieces.where("not hot"), w, matcher).unionByName(_crowded(once, w, matcher, hot, scratch))
        runs = scratch.stored(found.groupBy("anchor", "content").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "runs")
        scratch.drop(pieces)
        width = w.window - 1
        partly = shared.join(runs, ["anchor", "content"]).select("doc_id", "text_key", F.transform("runs", lambda r: F.struct((F.col("lo") + r["a"]).alias("a"), (F.col("lo") + r["b"] + width).alias("b"))).alias("spans"))
        return scratch.result(partly.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def with_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, blob (packed text) and spans (null if none) of every row."""
    blobs = keyed(documents).mapInArrow(packed, "doc_id long, text_key long, blob binary")
    return blobs.join(spans, same_row(blobs, spans), "left").select(blobs["doc_id"], "blob", "spans")


def merged(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges, in order, of one row's spans."""
    if not spans.is_valid or not len(spans.values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = pa.RecordBatch.from_struct_array(spans.values)
    a, b = rows.column("a").to_numpy().astype(np.int64), rows.column("b").to_numpy().astype(np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    cut = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return a[cut], b[np.append(cut[1:] - 1, len(b) - 1)]
