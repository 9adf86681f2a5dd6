"""SentencePiece encoding and decoding as a (max, +) scan over chunks of a text.

An encoding is a path of pieces through the text. In a byte-pair model a path is
the encoding exactly if each two neighbouring pieces fit: merged as a text of
their own, they stay as they are. So the pieces by which a path may cross a border
are all that a chunk needs to know of what stands before it. In a unigram model
the greatest sum of scores counts, and only where the last piece ends matters.

Giant texts are cut into chunks of fixed length. Each chunk, without knowing the
others, gives a matrix: from every state at its left border to every state at its
right one the best score in between, or none. The matrices combine by (max, +),
associatively, in a tree; going down the tree again every border gets its state,
and every chunk traces its own pieces back alone.

Within a chunk a white-space mark behind another character opens a new unit: no
piece holds such a place, so all paths pass there, equal units are encoded once,
and a chunk's matrix depends on its first and last units alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.piece_model import MARK, NONE, PieceModel, Lanes, model
from trajlab.llm.tables import keyed, table
from trajlab.llm.text import released, slices, unpacked
from trajlab.llm.units import split_at_spaces

__all__ = ["MARK", "PieceModel", "decoded", "encoded", "model", "units"]

#: characters of a chunk; texts up to this length are one
CHUNK = 1 << 14
#: chunks that a task takes at a time
AT_ONCE = 64
#: chunks whose matrices one task combines
GROUP = 256


def units(s: str) -> list[str]:
    """Runs of marks with what follows them; the first may lack its marks."""
    out = []
    parts = s.split(MARK)
    if not parts[0] and all(parts[1:]):
        return [MARK + p for p in parts[1:]]
    if parts[0]:
        out.append(parts[0])
    marks = 0
    for part in parts[1:]:
        marks += 1
        if part:
            out.append(MARK * marks + part)
            marks = 0
    if marks:
        out.append(MARK * marks)
    return out


# ---------------------------------------------------------------- chunks


def cut(m: PieceModel, s: str, size: int) -> list[tuple[str, str, str, int]]:
    """(behind, text, ahead, inside) of each chunk of s: the characters around it that a piece across its
    borders may hold, and how far it begins within a unit."""
    size = max(size, m.longest)
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    mark = codes == ord(MARK)
    opens = np.flatnonzero(np.concatenate([[True], mark[1:] & ~mark[:-1]]))
    out = []
    for a in range(0, len(s), size):
        inside = a - int(opens[np.searchsorted(opens, a, "right") - 1])
        out.append((s[max(0, a - m.longest) : a], s[a : a + size], s[a + size : a + size + m.longest - 1], inside))
    return out


def _openings(behind: str, text: str) -> tuple[int, int]:
    """First and last place in a chunk where a unit opens, -1 if none."""
    mark = np.frombuffer((behind[-1:] + text).encode("utf-32-le"), np.uint32) == ord(MARK)
    at = np.flatnonzero(mark[1:] & ~mark[:-1]) + (0 if behind else 1)
    return (int(at[0]), int(at[-1])) if len(at) else (-1, -1)


class Chunks:
    """Chunks of any texts, side by side."""

    def __init__(self, m: PieceModel, rows: list[tuple[str, str, str, int]]):
        self.m, self.rows = m, rows
        self.open = [_openings(b, t) for b, t, _, _ in rows]
        left = m.states([(b, t) for b, t, _, _ in rows])
        right = m.states([((b + t[-m.longest :])[-m.longest :], a) for b, t, a, _ in rows])
        self.states = [(x, y if a else [m.last_state()]) for x, y, (_, _, a, _) in zip(left, right, rows, strict=True)]

    def matrices(self) -> list[np.ndarray]:
        """Best scores from every state at the left border of a chunk to every one at its right border,
        less what all of them have in common."""
        heads, tails = Lanes(self.m), Lanes(self.m)
        plan = []
        for (b, t, a, inside), (first, last), (left, right) in zip(self.rows, self.open, self.states, strict=True):
            n = len(t)
            if first < 0:
                plan.append((heads.n, len(left), -1))
                for state in left:
                    heads.add(t + a, state, inside, n)
            else:
                plan.append((heads.n, len(left), tails.n))
                for state in left:
                    heads.add(t[:first], state, inside, first)
                tails.add(t[last:] + a, None, 0, n - last)
        heads.run()
        tails.run()
        out = []
        for (h, k, tail), (b, t, a, _), (first, last), (_, right) in zip(plan, self.rows, self.open, self.states, strict=True):
            n = len(t)
            if tail < 0:
                out.append(np.stack([heads.exits(h + i, n, right) for i in range(k)]))
            else:
                head = np.array([heads.exit(h + i, first) for i in range(k)])
                out.append(head[:, None] + tails.exits(tail, n - last, right)[None, :])
        return out

    def traced(self, between: list[tuple[int, int]]) -> list[np.ndarray]:
        """The ids of the pieces that start in each chunk, given the numbers of its states at both borders."""
        heads, tails = Lanes(self.m), Lanes(self.m)
        plan = []
        for (b, t, a, inside), (first, last), (left, right), (i, j) in zip(self.rows, self.open, self.states, between, strict=True):
            n = len(t)
            if first < 0:
                plan.append((heads.add(t + a, left[i], inside, n), -1))
            else:
                plan.append((heads.add(t[:first], left[i], inside, first), tails.add(t[last:] + a, None, 0, n - last)))
        heads.run()
        tails.run()
        middles = [units(t[first:last]) if 0 <= first < last else [] for (_, t, _, _), (first, last) in zip(self.rows, self.open, strict=True)]
        ids, counts = self.m.units.ids([u for x in middles for u in x])
        ends = np.concatenate([[0], np.cumsum(counts)])
        at, out = 0, []
        for (h, tail), (b, t, a, _), (first, last), (_, right), (_, j), middle in zip(plan, self.rows, self.open, self.states, between, middles, strict=True):
            n = len(t)
            body = ids[ends[at] : ends[at + len(middle)]]
            at += len(middle)
            if tail < 0:
                out.append(heads.trace(h, n, right[j]))
            else:
                out.append(np.concatenate([heads.trace(h, first, None), body, tails.trace(tail, n - last, right[j])]))
        return out


def crossed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The (max, +) product: across two neighbouring stretches."""
    return (left[:, :, None] + right[None, :, :]).max(1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Across all of them, halves first."""
    while len(matrices) > 1:
        matrices = [crossed(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def borders(matrices: list[np.ndarray], entry: int, exit: int) -> list[int]:
    """The states at all borders of the best path from `entry` before the first to `exit` behind the last."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([crossed(*x[k : k + 2]) if k + 1 < len(x) else x[k] for k in range(0, len(x), 2)])
    found = [entry, exit]
    for level in reversed(levels[:-1]):
        finer = [entry]
        for k in range(0, len(level), 2):
            a, b = found[k // 2], found[k // 2 + 1]
            if k + 1 < len(level):
                finer.append(int(np.argmax(level[k][a, :] + level[k + 1][:, b])))
            finer.append(b)
        found = finer
    return found


# ---------------------------------------------------------------- in tasks

_ENCODED = "doc_id long, text_key long, ids array<int>"
_KEY = "doc_id long, text_key long, chunk int"


def _listed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def _plain(m: PieceModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of texts of one chunk in a row, and the number of ids of each."""
    counts = np.zeros(len(texts), np.int64)
    parts, at, n_parts = split_at_spaces(texts)
    whole = np.array([p != "" and MARK not in p for p in parts], bool)
    full = n_parts > 0
    odd = np.zeros(len(texts), bool)
    if full.any():
        odd[full] = np.logical_or.reduceat(~whole[at], (np.cumsum(n_parts) - n_parts)[full])
    usual = np.repeat(~odd, n_parts)
    used = np.flatnonzero(np.bincount(at[usual], minlength=len(parts)))
    place = np.zeros(len(parts), np.int64)
    place[used] = np.arange(len(used))
    ids, n = m.units.ids([MARK + parts[i] for i in used.tolist()], place[at[usual]])
    good = np.flatnonzero(full & ~odd)
    if len(good):
        counts[good] = np.add.reduceat(n, np.cumsum(n_parts[good]) - n_parts[good])
    rest = np.flatnonzero(odd)
    if not len(rest):
        return ids, counts
    # white space that isn't one space between two words: units are taken apart one by one
    lists = [units(m.normal(t)) for t in texts.take(pa.array(rest)).to_pylist()]
    more, n = m.units.ids([u for x in lists for u in x])
    owner = np.repeat(np.arange(len(rest)), [len(x) for x in lists])
    counts[rest] = np.bincount(owner, n, len(rest)).astype(np.int64)
    order = np.concatenate([good, rest])
    start = np.zeros(len(texts), np.int64)
    start[order] = np.cumsum(counts[order]) - counts[order]
    ends = np.cumsum(counts)
    return np.concatenate([ids, more])[np.repeat(start - ends + counts, counts) + np.arange(int(counts.sum()))], counts


#: what becomes of rows (doc_id, text_key, ids) where they are made: each pass more is a Python process more
Finish = Callable[[pa.RecordBatch, PieceModel], Iterator[pa.RecordBatch]]


def _as_is(batch: pa.RecordBatch, m: PieceModel) -> Iterator[pa.RecordBatch]:
    yield batch


def _short(batches: Iterator[pa.RecordBatch], path: str, finish: Finish) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in slices(batches, "text", 2 << 20):
        yield from finish(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), _listed(*_plain(m, batch.column("text")))], ["doc_id", "text_key", "ids"]), m)
    m.shrink()


@released
def _cut(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    """The chunks of giant texts, some at a time."""
    m, squeeze = model(path), zstandard.ZstdCompressor(level=1)
    for batch in slices(batches, "text", 1 << 20):
        for d, k, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")), strict=True):
            rows = cut(m, m.normal(text), size)
            for i in range(0, len(rows), 256):
                some = list(zip(*rows[i : i + 256], strict=True))
                n = len(some[0])
                behind, text, ahead, inside = some
                blobs = [squeeze.compress(x.encode()) for x in text]
                yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int64()), pa.array([k] * n, pa.int64()), pa.array(range(i, i + n), pa.int32()), pa.array(behind), pa.array(blobs, pa.binary()), pa.array(ahead), pa.array(inside, pa.int32())], ["doc_id", "text_key", "chunk", "behind", "blob", "ahead", "inside"])


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(a, AT_ONCE)


def _rows(batch: pa.RecordBatch) -> list[tuple[str, str, str, int]]:
    texts = [x.decode() for x in unpacked(batch.column("blob"))]
    return list(zip(batch.column("behind").to_pylist(), texts, batch.column("ahead").to_pylist(), batch.column("inside").to_pylist(), strict=True))


def _packed(x: np.ndarray) -> bytes:
    """The matrix with its number of rows in front."""
    return np.int32(x.shape[0]).tobytes() + x.astype(np.complex128).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.complex128, offset=4).reshape(int(np.frombuffer(blob, np.int32, 1)[0]), -1)


@released
def _matrices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in _some(batches):
        found = [_packed(x) for x in Chunks(m, _rows(batch)).matrices()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "chunk")), pa.array(found, pa.binary())], ["doc_id", "text_key", "chunk", "matrix"])


def _in_order(parts: list[dict]) -> tuple[list[int], list[np.ndarray]]:
    """Numbers and matrices in order. A repeated row brings its chunks again."""
    found = {x["chunk"]: x["matrix"] for x in parts}
    return sorted(found), [_unpacked(found[k]) for k in sorted(found)]


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix for each group of chunks."""
    for batch in batches:
        found = [_packed(product(_in_order(x)[1])) for x in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "group")), pa.array(found, pa.binary())], ["doc_id", "text_key", "chunk", "matrix"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at both borders of each part, given those around all of them."""
    for batch in batches:
        for d, k, parts, entry, exit in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "parts", "entry", "exit")), strict=True):
            number, matrices = _in_order(parts)
            state = borders(matrices, entry, exit)
            n = len(number)
            yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int64()), pa.array([k] * n, pa.int64()), pa.array(number, pa.int32()), pa.array(state[:-1], pa.int32()), pa.array(state[1:], pa.int32())], ["doc_id", "text_key", "chunk", "entry", "exit"])


def _traced(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m, squeeze = model(path), zstandard.ZstdCompressor(level=1)
    for batch in _some(batches):
        between = list(zip(batch.column("entry").to_pylist(), batch.column("exit").to_pylist(), strict=True))
        ids = Chunks(m, _rows(batch)).traced(between)
        blobs = [squeeze.compress(x.astype(m.kind).tobytes()) for x in ids]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "chunk")), pa.array(blobs, pa.binary())], ["doc_id", "text_key", "chunk", "blob"])
    m.shrink()


@released
def _assembled(batches: Iterator[pa.RecordBatch], path: str, finish: Finish) -> Iterator[pa.RecordBatch]:
    """The ids of whole texts, as often as their rows came."""
    m, expand = model(path), zstandard.ZstdDecompressor()
    kind = m.kind
    for batch in batches:
        for d, k, parts, copies in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "parts", "copies")), strict=True):
            ids = np.concatenate([np.frombuffer(expand.decompress(x["blob"]), kind) for x in parts]).astype(np.int32)
            for _ in range(copies):
                yield from finish(pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([k], pa.int64()), _listed(ids, np.array([len(ids)]))], ["doc_id", "text_key", "ids"]), m)


def _met(a: str, b: str, *more: str):
    return F.expr(" and ".join([f"{a}.doc_id <=> {b}.doc_id and {a}.text_key = {b}.text_key", *(f"{a}.{x} = {b}.{x}" for x in more)]))


def encoded(documents: DataFrame, model_path: str, chunk: int = CHUNK, group: int = GROUP, finish: Finish = _as_is, schema: str = _ENCODED) -> DataFrame:
    """doc_id, text_key, ids of every row, or what finish makes of them.

    A null or empty text has no ids; an empty table gives no rows. Repeated rows have the same ids each.
    Texts of up to `chunk` characters are encoded where they are read; longer ones go by chunks, spread
    over all tasks, whose matrices are combined `group` at a time and then over the groups of a text. No
    chunk length changes an id: a byte-pair encoding is unique, and among paths of a unigram model with
    equal scores (in steps of 2**-16) the choice hangs on places within units.
    """
    docs = keyed(documents)
    giant = F.length("text") >= chunk  # the mark in front counts
    short = docs.where(~F.coalesce(giant, F.lit(False))).mapInArrow(lambda it: _short(it, model_path, finish), schema)
    pieces = docs.where(giant).mapInArrow(lambda it: _cut(it, model_path, chunk), f"{_KEY}, behind string, blob binary, ahead string, inside int")
    # few bytes, much work: a number of partitions of its own, so that they aren't merged by size
    chunks = pieces.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text_key", "chunk")
    part, across = F.collect_list(F.struct("chunk", "matrix")).alias("parts"), f"{_KEY}, entry int, exit int"
    groups = chunks.mapInArrow(lambda it: _matrices(it, model_path), f"{_KEY}, matrix binary").groupBy("doc_id", "text_key", F.floor(F.col("chunk") / group).cast("int").alias("group")).agg(part)
    over = groups.mapInArrow(_combined, f"{_KEY}, matrix binary").groupBy("doc_id", "text_key").agg(part)
    # a text begins and ends in one state
    around = over.select("*", F.lit(0).alias("entry"), F.lit(0).alias("exit")).mapInArrow(_placed, across)
    within = groups.alias("g").join(around.withColumnRenamed("chunk", "group").alias("a"), _met("g", "a", "group")).select("g.doc_id", "g.text_key", "parts", "entry", "exit").mapInArrow(_placed, across)
    met = chunks.alias("c").join(within.alias("w"), _met("c", "w", "chunk")).select("c.*", "w.entry", "w.exit")
    traced = met.mapInArrow(lambda it: _traced(it, model_path), f"{_KEY}, blob binary")
    # of a repeated row's chunks, one set is joined, and given to each of the rows
    whole = traced.groupBy("doc_id", "text_key", "chunk").agg(F.first("blob").alias("blob"), F.count("*").alias("copies")).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("chunk", "blob"))).alias("parts"), F.max("copies").cast("int").alias("copies"))
    return short.unionByName(whole.mapInArrow(lambda it: _assembled(it, model_path, finish), schema))


def _with_text(batch: pa.RecordBatch, m: PieceModel) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, 256):
        part = batch.slice(a, 256)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([m.decode(x) for x in part.column("ids").to_pylist()], pa.string())], [*part.schema.names, "text"])


@released
def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for batch in batches:
        yield from _with_text(batch, m)


def decoded(encodings: DataFrame, model_path: str) -> DataFrame:
    """encodings (doc_id, text_key, ids) with the text of the ids; no ids give an empty text."""
    return encodings.select("doc_id", "text_key", "ids").mapInArrow(lambda it: _decoded(it, model_path), _ENCODED + ", text string")


def round_trip(documents: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_key, ids of every row, and the text that its ids decode to."""
    return encoded(documents, model_path, chunk, finish=_with_text, schema=_ENCODED + ", text string")


def _digest(batch: pa.RecordBatch, m: PieceModel) -> Iterator[pa.RecordBatch]:
    """n_pieces, ids_crc32 and the decoded text."""
    for k in range(0, batch.num_rows, 512):
        part = batch.slice(k, 512)
        column = part.column("ids")
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        ids = column.flatten().to_numpy()
        raw = memoryview(ids.astype("<u4").tobytes())
        ranges = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in ranges]
        text = [m.decode(ids[a:b].tolist()) for a, b in ranges]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), pa.array(text)], ["doc_id", "text_key", "n_pieces", "ids_crc32", "text"])


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's pieces, and whether they decode to it: a mark in a text decodes to a space."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = encoded(table(spark, sf_dir, "documents"), path, finish=_digest, schema="doc_id long, text_key long, n_pieces long, ids_crc32 long, text string")
    return rows.select("doc_id", "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), (F.xxhash64("text") == F.when(F.col("n_pieces") > 0, F.col("text_key")).otherwise(F.xxhash64(F.lit("")))).alias("round_trip"))
