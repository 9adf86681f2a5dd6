"""Language-model scores with deleted interpolation.

N-gram estimates of all orders up to the model's and a uniform one are mixed with
weights that depend on how often the longest context seen was seen. Part of the training documents is deleted from the
counts and the weights are learned on it by expectation-maximisation; the final
counts are those of all training documents.

Counts come from the whole corpus without a row per token: documents are kept
in blocks, a block asks for the counts of its distinct n-grams by sending their
sorted hashes, with its own counts, to hash ranges; a range sums what all
blocks sent and answers each. What is asked, summed and answered grows with the
corpus and is spread over all tasks; a frequent n-gram is one entry a block. A
block sends at most a piece to each range, and never more pieces than n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.tables import Scratch, parts_for, table
from trajlab.llm.text import NOT_SPACE, Words, mix, released, slices, string_view

#: remainders of crc32(doc_id) mod FOLDS: test documents, and training documents deleted to learn the weights
FOLDS, HELD_OUT, DELETED = 7, 2, 3
BLOCK_BYTES = 6 << 20
#: words of the longest n-gram
ORDER = 2
#: distinct n-grams that a hash range should have at most, roughly
RANGE_KEYS = 1_500_000
#: contexts are told apart by the octave of their frequency
BUCKETS = 40
#: steps of an octave in which the weights' training sees probabilities, and rounds of training
STEPS, ROUNDS = 8, 60

END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)
#: the lowest bits of a key tell its order
_ORDERS = np.uint64(7)

_BLOCK = "deleted boolean, n_bytes long, ids array<long>, folds array<int>, lengths array<long>, blob binary"


@released
def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Documents in blocks of about `most` bytes; those of the deleted part in blocks of their own."""
    squeeze = zstandard.ZstdCompressor(level=3)
    held: dict[bool, list[tuple]] = {False: [], True: []}
    size = {False: 0, True: 0}

    def block(part: bool) -> pa.RecordBatch:
        ids, folds, texts = zip(*held[part], strict=True)
        held[part], n, size[part] = [], size[part], 0
        return pa.RecordBatch.from_pylist([{"deleted": part, "n_bytes": n, "ids": ids, "folds": folds, "lengths": [len(x) for x in texts], "blob": squeeze.compress(b"".join(texts))}], schema=pa.schema([("deleted", pa.bool_()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("folds", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64())), ("blob", pa.binary())]))

    for batch in slices(batches, "text"):
        data, offsets = string_view(batch.column("text"))
        for i, (doc, fold) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist(), strict=True)):
            part = fold == DELETED
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            if held[part] and size[part] + len(text) > most:
                yield block(part)
            held[part].append((doc, fold, text))
            size[part] += len(text)
    for part in (False, True):
        if held[part]:
            yield block(part)


class BlockGrams:
    """The keys of the n-grams that end at each token of a block, for every order from 1 on, and those of
    the contexts of orders from 2 on. A text is as if it began with any number of begin tokens."""

    def __init__(self, lengths: list[int], blob: bytes, order: int = ORDER):
        data = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        w = Words(column, NOT_SPACE, lower=True)
        self.counts = w.counts + 1
        ends = np.cumsum(self.counts)
        token = np.empty(int(ends[-1]), np.uint64)
        last = np.zeros(len(token), bool)
        last[ends - 1] = True
        token[last], token[~last] = END, w.hashes()
        self.row = np.repeat(np.arange(len(lengths)), self.counts)
        first = ends - self.counts
        raw, self.grams, self.contexts = token, [(mix(token) & ~_ORDERS)], []
        # a text begins as often as it ends
        begun, held = (mix(np.array([END])) & ~_ORDERS)[0], np.full(len(lengths), BEGIN)
        for k in range(1, order):
            # the hash of the k tokens before each one; before a text stand begin tokens
            before = np.concatenate([[np.uint64(0)], raw[:-1]])
            before[first] = held
            context = np.concatenate([[np.uint64(0)], self.grams[-1][:-1]])
            context[first] = begun
            self.contexts.append(context)
            raw = before * np.uint64(0x9E3779B97F4A7C15) + token
            held = held * np.uint64(0x9E3779B97F4A7C15) + BEGIN
            self.grams.append((mix(raw) & ~_ORDERS) | np.uint64(k))


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, bytes of one weight together, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


@released
def _asked(batches: Iterator[pa.RecordBatch], bits: int, order: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("deleted", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            g = BlockGrams(row["lengths"], row["blob"], order)
            counted = (np.array(row["folds"]) != HELD_OUT)[g.row]
            keys, at = np.unique(np.concatenate(g.grams), return_inverse=True)
            counts = np.bincount(at[np.tile(counted, order)], minlength=len(keys))
            edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
            edges = [0, *edges.tolist(), len(keys)]
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if a < b:
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([row["block"]]), pa.array([row["deleted"]]), pa.array([pack_keys(keys[a:b])], pa.binary()), pa.array([pack_counts(counts[a:b])], pa.binary())], schema=schema)


@released
def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come in order of range; all blocks' pieces of a range are summed and answered together.
    Block -1 gets the range's own sums: tokens and distinct tokens of the kept part, and of both."""
    schema = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), ("range", pa.int64()), ("kept", pa.binary()), ("all", pa.binary()), ("sums", pa.list_(pa.int64()))])

    def answer(k: int, pieces: list[tuple[int, bool, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        keys = [unpack_keys(p[2]) for p in pieces]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([unpack_counts(p[3]) for p in pieces])
        kept_part = np.repeat([not p[1] for p in pieces], [len(x) for x in keys])
        total = np.zeros(len(distinct), np.int64)
        kept = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, n)
        np.add.at(kept, at[kept_part], n[kept_part])
        uni = (distinct & _ORDERS) == 0
        sums = [int(kept[uni].sum()), int((kept[uni] > 0).sum()), int(total[uni].sum()), int((total[uni] > 0).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([False]), pa.array([k]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([sums], pa.list_(pa.int64()))], schema=schema)
        start = 0
        for (block, deleted, _, _), x in zip(pieces, keys, strict=True):
            own = at[start : start + len(x)]
            start += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([deleted]), pa.array([k]), pa.array([pack_counts(kept[own])], pa.binary()), pa.array([pack_counts(total[own])], pa.binary()), pa.array([None], pa.list_(pa.int64()))], schema=schema)

    current, pieces = None, []
    for batch in batches:
        for k, block, deleted, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("range", "block", "deleted", "keys", "counts")), strict=True):
            if k != current and pieces:
                yield from answer(current, pieces)
                pieces = []
            current = k
            pieces.append((block, deleted, keys, counts))
    if pieces:
        yield from answer(current, pieces)


def _bucket(contexts: np.ndarray) -> np.ndarray:
    """From the counts of each token's contexts, a row an order: of the longest context seen one more than
    the octave of its count, BUCKETS more for each order below the longest; 0 where none was seen."""
    out = np.zeros(contexts.shape[1], np.int64)
    for k, c in enumerate(contexts):
        octave = np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, BUCKETS - 1)
        out = np.where(c > 0, octave + BUCKETS * (len(contexts) - 1 - k), out)
    return out


def _counts_of(row: dict, which: str, order: int) -> tuple[BlockGrams, np.ndarray, np.ndarray]:
    """A block with the counts of its tokens' n-grams (a row an order) and of their contexts."""
    g = BlockGrams(row["lengths"], row["blob"], order)
    n = len(g.row)
    _, at = np.unique(np.concatenate([*g.grams, *g.contexts]), return_inverse=True)
    # every context is an n-gram of the block too, so the distinct keys are those that were asked
    answers = np.concatenate([unpack_counts(x[which]) for x in sorted(row["answers"], key=lambda x: x["range"])])
    c = answers[at].reshape(-1, n)
    return g, c[:order], c[order:]


def _estimates(grams: np.ndarray, contexts: np.ndarray, tokens: int) -> list[np.ndarray]:
    """Maximum-likelihood estimates, the longest n-grams first."""
    return [*(g / np.maximum(c, 1) for g, c in zip(grams[:0:-1], contexts[::-1], strict=True)), grams[0] / max(tokens, 1)]


#: longest n-gram: a cell has ten bits for each order beside the bucket
MOST_ORDER = 5


def _steps(p: np.ndarray) -> np.ndarray:
    """Probabilities as whole steps of an octave below 1, from 1 on; 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-np.log2(np.where(p > 0, p, 1)) * STEPS), 1022).astype(np.int64) + 1, 0)


@released
def _histogram(batches: Iterator[pa.RecordBatch], tokens: int, order: int) -> Iterator[pa.RecordBatch]:
    """How many tokens of the deleted part have each (context bucket, probability by each order)."""
    for batch in batches:
        for row in batch.to_pylist():
            _, grams, contexts = _counts_of(row, "kept", order)
            cell = _bucket(contexts)
            for p in _estimates(grams, contexts, tokens):
                cell = (cell << 10) | _steps(p)
            cells, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])


def learned_weights(cells: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = ROUNDS, order: int = ORDER) -> np.ndarray:
    """Weights of (longest n-gram, .., unigram, uniform) for each bucket of context frequency, by
    expectation-maximisation on the deleted part's cells. A bucket without such tokens has the weights of
    the next lower one of its order; orders whose context was never seen have none."""
    size = order + 1
    weights = np.zeros((BUCKETS * max(order - 1, 1), size))
    p = np.stack([np.where(s > 0, 2.0 ** (-(s - 1) / STEPS), 0.0) for s in ((cells >> (10 * k)) & 1023 for k in range(order - 1, -1, -1))] + [np.full(len(cells), 1 / (vocabulary + 1))], 1) if len(cells) else np.empty((0, size))
    seen = None
    for b in range(len(weights)):
        # estimates without a context: all but unigram and uniform, or those longer than the context
        absent = order - 1 if b == 0 else b // BUCKETS
        if b % BUCKETS == 0:
            seen = None
        usable = np.arange(size) >= absent
        mine = (cells >> (10 * order)) == b
        if not mine.any():
            weights[b] = seen if b and seen is not None else usable / usable.sum() if b == 0 else usable * np.where(np.arange(size) == order, 0.2, 0.8 / (order - absent))
            continue
        w = usable / usable.sum()
        for _ in range(rounds):
            share = p[mine] * w
            share /= share.sum(1, keepdims=True)
            w = (share * n[mine, None]).sum(0) / n[mine].sum()
            w = np.maximum(w, np.where(usable, 1e-9, 0.0))  # no outcome is impossible
            w /= w.sum()
        weights[b] = w
        if b:
            seen = w
    return weights


@dataclass(frozen=True)
class Model:
    tokens: int
    vocabulary: int
    weights: np.ndarray
    order: int


@released
def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            g, grams, contexts = _counts_of(row, "all", model.order)
            uni = grams[0]
            rows = len(row["ids"])
            base = np.log10((uni + 1) / (model.tokens + model.vocabulary + 1))
            w = model.weights[_bucket(contexts)]
            p = sum(w[:, k] * x for k, x in enumerate(_estimates(grams, contexts, model.tokens))) + w[:, -1] / (model.vocabulary + 1)
            sums = [np.bincount(g.row, x, rows) for x in (uni > 0, base, np.log10(p))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(np.array(row["folds"]) == HELD_OUT), pa.array(g.counts, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(np.full(rows, model.tokens), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def scored(documents: DataFrame, block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, by a model of
    n-grams of up to `order` words (5 at most, as a cell of the weights' counts holds no more).

    A null or empty text is its end token alone. A null doc_id hashes as an empty string, so it trains.
    Repeated rows are documents of their own, counted each time. Without training documents every
    token is unknown and uniform. An empty table gives no rows. Equal texts (ties) have equal scores. The
    weights are learned on the counts of five of seven parts of the documents and used with those of six.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order is 1 to {MOST_ORDER}")
    with Scratch(documents.sparkSession) as scratch:
        return scratch.result(_model_scores(documents, block_bytes, order, scratch))


def _model_scores(documents: DataFrame, block_bytes: int, order: int, scratch: Scratch) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FOLDS
    blocks = scratch.stored(documents.select("doc_id", fold.cast("int").alias("fold"), "text").mapInArrow(lambda it: _blocks(it, block_bytes), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks", "uncompressed")
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    # an n-gram of each order a token, of about six bytes
    bits = max(0, int(np.ceil(np.log2(max(1, order * size / 6 / RANGE_KEYS)))))
    parts = min(1 << bits, parts_for(documents.sparkSession, order * size, 16 << 20))

    asked = blocks.select("block", "deleted", "folds", "lengths", "blob").mapInArrow(lambda it: _asked(it, bits, order), "range long, block long, deleted boolean, keys binary, counts binary")
    told = asked.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_answered, "block long, deleted boolean, range long, kept binary, all binary, sums array<long>")
    told = scratch.stored(told, "answers", "uncompressed")
    sums = told.where("block = -1").select(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(4)]).first()
    kept_tokens, kept_vocabulary, tokens, vocabulary = (x or 0 for x in sums)
    answers = told.where("block >= 0").groupBy("block")

    part = blocks.where("deleted").join(told.where("deleted").groupBy("block").agg(F.collect_list(F.struct("range", "kept")).alias("answers")), "block")
    cells = part.select("lengths", "blob", "answers").mapInArrow(lambda it: _histogram(it, kept_tokens, order), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learned_weights(np.array([r.cell for r in cells], np.int64), np.array([r.n for r in cells], np.int64), kept_vocabulary, order=order)

    model = Model(tokens, vocabulary, weights, order)
    full = blocks.join(answers.agg(F.collect_list(F.struct("range", "all")).alias("answers")), "block")
    return full.select("ids", "folds", "lengths", "blob", "answers").mapInArrow(lambda it: _scored(it, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, with a base model's beside it."""
    return scored(table(spark, sf_dir, "documents"))
