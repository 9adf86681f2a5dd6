"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a whole text are hashed words (one bucket each, damped counts of unit
length), shares and sizes of its structure, and its n_chars, the last two each spread
over a few knots. The model adds a weight for each feature and, for each pair of
features, the product of their short vectors, which by

    sum over pairs of <v_i, v_j> x_i x_j = 1/2 sum over factors of (sum v x)^2 - sum (v x)^2

takes time linear in the features that a text has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.quality import counted
from trajlab.llm.tables import quoted, table
from trajlab.llm.text import NOT_SPACE, Words, released, slices, string_view

#: labelled documents that the model is fitted on at most; their features reach the driver
SAMPLE = 8_000
#: buckets of words, knots of a statistic, numbers of a feature's vector
BUCKETS, KNOTS, FACTORS = 4096, 9, 8
EPOCHS, BATCH, RATE = 12, 128, 0.08
#: pull of word weights, of other weights, and of vectors towards zero
DECAY_WORDS, DECAY, DECAY_VECTORS = 1e-3, 1e-5, 1e-4
#: documents of this score or more are predicted good
GOOD = 0.3
STATISTICS = ["word_length", "words", "lines", "symbols_word", "symbols_char", "capitals", "exclamations", "stops", "digits", "repeats", "echoes", "variety", "same_lines", "n_chars", "chars_known"]
WIDTH = BUCKETS + KNOTS * len(STATISTICS)


def _marks(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(characters, np.uint8)] = True
    return out


_EXCLAMATION, _STOP, _DIGIT = _marks(b"!"), _marks(b".,;:?"), _marks(b"0123456789")


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Sparse:
    """Rows of (feature, value); row i has the entries start[i] to start[i + 1], one at least."""

    def __init__(self, start: np.ndarray, feature: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.value = start, feature, value

    def __len__(self) -> int:
        return len(self.start) - 1

    def rows(self, which: np.ndarray) -> Sparse:
        sizes = np.diff(self.start)[which]
        start = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.start[:-1][which] - start[:-1], sizes) + np.arange(start[-1])
        return Sparse(start, self.feature[at], self.value[at])

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each row the sum of what its entries have."""
        return np.add.reduceat(x, self.start[:-1]) if len(self) else x[:0]


def features(texts: pa.Array, n_chars: np.ndarray) -> Sparse:
    """The features of each text; a null text counts as empty, n_chars is NaN where unknown."""
    w = Words(texts, NOT_SPACE)
    data, offsets = string_view(texts)
    row, h, rows = w.row_of_word(), w.hashes(), len(texts)
    key, times = np.unique(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    at, bucket, value = key // BUCKETS, key % BUCKETS, 1 + np.log(times)
    value /= np.sqrt(np.bincount(at, value * value, rows))[at]
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])

    n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, n_upper = (x.astype(float) for x in counted(texts))
    words, chars, known = np.maximum(n_words, 1), np.maximum(word_chars, 1), ~np.isnan(n_chars)
    log = lambda x, most: np.log2(1 + x) / most
    told = np.stack([
        word_chars / words / 16, log(n_words, 16), log(n_lines, 12), n_symbols / words / 3, n_symbols / chars, n_upper / chars, _counts(_EXCLAMATION[data], offsets) / words / 2, _counts(_STOP[data], offsets) / words / 2,
        _counts(_DIGIT[data], offsets) / chars, n_repeat / words, np.bincount(row[echo], minlength=rows) / words, np.bincount(at, minlength=rows) / words, n_dup / np.maximum(n_lines, 1), log(np.where(known, np.maximum(n_chars, 0), 0), 24), known.astype(float),
    ], 1)
    place = np.clip(told, 0, 1) * (KNOTS - 1)
    low = np.minimum(place.astype(np.int64), KNOTS - 2)
    knot = BUCKETS + KNOTS * np.arange(len(STATISTICS)) + low
    each = np.repeat(np.arange(rows), 2 * len(STATISTICS))
    rest = np.stack([knot, knot + 1], 2).reshape(rows, -1), np.stack([1 - (place - low), place - low], 2).reshape(rows, -1)
    order = np.argsort(np.concatenate([at, each]), kind="stable")
    sizes = np.bincount(at, minlength=rows) + 2 * len(STATISTICS)
    return Sparse(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([bucket, rest[0].ravel()])[order], np.concatenate([value, rest[1].ravel()])[order])


class Machine:
    """bias, a weight for each feature and a vector of FACTORS numbers for each."""

    def __init__(self, width: int = WIDTH, factors: int = FACTORS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bias, self.weight, self.vector = 0.0, np.zeros(width), rng.normal(0, 0.05, (width, factors))

    def _parts(self, x: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logit of each row; each entry's vector times its value, and their sum over each row."""
        vx = self.vector[x.feature] * x.value[:, None]
        total = x.sums(vx)
        pairs = 0.5 * (total * total - x.sums(vx * vx)).sum(1)
        return self.bias + x.sums(self.weight[x.feature] * x.value) + pairs, vx, total

    def score(self, x: Sparse) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self._parts(x)[0], -40, 40))) if len(x) else np.empty(0)

    def fit(self, x: Sparse, label: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> Machine:
        """Logistic loss, by adaptive gradient steps over batches in a fixed random order. The bias starts at the
        labels' log odds; without rows every score is one half."""
        if not len(x):
            self.vector[:] = 0
            return self
        rng, width = np.random.default_rng(seed), len(self.weight)
        mean = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        decay = np.full(width, DECAY)
        decay[:BUCKETS] = DECAY_WORDS
        seen_bias, seen_weight, seen_vector = 1e-6, np.full(width, 1e-6), np.full(self.vector.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                part = x.rows(rows)
                logit, vx, total = self._parts(part)
                off = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label[rows]) / len(rows)
                sizes = np.diff(part.start)
                entry = np.repeat(off, sizes) * part.value
                g_weight = np.bincount(part.feature, entry, width) + decay * self.weight
                pull = entry[:, None] * (np.repeat(total, sizes, 0) - vx)
                g_vector = np.stack([np.bincount(part.feature, p, width) for p in pull.T], 1) + DECAY_VECTORS * self.vector
                seen_bias += off.sum() ** 2
                seen_weight += g_weight**2
                seen_vector += g_vector**2
                self.bias -= rate * off.sum() / np.sqrt(seen_bias)
                self.weight -= rate * g_weight / np.sqrt(seen_weight)
                self.vector -= rate * g_vector / np.sqrt(seen_vector)
        return self


def held_out(doc_id: Column) -> Column:
    """Whether 5 divides the crc32 of doc_id as text; false for a null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _chars(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)


@released
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = features(batch.column("text"), _chars(batch))
        cut = [(x.feature[a:b].astype("<u2").tobytes(), x.value[a:b].astype("<f4").tobytes()) for a, b in zip(x.start, x.start[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([f for f, _ in cut], pa.binary()), pa.array([v for _, v in cut], pa.binary())], ["doc_id", "label", "feature", "value"])


def fitted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Machine:
    """The model of at most `sample` labelled documents that aren't held out, those with the least hashes of
    doc_id. A null label or doc_id doesn't count; a doc_id labelled twice has the mean of its labels, and of
    documents that share it the one with the least hash of its text is taken."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg((F.col("quality") > 0).cast("double")).alias("label"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # below a share of hashes that leaves four times the rows needed, then the least: tasks send few more
    share = min(1.0, 4 * sample / max(1, marked.count()))
    drawn = marked.where(h <= int(share * (1 << 30))).orderBy(h, "doc_id").limit(sample)
    texts = documents.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(drawn), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "n_chars")).alias("d")).select("doc_id", "label", "d.text", "d.n_chars")
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = sorted(one.mapInArrow(_featured, f"doc_id {kind}, label double, feature binary, value binary").collect(), key=lambda r: r.doc_id)
    start = np.concatenate([[0], np.cumsum([len(r.value) // 4 for r in rows])]).astype(np.int64)
    x = Sparse(start, np.frombuffer(b"".join(r.feature for r in rows), "<u2").astype(np.int64), np.frombuffer(b"".join(r.value for r in rows), "<f4").astype(float))
    return Machine().fit(x, np.array([r.label for r in rows]), epochs)


@released
def _scored(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        score = machine.score(features(batch.column("text"), _chars(batch)))
        names = [n for n in batch.schema.names if n not in ("text", "n_chars")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], [*names, "score"])


def scored(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, held_out, score), a row for each row of documents.

    A null text is scored as an empty one, a null n_chars by a feature of its own; repeated rows score alike;
    other columns, lang and source among them, play no part. Without labels every score is one half; an empty
    table gives no row.
    """
    machine = documents.sparkSession.sparkContext.broadcast(fitted(documents, labels, sample, epochs))
    rows = documents.select(quoted("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", F.col("n_chars").cast("double").alias("n_chars"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _scored(it, machine.value), f"doc_id {kind}, held_out boolean, score double")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; a score equal to the threshold is predicted good."""
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
