"""Quality rules with an isolation forest on their statistics.

The rule statistics of every whole text come from one pass in tasks. A bounded
sample of them grows the trees; their path lengths score all documents, and the
threshold is calibrated on every labelled row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.tables import checkpointed, keyed, table
from trajlab.llm.text import CODE_POINT, NOT_SPACE, Words, range_hashes, released, slices

#: trees, and documents that each is grown on: TREES * SAMPLE rows at most reach the driver
TREES, SAMPLE = 100, 64
#: share of labelled good rows that the threshold must keep, and cells of the score histogram
KEEP_GOOD, CELLS = 0.998, 10_000
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
_SCHEMA = "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in COUNTS)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items with a row and a key: which share both with another, and which with an earlier one."""
    order = np.lexsort((np.arange(len(key)), key, row))
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    shared, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    shared[order], later[order] = same[1:] | same[:-1], same[:-1]
    return shared, later


def counted(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    w = Words(texts, NOT_SPACE)
    data, offsets, n = w.data, w.offsets, len(w.starts)
    row = w.row_of_word()
    # 3-word windows found twice or more, and the words they cover
    h = w.hashes()
    repeat = np.zeros(n, bool)
    if n > 2:
        three = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        inside = row[:-2] == row[2:]
        first = np.flatnonzero(inside)
        shared, _ = _repeated(row[first], three[first])
        for k in range(3):
            repeat[first[shared] + k] = True
    # lines: a piece between line feeds, with a word
    feed = np.flatnonzero(data == 0x0A)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts = np.sort(np.concatenate([offsets[:-1][full], feed + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], feed]))
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    if len(starts):
        worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        starts, ends = starts[worded], ends[worded]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    _, later = _repeated(line_row, range_hashes(data, starts, ends)) if len(starts) else (None, np.empty(0, bool))
    in_word = NOT_SPACE[data]
    rows = len(texts)
    return [w.counts, _sums(in_word & CODE_POINT[data], offsets), _sums(_SYMBOL[data], offsets), np.bincount(line_row[later], minlength=rows), np.bincount(row[repeat], minlength=rows), np.bincount(line_row, minlength=rows), _sums(_UPPER[data], offsets)]


@released
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        columns = counted(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(c.astype(np.int64)) for c in columns)], ["doc_id", "text_key", *COUNTS])


def statistics(documents: DataFrame) -> DataFrame:
    """The rule statistics of each row: words, code points in words, characters of `[#*$%&|<>]`, lines
    with a word that equal an earlier line, words in 3-word windows found twice or more, lines with a
    word and capitals A-Z. A null text has none of them."""
    return keyed(documents).mapInArrow(_statistics, _SCHEMA)


def features() -> list[Column]:
    """Statistics as shares, so that a long text is no anomaly for being long: word length, symbols a
    word and a character, capitals a character. Repetition is left to the base rules, as short clean
    texts repeat a phrase more often than junk does."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [(F.col("word_chars") / words).alias("f0"), (F.col("n_symbols") / words).alias("f1"), (F.col("n_symbols") / chars).alias("f2"), (F.col("n_upper") / chars).alias("f3")]


N_FEATURES = 4


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


class Forest:
    """Isolation trees as flat arrays: a node has a feature and a cut, its left child, or at a leaf
    (feature -1) the path length that ends there."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, size: int = SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        self.trees = [self._grow(sample[rng.choice(len(sample), self.size, replace=False)], rng) for _ in range(trees)] if len(sample) > 1 else []

    @staticmethod
    def average(n: np.ndarray | float) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        most = int(np.ceil(np.log2(max(len(x), 2))))
        feature, value, left, todo = [0], [0.0], [0], [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            wide = np.flatnonzero(high > low)
            if depth >= most or len(rows) < 2 or not len(wide):
                feature[node], value[node] = -1, depth + float(self.average(len(rows)))
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(low[f], high[f])
            feature[node], value[node], left[node] = f, cut, len(feature)
            below = x[rows, f] <= cut
            for side in (rows[below], rows[~below]):
                todo.append((len(feature), side, depth + 1))
                feature.append(0)
                value.append(0.0)
                left.append(0)
        return np.array(feature), np.array(value), np.array(left)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalies, 0.5 and below for the usual."""
        if not self.trees:
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for feature, value, left in self.trees:
            node = np.zeros(len(x), np.int64)
            while len(open_ := np.flatnonzero(feature[node] >= 0)):
                at = node[open_]
                node[open_] = left[at] + (x[open_, feature[at]] > value[at])
            total += value[node]
        return 2.0 ** (-total / len(self.trees) / float(self.average(self.size)))


@released
def _scored(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    names = [f"f{i}" for i in range(N_FEATURES)]
    for batch in batches:
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1) if batch.num_rows else np.empty((0, N_FEATURES))
        yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in names), pa.array(forest.score(x))], [*(n for n in batch.schema.names if n not in names), "anomaly"])


def calibrated(scored: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """The score above which a document goes, from all labelled rows that pass the base rules: among
    the thresholds that keep the share keep_good of the good ones, the one that rejects most of the bad
    (the highest such). Where nothing is labelled good, or no bad row is told apart, no score exceeds it.
    A doc_id that is labelled twice counts twice; a null quality doesn't count."""
    marked = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").alias("_quality"))
    cell = F.floor(F.col("anomaly") * CELLS).cast("int")
    rows = scored.where(~base_failed()).join(marked, "doc_id").groupBy(cell.alias("cell")).agg(F.sum((F.col("_quality") > 0).cast("long")).alias("good"), F.sum((F.col("_quality") <= 0).cast("long")).alias("bad")).collect()
    good, bad = np.zeros(CELLS + 2, np.int64), np.zeros(CELLS + 2, np.int64)
    for r in rows:
        good[r.cell], bad[r.cell] = r.good, r.bad
    if not good.sum():
        return 1.0
    kept = np.cumsum(good) / good.sum()
    caught = bad.sum() - np.cumsum(bad)
    lost = good.sum() - np.cumsum(good)
    fit = np.flatnonzero((kept >= keep_good) & (caught > lost))
    return float((fit[np.argmax(caught[fit])] + 1) / CELLS) if len(fit) else 1.0


def fitted(stats: DataFrame, labels: DataFrame, trees: int, sample: int, keep_good: float) -> tuple[DataFrame, Forest, float]:
    """stats with their scores; the forest and the threshold."""
    spark = stats.sparkSession
    usual = stats.where(~base_failed()).select(F.xxhash64("doc_id", "text_key").alias("h"), *features())
    # hashes below a share that leaves four times the rows needed, then the least of them: tasks send few more
    need = trees * sample
    share = min(1.0, 4 * need / max(1, usual.count()))
    some = usual.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    drawn = some.orderBy(F.pmod("h", F.lit(1 << 30)), "h", *[f"f{i}" for i in range(N_FEATURES)]).limit(need).select([f"f{i}" for i in range(N_FEATURES)]).collect()
    forest = Forest(np.array([tuple(r) for r in drawn], float).reshape(-1, N_FEATURES), trees, sample)
    sent = spark.sparkContext.broadcast(forest)
    scored = stats.select("doc_id", "text_key", *COUNTS, *features()).mapInArrow(lambda it: _scored(it, sent.value), f"{_SCHEMA}, anomaly double")
    return scored, forest, calibrated(scored, labels, keep_good)


def assessed(documents: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE, keep_good: float = KEEP_GOOD) -> DataFrame:
    """doc_id, text_key, the statistics, anomaly (score), base_failed and kept, one row for each input row.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike. An
    empty table, or one with a single row, grows no tree: every score is 0.5. Without labels the base
    rules alone decide. The forest is grown on at most trees * sample rows, those that pass the base
    rules with the smallest hashes of (doc_id, text).
    """
    scored, _, threshold = fitted(checkpointed(statistics(documents)), labels, trees, sample, keep_good)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


@released
def _passing(batches: Iterator[pa.RecordBatch], forest: Forest, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        n_words, word_chars, n_symbols, _, n_repeat, _, n_upper = counted(batch.column("text"))
        words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
        x = np.stack([word_chars / words, n_symbols / words, n_symbols / chars, n_upper / chars], 1)
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
        yield batch.filter(pa.array(~failed & (forest.score(x) < threshold)))


def passing(documents: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE, keep_good: float = KEEP_GOOD) -> DataFrame:
    """The rows of documents that the rules keep, with their columns. The statistics are taken a second
    time where the rows are, which costs less than bringing decisions and texts together."""
    _, forest, threshold = fitted(checkpointed(statistics(documents)), labels, trees, sample, keep_good)
    sent = documents.sparkSession.sparkContext.broadcast(forest)
    return documents.mapInArrow(lambda it: _passing(it, sent.value, threshold), documents.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule statistics, whether the base rules fail it, and the verdict."""
    found = assessed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
