"""Removal of repeated word sequences by relative Lempel-Ziv parsing.

Where windows may repeat (see `repeats`), the segments of a block are the
indexed reference: a suffix array of their words. Equal windows have equal
anchors, so no other block can hold a window of a segment. Each segment is
factored greedily against its block, its own position excepted: a factor is the
longest sequence from the cursor that starts elsewhere too, and the next one
begins behind it. A factor of a window or more is a duplicate span. A window may
also straddle factors: where it holds none with the word behind it, which
together start nowhere else, it is looked up by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trajlab.llm.repeats import HOT, Windows, merged, repeated, with_spans
from trajlab.llm.suffixes import common, suffix_array
from trajlab.llm.tables import table
from trajlab.llm.text import released, unpacked

WINDOW, GRAM = 35, 6


class ReferenceBlock:
    """Word sequences with the order of all their suffixes."""

    def __init__(self, sequences: list[np.ndarray], many: np.ndarray | None = None):
        """many: which sequences have copies beyond the block; each of them is indexed a second time, behind all
        others, and not parsed there."""
        own = len(sequences)
        sequences = sequences + [sequences[i] for i in ([] if many is None else np.flatnonzero(many))]
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.starts, self.sizes = (np.cumsum(sizes + 1) - sizes - 1)[:own], sizes[:own]
        self.most = int(sizes.max(initial=1))
        words = np.concatenate(sequences) if sequences else np.empty(0, np.uint64)
        inside = np.ones(int((sizes + 1).sum()), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        self.symbols = np.zeros(len(inside), np.int64)
        self.symbols[inside] = np.unique(words, return_inverse=True)[1] + 1
        self.array = suffix_array(self.symbols, self.most)
        self.place = np.zeros(len(inside), np.int64)
        self.place[self.array] = np.arange(len(self.array))

    def factor(self, at: np.ndarray) -> np.ndarray:
        """Length of the longest sequence from each position that starts at another position too: the
        better of the two neighbours in the order of suffixes."""
        j, last = self.place[at], len(self.array) - 1
        before = np.where(j > 0, common(self.symbols, at, self.array[np.maximum(j - 1, 0)], self.most), 0)
        behind = np.where(j < last, common(self.symbols, at, self.array[np.minimum(j + 1, last)], self.most), 0)
        return np.maximum(before, behind)


def parsed(block: ReferenceBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The factors of all sequences, parsed side by side: sequence, start and length. A word that starts
    nowhere else is a factor of length 0, and is passed."""
    cursor, row = np.zeros(len(block.sizes), np.int64), np.flatnonzero(block.sizes > 0)
    found = [(np.empty(0, np.int64),) * 3]
    while len(row):
        at = cursor[row]
        length = block.factor(block.starts[row] + at)
        found.append((row, at, length))
        cursor[row] = at + np.maximum(length, 1)
        row = row[cursor[row] < block.sizes[row]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def matcher(sequences: list[np.ndarray], n: np.ndarray, many: np.ndarray | None = None, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose windows lie in a long factor, or straddle factors and start elsewhere too."""
    block = ReferenceBlock(sequences, many)
    row, at, length = parsed(block)
    first = np.cumsum(n) - n  # all sequences' starts of windows in a row
    total = int(n.sum())

    def covered(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which starts lie in ranges of their sequences."""
        a, b = np.clip(a, 0, n[row]), np.clip(b, 0, n[row])
        steps = np.zeros(total + 1, np.int64)
        np.add.at(steps, (first[row] + a)[a < b], 1)
        np.add.at(steps, (first[row] + b)[a < b], -1)
        return np.cumsum(steps[:-1]) > 0

    long = length >= window
    inside = covered(row[long], at[long], (at + length - window + 1)[long])
    # a factor and the word behind it start nowhere else; at the end of a sequence there is no such word
    whole = at + length < block.sizes[row]
    apart = covered(row[whole], (at + length + 1 - window)[whole], (at + 1)[whole])
    unsure = np.flatnonzero(~inside & ~apart)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(total) - first[owner]
    inside[unsure] = block.factor(block.starts[owner[unsure]] + place[unsure]) >= window
    edge = np.flatnonzero(inside & ((place == 0) | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & ((place + 1 == n[owner]) | ~np.concatenate([inside[1:], [False]])))
    return owner[edge], place[edge], place[last] + 1


def repeated_words(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, text_key and the spans of words covered by a window of words that also starts elsewhere."""
    return repeated(documents, Windows("words", window, gram), lambda s, n, many: matcher(s, n, many, window), hot)


@released
def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        spans = batch.column("spans")
        for r, text in enumerate(unpacked(batch.column("blob"))):
            words = text.split()  # of bytes: at the same six characters as NOT_SPACE
            a, b = merged(spans[r])
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(words)]
            kept = b" ".join(w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y])
            rows.append((len(words), int((b - a).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup_words(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept: the remaining words of each text, joined by a
    space. A null text has no words; repeated rows of a window or more lose all; an empty table gives no rows."""
    spans = repeated_words(documents, window, gram, hot)
    return with_spans(documents, spans).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its 35-word windows that start anywhere else too, as digest and sizes."""
    return dedup_words(table(spark, sf_dir, "documents")).drop("kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5_number(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
x AS (SELECT doc_id, k, w[k + 1] AS word FROM (SELECT doc_id, w, unnest(range(len(w))) AS k FROM d)),
s AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.k) AS kept, count(*) AS n FROM x LEFT JOIN p ON x.doc_id = p.doc_id AND x.k = p.k WHERE p.k IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
