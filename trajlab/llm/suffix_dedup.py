"""Removal of long repeated byte strings with run-length indexes.

Where windows may repeat (see `repeats`), the segments of a block are indexed:
their Burrows-Wheeler transform is run-compressed, and for the ends of its runs
the text position and the match length with the neighbouring suffix are kept.
Those samples give the matching statistics of every position as the segments
stream by: between two sampled positions the longest match elsewhere only
loses a byte a step. Positions with a match of a whole window are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trajlab.llm.repeats import HOT, Windows, merged, repeated, with_spans
from trajlab.llm.suffixes import common_bytes, suffix_array
from trajlab.llm.tables import table
from trajlab.llm.text import released, unpacked

WINDOW, GRAM = 200, 24


class RunLengthIndex:
    """Strings of bytes as the runs of their transform, with samples at the ends of runs.

    runs, run_lengths: the run-compressed transform (0 stands for a string's start, byte + 1 for a byte).
    heads, head_match: text position of each run's first suffix, and its common prefix with the suffix before.
    tails, tail_match: the same of its last suffix and the suffix behind.
    """

    def __init__(self, strings: list[np.ndarray], many: np.ndarray | None = None):
        """many: which strings have copies beyond the index."""
        sizes = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.many = np.zeros(len(strings), bool) if many is None else many
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.size = int((sizes + 1).sum())
        symbols, data = np.zeros(self.size, np.int64), np.zeros(self.size, np.uint8)
        inside = np.ones(self.size, bool)
        inside[self.starts + sizes] = False
        data[inside] = np.concatenate(strings) if strings else np.empty(0, np.uint8)
        symbols[inside] = data[inside].astype(np.int64) + 1
        ends_at = np.repeat(self.starts + sizes, sizes + 1)
        array = suffix_array(symbols, int(sizes.max(initial=1)))
        before = np.where(array > 0, symbols[array - 1], 0)
        change = np.ones(len(array) + 1, bool)
        change[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
        head, tail = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])
        self.runs, self.run_lengths = before[head], tail - head + 1
        self.heads, self.tails = array[head], array[tail]
        self.head_match, self.tail_match = np.zeros(len(head), np.int64), np.zeros(len(tail), np.int64)
        if len(head) > 1:
            # the last suffix of a run and the first of the next are neighbours: one comparison serves both
            self.head_match[1:] = self.tail_match[:-1] = common_bytes(data, ends_at, self.heads[1:], self.tails[:-1])

    def statistics(self) -> np.ndarray:
        """For every position, terminators included, the longest match that starts anywhere else; in a string
        with copies that is the rest of the string."""
        out = np.zeros(self.size, np.int64)
        at = np.arange(self.size)
        copied = np.repeat(self.many, self.ends - self.starts + 1)
        out[copied] = (np.repeat(self.ends, self.ends - self.starts + 1) - at)[copied]
        for sampled, match in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            last = np.zeros(self.size, np.int64)
            last[sampled] = sampled
            last = np.maximum.accumulate(last)
            length = np.zeros(self.size, np.int64)
            length[sampled] = match
            np.maximum(out, length[last] - (at - last), out=out)
        return out


def matcher(strings: list[np.ndarray], n: np.ndarray, many: np.ndarray | None = None, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose matching statistic reaches the window."""
    index = RunLengthIndex(strings, many)
    marked = index.statistics() >= window
    edge = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(index.starts, a, "right") - 1
    return row, a - index.starts[row], b - index.starts[row]


def repeated_bytes(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, text_key and the spans of bytes covered by a window-byte string that also starts elsewhere."""
    return repeated(documents, Windows("bytes", window, gram), lambda s, n, many: matcher(s, n, many, window), hot)


@released
def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        spans = batch.column("spans")
        for r, text in enumerate(unpacked(batch.column("blob"))):
            a, b = merged(spans[r])
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(text), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup_bytes(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept: each text without its repeated bytes,
    as bytes, since a span may end within a character. A null text is an empty one; repeated rows of a
    window or more lose all; an empty table gives no rows."""
    spans = repeated_bytes(documents, window, gram, hot)
    return with_spans(documents, spans).mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its 200-byte strings that start anywhere else too, as digest and sizes."""
    return dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(length(x) // 2 - 199)) AS i, x FROM d WHERE length(x) >= 400),
g AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER w > 200, true)::INT AS opens FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e) GROUP BY doc_id, k),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
k AS (SELECT doc_id, x, n_removed, n_spans, CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(len(a) + 1), lambda j: substr(x, 1 + 2 * CASE WHEN j = 0 THEN 0 ELSE b[j] END, 2 * (CASE WHEN j = len(a) THEN length(x) // 2 ELSE a[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE b[j] END))), '') END AS kept FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""
