"""Benchmark decontamination with suffix arrays of the training side.

Each task sorts the word suffixes of a bounded shard of documents and binary
searches every window of the benchmark in it, so the documents are read once
and nothing of them is shuffled. From each place found the longest match is told
by a second search, of the place among the benchmark's own sorted suffixes.

The benchmark is the stated query set. One of at most a block's bytes is sent to
the tasks; a larger one is written to the shared folder in parts, which a task
goes through block by block for each shard.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.files import located
from trajlab.llm.suffixes import MOST, RangeHashes, bounds, suffix_array
from trajlab.llm.tables import fresh_dir, keyed, table
from trajlab.llm.text import ALNUM, Words, gathered, released

N = 10
#: bytes of benchmark text of a block
BLOCK_BYTES = 4 << 20
#: blocks that a Python worker keeps, so that a benchmark of their size is taken apart once
KEPT_BLOCKS = 8
#: document text behind one suffix array
SHARD_BYTES = 8 << 20

_SCHEMA = "doc_id long, text_key long, n_words long, longest long, starts array<int>, ends array<int>, items array<long>"


class TestBlock:
    """The windows of a block of benchmark items, equal ones as one class, and all its suffixes in order, in
    symbols of the block's own vocabulary."""

    def __init__(self, ids: list, texts: list, n: int):
        w = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        self.n = n
        self.vocabulary, words = np.unique(w.hashes(), return_inverse=True)
        counts, row = w.counts, w.row_of_word()
        # a terminator behind each item
        self.symbols = np.zeros(len(words) + len(counts), np.int64)
        place = np.arange(len(words)) + row
        self.symbols[place] = words + 1
        left = w.rows[1:][row] - np.arange(len(row))
        first = np.arange(len(row)) == w.rows[:-1][row]
        # a suffix of n words or more opens a window; an item of fewer words is one window
        size = np.where(left >= n, n, np.where((counts[row] < n) & first, left, 0))
        opens = np.flatnonzero(size)
        padded = np.concatenate([self.symbols, np.zeros(n, np.int64)])
        grid = np.stack([np.where(size[opens] > k, padded[place[opens] + k], 0) for k in range(n)], 1).astype(np.int32) if len(opens) else np.empty((0, n), np.int32)
        #: the words of each class, 0 behind shorter ones, and their number
        self.windows, kind = np.unique(grid, axis=0, return_inverse=True)
        self.sizes = (self.windows > 0).sum(1)
        #: distinct ids of items (a null one has none), and which of them each class has
        known = np.array([x for x in ids if x is not None], np.int64)
        self.ids = np.unique(known)
        code = np.array([-1 if x is None else int(np.searchsorted(self.ids, x)) for x in ids], np.int64)[row[opens]]
        pairs = np.unique(np.stack([kind.ravel(), code], 1)[code >= 0], axis=0) if len(opens) else np.empty((0, 2), np.int64)
        self.of_class = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.codes = pairs[:, 1]
        self.longest = int(counts.max(initial=1))
        self.array = suffix_array(self.symbols, self.longest) if len(words) else np.empty(0, np.int64)
        self.hashes = RangeHashes(self.symbols, 1)

    def matched(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest match with any suffix of the block at each place of symbols."""
        own = RangeHashes(symbols, 2)
        ends = np.append(symbols, 0)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.array))
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            same = own.common(at[open_], self.hashes, self.array[mid], self.longest)
            less = self.symbols[self.array[mid] + same] < ends[at[open_] + same]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        last = len(self.array) - 1
        return np.maximum(own.common(at, self.hashes, self.array[np.maximum(lo - 1, 0)], self.longest), own.common(at, self.hashes, self.array[np.minimum(lo, last)], self.longest))


_BLOCKS: dict[tuple, TestBlock] = {}


class Blocks:
    """The blocks of a benchmark that stands in files, read anew by each task."""

    def __init__(self, files: list[str], n: int, block_bytes: int):
        self.files, self.n, self.block_bytes = files, n, block_bytes

    def __iter__(self) -> Iterator[TestBlock]:
        for uri in self.files:
            system, path = located(uri)
            with system.open_input_file(path) as f:
                for k, batch in enumerate(gathered(pq.ParquetFile(f).iter_batches(1024), "text", self.block_bytes)):
                    key = (uri, k, self.n)
                    if key not in _BLOCKS:
                        while len(_BLOCKS) >= KEPT_BLOCKS:
                            del _BLOCKS[next(iter(_BLOCKS))]
                        _BLOCKS[key] = TestBlock(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), self.n)
                    yield _BLOCKS[key]


def _windows(symbols: np.ndarray, own: int, test: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window found among the first `own` symbols: position, words, class and longest match.
    symbols end with a terminator."""
    array = suffix_array(symbols, test.n)
    query = np.arange(len(test.windows))
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(array))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in range(test.n):
        lo, hi = bounds(symbols, array, lo, hi, depth, test.windows[query, depth].astype(np.int64))
        live = lo < hi
        query, lo, hi = query[live], lo[live], hi[live]
        full = test.sizes[query] == depth + 1
        n = (hi - lo)[full]
        places = array[np.repeat(lo[full] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        mine = places < own
        found.append((places[mine], np.full(int(mine.sum()), depth + 1), np.repeat(query[full], n)[mine]))
        query, lo, hi = query[~full], lo[~full], hi[~full]
        if not len(query):
            break
    places, length, kind = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 3
    at, back = np.unique(places, return_inverse=True)
    return places, length, kind, (test.matched(symbols, at)[back] if len(at) else at)


def _search(shard: pa.RecordBatch, test: TestBlock, piece: int = MOST, words: Words | None = None) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a shard: its words; then, for each window found, position, words, class and longest match.

    A suffix array takes `piece` words and terminators. More of them go in pieces, each read on for the
    longest benchmark item less a word, so that whatever starts in a piece of its own is seen whole.
    """
    w = words or Words(shard.column("text"), ALNUM, lower=True)
    none = np.empty(0, np.int64)
    if not len(w.starts) or not len(test.vocabulary):
        return w, none, none, none, none
    h = w.hashes()
    at = np.minimum(np.searchsorted(test.vocabulary, h), len(test.vocabulary) - 1)
    known = np.where(test.vocabulary[at] == h, at + 1, 0)
    # a terminator behind each document's words; a word that no item has ends a string as well
    symbols = np.zeros(len(h) + len(w.rows), np.int64)
    symbols[np.arange(len(h)) + w.row_of_word()] = known
    ahead = test.longest - 1
    # where the longest item itself nears a piece, pieces are longer instead of ever more
    own = len(symbols) if len(symbols) <= piece else max(piece - ahead - 1, piece // 2)
    found = []
    for a in range(0, len(symbols), own):
        part = symbols[a : a + own + ahead]
        if part.any():
            place, *more = _windows(part if part[-1] == 0 else np.append(part, 0), own, test)
            found.append((place + a, *more))
    if not found:
        return w, none, none, none, none
    places, length, kind, best = (np.concatenate(x) for x in zip(*found, strict=True))
    # back to word positions without the terminators
    word = places - np.searchsorted(w.rows[1:] + np.arange(len(w.rows) - 1), places, "right")
    return w, word, length, kind, best


def _each(test: TestBlock | Iterable[TestBlock]) -> Iterable[TestBlock]:
    return [test] if isinstance(test, TestBlock) else test


@released
def _scan(test: TestBlock | Iterable[TestBlock], batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for shard in gathered(batches, "text", most):
        w = Words(shard.column("text"), ALNUM, lower=True)
        n, n_rows = len(w.starts), shard.num_rows
        steps, top = np.zeros(n + 1, np.int64), np.zeros(n_rows, np.int64)
        pairs = [np.empty((0, 2), np.int64)]
        for t in _each(test):
            _, word, length, kind, best = _search(shard, t, words=w)
            np.add.at(steps, word, 1)
            np.add.at(steps, word + length, -1)
            owner = np.searchsorted(w.rows, word, "right") - 1
            np.maximum.at(top, owner, best)
            if len(kind):
                mine = np.unique(np.stack([owner, kind], 1), axis=0)
                many = np.diff(t.of_class)[mine[:, 1]]
                code = t.codes[np.repeat(t.of_class[mine[:, 1]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
                pairs.append(np.stack([np.repeat(mine[:, 0], many), t.ids[code]], 1))
        hit = np.cumsum(steps[:-1]) > 0
        first = hit.copy()
        first[1:] &= ~hit[:-1]
        inner = w.rows[1:-1][w.rows[1:-1] < n]
        first[inner] = hit[inner]  # spans end with their document
        last = hit.copy()
        last[:-1] &= ~hit[1:] | first[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(w.rows, starts, "right") - 1
        items = np.unique(np.concatenate(pairs), axis=0)

        def lists(rows: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n_rows + 1)), pa.int32()), pa.array(values, kind))

        base = w.rows[row] if len(row) else row
        yield pa.RecordBatch.from_arrays(
            [shard.column("doc_id"), shard.column("text_key"), pa.array(w.counts, pa.int64()), pa.array(top, pa.int64()), lists(row, starts - base, pa.int32()), lists(row, ends - base, pa.int32()), lists(items[:, 0], items[:, 1], pa.int64())],
            ["doc_id", "text_key", "n_words", "longest", "starts", "ends", "items"],
        )


def _blocks(benchmark: DataFrame, n: int, block_bytes: int):
    """What tasks get the benchmark from: one block, broadcast, where its bytes allow, else files in the
    shared folder, which stay there until the folder is cleared."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text <> ''")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:
        rows = items.collect()
        sent = spark.sparkContext.broadcast(TestBlock([r[0] for r in rows], [r[1] for r in rows], n))
        return lambda: sent.value
    folder = fresh_dir(spark, "benchmark")
    items.repartition(-(-size // block_bytes)).write.parquet(folder)
    blocks = Blocks(spark.read.parquet(folder).inputFiles(), n, block_bytes)
    return lambda: blocks


def matches(documents: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: words, longest verbatim match in words (0 if under a window), the spans
    of words hit (starts, ends) and the ids of the items with a window in it.

    A null or empty text has no words and no hits. Repeated rows are reported once each. An item with a null
    id marks words but isn't listed; items of one id are listed once. An empty benchmark hits nothing; an
    empty table gives no rows. Texts that alone exceed a shard are a shard of their own. A shard of too many
    words for a suffix array has several, over pieces that overlap, so no match is cut.
    """
    tests = _blocks(benchmark, n, block_bytes)
    return keyed(documents).mapInArrow(lambda it: _scan(tests(), it, shard_bytes), _SCHEMA)


@released
def _clean(batches: Iterator[pa.RecordBatch], test: TestBlock | Iterable[TestBlock], most: int) -> Iterator[pa.RecordBatch]:
    for shard in gathered(batches, "text", most):
        w = Words(shard.column("text"), ALNUM, lower=True)
        hit = np.zeros(shard.num_rows, bool)
        for t in _each(test):
            hit[np.searchsorted(w.rows, _search(shard, t, words=w)[1], "right") - 1] = True
        yield shard.filter(pa.array(~hit))


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of documents without a benchmark window, with their columns, filtered where the documents
    are scanned, so nothing is shuffled. Null and empty texts stay; repeated rows stay or go together; an
    empty benchmark takes nothing."""
    tests = _blocks(benchmark, n, block_bytes)
    return documents.mapInArrow(lambda it: _clean(it, tests(), shard_bytes), documents.schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit by benchmark windows in every document, and the items they are of."""
    m = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda acc, x: acc + x["ends"] - x["starts"])
    return m.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g, 0 AS z FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM bi)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
