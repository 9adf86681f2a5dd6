"""Token ids as canonical, length-limited Huffman files.

The documents are encoded where they are read and their ids kept as a table.
Global counts of the ids (at most one row an id of the vocabulary reach the
driver) give the code. The ids then go in doc_id order by ranges, and tasks write
their ranges as files of independent blocks with the bit offset of each; sums
over the list of files number the tokens of all ranges. Tasks read the files
back, decoding all blocks of a chunk side by side with one table look-up a token.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlab.llm.files import located, removed, written
from trajlab.llm.tables import Scratch, checkpointed, fresh_dir, keyed, parts_for, table
from trajlab.llm.text import gathered, released, string_view, trimmed
from trajlab.llm.units import UnitStore, split_at_spaces

END_ID = 0
#: longest code in bits; more where the ids in use are too many for it
LIMIT = 16
#: text bytes encoded at a time
ENCODE_BYTES = 3 << 20
#: units given to the library at a time
UNITS = 20_000
#: tokens of a block, whose first bit the file notes
BLOCK = 512
#: tokens coded at a time, and tokens of a file
CHUNK, FILE_TOKENS = 1 << 20, 1 << 25
#: bytes of ids, four an id, of a doc_id range
RANGE_BYTES = 32 << 20
MAGIC = b"TLHUFF01"

# ---------------------------------------------------------------- encoding

#: a space between two non-spaces: byte-level pre-tokens never cross it
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


class ByteLevelEncoder:
    """The ids that the tokenizers library gives for whole texts with a byte-level BPE whose
    pre-tokens start at spaces, calling the library once for each distinct unit between such spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # the byte-level alphabet writes a space as this letter
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.inner = UnitStore(self._inner, most_units=800_000, most_ids=4_000_000)
        self.first = UnitStore(self._each, most_units=100_000)

    def shrink(self) -> None:
        """Between tasks a worker keeps only stores of a bounded size."""
        for store in (self.inner, self.first):
            if store.n > 600_000:
                store.clear()
        trimmed()

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.array(x, np.int32) for x in ids]), np.array([len(x) for x in ids], np.int64)

    def _inner(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        some = [self._spaced(units[k : k + UNITS]) for k in range(0, len(units), UNITS)]
        return np.concatenate([x for x, _ in some]), np.concatenate([n for _, n in some])

    def _spaced(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units that follow a space: joined, they are one text whose tokens with a leading space open them."""
        joined = "".join([f" {u}" for u in units])
        if joined.count(" ") == len(units):
            ids = self._each([joined])[0]
            opening = np.flatnonzero(self.opens[ids])
            if len(opening) == len(units) and opening[0] == 0:
                return ids, np.diff(np.append(opening, len(ids)))
        return self._each([f" {u}" for u in units])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text; a null text has none."""
        data, offsets = string_view(column)
        plain = self._regular(data, offsets) & (offsets[1:] > offsets[:-1])
        counts = np.zeros(len(column), np.int64)
        values = []
        if plain.any():
            units, at, n_units = split_at_spaces(column.filter(pa.array(plain)))
            ids, counts[plain] = self._joined(units, at, n_units)
            values.append(ids)
        odd = np.flatnonzero(~plain & (offsets[1:] > offsets[:-1]))
        if len(odd):
            lists = [_CUT.split(t) for t in column.take(pa.array(odd)).to_pylist()]
            units = [u for x in lists for u in x]
            ids, counts[odd] = self._joined(units, np.arange(len(units)), np.array([len(x) for x in lists], np.int64))
            values.append(ids)
        if len(values) < 2:
            return (values[0] if values else np.empty(0, np.int32)), counts
        # back in the order of the texts
        order = np.concatenate([np.flatnonzero(plain), odd])
        start = np.zeros(len(column), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        ends = np.cumsum(counts)
        return np.concatenate(values)[np.repeat(start - ends + counts, counts) + np.arange(int(counts.sum()))], counts

    def _joined(self, units: list[str], at: np.ndarray, n_units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of n_units units each, given as places in units, and their numbers. A text's
        first unit has no space before it."""
        is_first = np.zeros(len(at), bool)
        is_first[np.cumsum(n_units) - n_units] = True
        head, head_n = self.first.ids([units[i] for i in at[is_first].tolist()])
        body, body_n = self.inner.ids(units, at[~is_first])
        sizes = np.empty(len(at), np.int64)
        sizes[is_first], sizes[~is_first] = head_n, body_n
        ids = np.empty(int(sizes.sum()), np.int32)
        from_head = np.repeat(is_first, sizes)
        ids[from_head], ids[~from_head] = head, body
        return ids, np.add.reduceat(sizes, np.cumsum(n_units) - n_units)

    @staticmethod
    def _regular(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts in which every space surely stands between non-spaces. Any byte pair that may open
        a white space beyond ASCII leaves the decision to the regular expression."""
        space, blank = data == 0x20, _BLANK[data]
        odd = np.zeros(len(data) + 1, np.int64)
        pair = np.zeros(len(data), bool)
        if len(data) > 1:
            a, b = data[:-1], data[1:]
            pair[:-1] = (space[:-1] & blank[1:]) | (blank[:-1] & space[1:]) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
        if len(offsets) > 2:
            inner = offsets[1:-1]
            pair[inner[(inner > 0)] - 1] = False  # two texts' bytes are no pair
        full = offsets[1:] > offsets[:-1]
        pair[offsets[:-1][full]] |= space[offsets[:-1][full]]
        pair[offsets[1:][full] - 1] |= space[offsets[1:][full] - 1]
        np.cumsum(pair, out=odd[1:])
        return odd[offsets[1:]] == odd[offsets[:-1]]


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    """One encoder a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    squeeze, enc = zstandard.ZstdCompressor(level=1), encoder(path)
    try:
        for batch in gathered(batches, "text", ENCODE_BYTES):
            ids, counts = enc.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), END_ID)  # the end id behind each text
            counts = counts + 1
            ends = np.cumsum(counts)
            raw = ids.astype(enc.kind).tobytes()
            width = enc.kind.itemsize
            packed = [squeeze.compress(raw[width * (e - n) : width * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "text_key", "n_tokens", "ids"])
    finally:
        enc.shrink()


def encoded(documents: DataFrame, tokenizer_path: str, scratch: Scratch) -> DataFrame:
    """doc_id, text_key, n_tokens, ids: each text's ids with the end id, as a table in the shared folder."""
    rows = keyed(documents).mapInArrow(lambda it: _encoded(it, tokenizer_path), "doc_id long, text_key long, n_tokens long, ids binary")
    return scratch.stored(rows, "ids", "uncompressed")


def id_kind(tokenizer_path: str) -> np.dtype:
    """Two bytes an id where the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, or of as few as tell so many symbols apart, for the
    symbols with a count, by package-merge; 0 for the others. A lone symbol has one bit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, (len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    level, leaves = leaf, [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        leaves.append(rank < len(leaf))
        level = both[rank]
    take, lengths = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for kind in reversed(leaves):
        n = int(kind[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for s, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical(lengths).astype(np.uint64)
        self.width = max(1, int(self.lengths.max(initial=0)))
        # every window of `width` bits to its first symbol and that symbol's bits
        self.symbol, self.bits = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.int64)
        used = np.flatnonzero(self.lengths)
        first = (self.codes[used] << (self.width - self.lengths[used]).astype(np.uint64)).astype(np.int64)
        span = 1 << (self.width - self.lengths[used])
        places = np.repeat(first - np.cumsum(span) + span, span) + np.arange(int(span.sum()))
        self.symbol[places], self.bits[places] = np.repeat(used, span), np.repeat(self.lengths[used], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ids, and the bit offset of each block."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        begin = ends - n
        word, shift = begin >> 5, 64 - (begin & 31) - n
        wide = self.codes[ids] << shift.astype(np.uint64)
        size = int(ends[-1] + 31) // 32 + 1
        # codes share no bit, so sums are unions, and stay exact in a double
        high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), size)
        low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), size + 1)[:size]
        return (high + low).astype(">u4").tobytes(), begin[::BLOCK]

    def decode(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """n ids; all blocks advance together, a token each at a time."""
        words = np.frombuffer(payload + bytes(8), ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        out = np.zeros((len(offsets), BLOCK), np.int32)
        at, drop, mask = offsets.astype(np.int64), 64 - self.width, (1 << self.width) - 1
        whole = n // BLOCK
        for k in range(BLOCK):
            if k == n - whole * BLOCK and whole < len(at):
                at = at[:whole]
            if not len(at):
                break
            window = (pairs[at >> 5] >> (drop - (at & 31)).astype(np.uint64)).astype(np.int64) & mask
            out[: len(at), k] = self.symbol[window]
            at = at + self.bits[window]
        return out.ravel()[:n] if whole < len(offsets) else out.ravel()


@released
def _counted(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    expand, total = zstandard.ZstdDecompressor(), np.zeros(1 << LIMIT, np.int64)
    for batch in batches:
        blobs = batch.column("ids").to_pylist()
        for a in range(0, len(blobs), 512):
            n = np.bincount(np.frombuffer(b"".join(map(expand.decompress, blobs[a : a + 512])), kind), minlength=len(total))
            n[: len(total)] += total
            total = n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


# ---------------------------------------------------------------- files


@released
def _write(batches: Iterator[pa.RecordBatch], folder: str, lengths: np.ndarray, kind: np.dtype, file_tokens: int) -> Iterator[pa.RecordBatch]:
    """Files of a range's consecutive documents; a full file opens the next. `at` counts the range's
    tokens before a file."""
    code, expand, part = Code(lengths), zstandard.ZstdDecompressor(), None

    def rows() -> Iterator[tuple[int | None, int, np.ndarray]]:
        nonlocal part
        at = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for doc_id, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(expand.decompress(blob), kind)
                yield doc_id, at, ids
                at += len(ids)

    source = rows()
    row = next(source, None)
    while row is not None:
        first = expected = row[1]
        with written(folder, "tokens", ".huff") as (out, uri):
            out.write(MAGIC)
            docs, chunks, held, n_held, place = [], [], [], 0, len(MAGIC)

            def flush(ids: np.ndarray) -> None:
                nonlocal place
                payload, offsets = code.encode(ids)
                out.write(payload)
                chunks.append((place, len(payload), len(ids), offsets))
                place += len(payload)

            while row is not None and expected - first < file_tokens:
                docs.append((row[0], len(row[2])))
                held.append(row[2])
                n_held += len(row[2])
                expected += len(row[2])
                if n_held >= CHUNK:
                    ids = np.concatenate(held)
                    for a in range(0, len(ids) // CHUNK * CHUNK, CHUNK):
                        flush(ids[a : a + CHUNK])
                    held = [ids[len(ids) // CHUNK * CHUNK :]]
                    n_held = len(held[0])
                row = next(source, None)
            if n_held:
                flush(np.concatenate(held))
            foot = [np.array([first, len(docs), len(chunks), len(lengths)], "<i8").tobytes(), lengths.astype("u1").tobytes(), np.array([d is None for d, _ in docs], "u1").tobytes(), np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([n for _, n in docs], "<i8").tobytes(), np.array([c[:3] for c in chunks], "<i8").tobytes(), *(c[3].astype("<i8").tobytes() for c in chunks)]
            packed = zlib.compress(b"".join(foot), 1)
            out.write(packed + struct.pack("<Q", len(packed)))
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([expected - first], pa.int64())], ["file", "part", "at", "n_tokens"])


@released
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
            system, path = located(uri)
            with system.open_input_file(path) as f:
                size = f.size()
                f.seek(size - 8)
                (n,) = struct.unpack("<Q", f.read(8))
                f.seek(size - 8 - n)
                foot = zlib.decompress(f.read(n))
                _, n_docs, n_chunks, n_ids = np.frombuffer(foot, "<i8", 4).tolist()
                place = 32

                def take(kind: str, count: int) -> np.ndarray:
                    nonlocal place
                    got = np.frombuffer(foot, kind, count, place)
                    place += got.nbytes
                    return got

                code = Code(take("u1", n_ids))
                null, ids, counts, chunks = take("u1", n_docs), take("<i8", n_docs), take("<i8", n_docs), take("<i8", 3 * n_chunks).reshape(-1, 3)
                crc = np.zeros(n_docs, np.int64)
                doc, left, running = 0, int(counts[0]) if n_docs else 0, 0
                for at, length, n in chunks.tolist():
                    offsets = take("<i8", -(-n // BLOCK))
                    f.seek(at)
                    raw = memoryview(code.decode(f.read(length), offsets, n).astype("<u4").tobytes())
                    a = 0
                    while a < n:
                        b = min(n, a + left)
                        running = zlib.crc32(raw[4 * a : 4 * b], running)
                        left -= b - a
                        a = b
                        if not left:
                            crc[doc] = running
                            doc, running = doc + 1, 0
                            left = int(counts[doc]) if doc < n_docs else 0
                start = first + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(start, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(documents: DataFrame, tokenizer_path: str, folder: str | None = None, range_bytes: int = RANGE_BYTES, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """(file, first, n_tokens): Huffman files of all texts' ids, each text followed by END_ID, in
    ascending doc_id order (null first; rows of one doc_id by a hash of their text, repeated rows side by
    side). first: tokens in all files before this one. A null or empty text has the end id alone; an empty
    table gives no file. A range of doc_ids is a task's; many rows of one doc_id are cut by their texts'
    hashes."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    with scratch:
        kind = id_kind(tokenizer_path)
        rows = encoded(documents, tokenizer_path, scratch)
        folder = folder or fresh_dir(spark, "tokens")
        counted = rows.mapInArrow(lambda it: _counted(it, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
        counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
        lengths = code_lengths(counts)
        n = parts_for(spark, 4 * int(counts.sum()), range_bytes)
        order = [F.col("doc_id").asc_nulls_first(), F.col("text_key")]
        ranged = rows.select("doc_id", "text_key", "ids").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        files = scratch.result(ranged.mapInArrow(lambda it: _write(it, folder, lengths, kind, file_tokens), "file string, part int, at long, n_tokens long"))
    # a row a range: few enough for one window over all of them
    base = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return files.join(base, "part").select("file", (F.col("base") + F.col("at")).alias("first"), "n_tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, from their decoded ids."""
    spread = files.select("file", "first").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids through the files and back; the files go once they are read."""
    import public_tokenizers

    folder = fresh_dir(spark, "tokens")
    try:
        return checkpointed(read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)))
    finally:
        removed(spark, folder)
