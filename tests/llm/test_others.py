"""Quality rules, token files, pieces, scores, archives and decontamination against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from trajlab.llm import decontaminate, lm_score, pieces, quality, token_files, warc
from trajlab.llm.suffixes import suffix_array


def test_statistics(spark):
    def base(t):
        t = t or ""
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        three = Counter(zip(w, w[1:], w[2:]))
        rep = [False] * len(w)
        for i, k in enumerate(zip(w, w[1:], w[2:])):
            if three[k] > 1:
                rep[i : i + 3] = [True] * 3
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(rep))

    got = quality.statistics(cases.documents(spark)).collect()
    assert sorted((str(r.doc_id), *r[2:7]) for r in got) == sorted((str(d), *base(t)) for d, t in cases.rows())


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    s = quality.Forest(x).score(x)
    assert s.argmax() == 500 and s[500] > 0.6
    assert quality.Forest(x[:1]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.assessed(cases.documents(spark), labels).collect()
    assert len(out) == len(cases.rows()) and all(r.kept != r.base_failed for r in out)
    assert quality.assessed(cases.empty(spark), labels).count() == 0


@pytest.mark.parametrize("weights", [[5], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128], list(range(1, 300)), [3] * 7])
def test_huffman(weights):
    counts = np.array([0, *weights, 0])
    for limit in (9, 16):
        n = token_files.code_lengths(counts, limit)
        used = n[n > 0].astype(float)
        assert n.max() <= limit and (2.0**-used).sum() <= 1 and (n > 0).sum() == len(weights)
    code = token_files.Code(n)
    ids = np.random.default_rng(1).choice(np.flatnonzero(counts), 5000)
    payload, offsets = code.encode(ids)
    assert (code.decode(payload, offsets, len(ids)) == ids).all()
    # any block decodes alone
    block = code.decode(payload, offsets[3:4], token_files.BLOCK)
    assert (block == ids[3 * token_files.BLOCK : 4 * token_files.BLOCK]).all()


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = cases.rows()
    plain = Tokenizer.from_file(path)
    ids = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    got = token_files.read_tokens(token_files.write_tokens(cases.documents(spark), path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(rows, ids))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert known == sorted(known, key=lambda d: -1 if d is None else d)
    assert token_files.read_tokens(token_files.write_tokens(cases.empty(spark), path)).count() == 0


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces(spark, model):
    """Chunks of any length give a path of the same score as the whole text, and the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def score(ids):
        return sum(model.score[model.piece[i]][0] for i in ids if i not in model.byte_of), sum(i in model.byte_of for i in ids)

    rows = cases.rows(1, 24) + [(200, "aaaaaaaaaaaaaaaaa" * 9), (201, "  " * 50 + "x"), (202, "▁ odd ▁▁mark 😀\x00")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = [[i for u in pieces.units(model.normal(t)) for p in model.traced(u, 0, len(u)) for i in model.ids_of(p)] if t else [] for _, t in rows]
    want = sorted((str(d), score(x), (t or "").replace("▁", " ")) for (d, t), x in zip(rows, whole))
    for chunk in (7, 40, 1 << 16):
        got = pieces.decoded(pieces.encoded(df, path, chunk), path).collect()
        assert sorted((str(r.doc_id), score(r.ids), r.text) for r in got) == want
    # no better path exists: all segmentations of a short word
    def all_paths(s):
        return [[s]] * (s in model.score) + [[s[:i], *rest] for i in range(1, len(s)) if s[:i] in model.score for rest in all_paths(s[i:])]
    for word in ("▁thination", "▁erstly", "stund"):
        best = max(sum(model.score[p][0] for p in x) for x in all_paths(word))
        assert model.unit_score(word) == pytest.approx(best)


def test_scores(spark):
    rows = cases.rows(4, 40)
    docs = [(d, [*(t or "").encode().lower().split(), None], zlib.crc32(str(d).encode()) % 7 if d is not None else 0) for d, t in rows]
    c, bi = Counter(), Counter()
    for _, w, f in docs:
        if f != 2:
            c.update(w)
            bi.update(zip([None, *w], w))
    n, v = sum(c.values()), len(c)
    got = lm_score.scored(cases.documents(spark, 4), block_bytes=2000).collect()
    want = Counter((str(d), f == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for d, w, f in docs)
    assert Counter((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.scored(cases.empty(spark)).count() == 0


def test_weights_are_learned():
    step = lm_score.STEPS
    cell = (3 << 20) | ((1 + step) << 10) | (1 + 10 * step)  # bigram 1/2, unigram 1/1024
    w = lm_score.learned_weights(np.array([cell]), np.array([1000]), 100)
    assert w[3][0] > 0.9 and w[:, 0].min() == w[0, 0] == 0 and np.allclose(w.sum(1), 1) and (w[20] == w[3]).all()


def test_warc(spark):
    html = ["<p>a</p>", "", None, "x" * 5000, "<p>a</p>", "é\r\n\r\nWARC/1.1", "x" * 5000, "<p>a</p>", "b"]
    rows = [(i, f"http://h/{i} \r\n", h, "more") for i, h in enumerate(html)] + [(None, None, "b", None), (8, "u", "b", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    for least, size in ((0, 1 << 25), (4, 300)):
        got = warc.read_records(warc.archive(df, min_bytes=least, file_bytes=size)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.payload_digest and (r.record_type == "revisit") == (r.refers_to is not None)
        by = {r.page_id: r for r in got if r.page_id not in (None, 8)}
        assert by[0].payload_digest == warc.payload_digest(b"<p>a</p>") and by[5].payload_bytes == len(html[5].encode())
        assert [by[i].refers_to for i in (0, 4, 7, 3, 6)] == [7, 7, None, 6, None]
        assert by[1].refers_to == (2 if least == 0 else None)
        b = [r for r in got if r.page_id in (None, 8)]
        assert sorted(r.record_type for r in b) == (["response", "revisit", "revisit"] if least == 0 else ["response"] * 3)
    assert warc.read_records(warc.archive(df.limit(0))).count() == 0


def test_cut_streams_are_errors():
    import io

    raw = zlib.compressobj(3, zlib.DEFLATED, 31)
    data = raw.compress(warc.record("response", 1, "u", warc.http_head(3), b"abc", "D") * 3) + raw.flush()
    assert len(list(warc.records(warc.inflated(io.BytesIO(data + data))))) == 6
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(data[:-9]))))


def test_decontamination(spark):
    rows = cases.rows(6, 40)
    t = dict(r for r in rows if r[0] is not None)
    def words(x):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").encode().lower())
    items = [(1, " ".join(t[6].split()[3:20])), (2, "No Such Words Here At All In Any Of The Documents"), (3, t[4]), (10, " ".join(t[1].split()[-15:])), (11, None), (12, ""), (None, " ".join(t[7].split()[5:16])), (1, "42")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, x in rows:
        w = words(x)
        hit, found = [False] * len(w), set()
        for i, y in items:
            b = words(y)
            k = min(10, len(b))
            if not k:
                continue
            grams = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)}
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    hit[j : j + k] = [True] * k
                    found.add(i)
        want.append((str(d), len(w), sum(hit), sorted(map(str, found - {None}))))
    for block in (1 << 22, 60):
        got = decontaminate.matches(cases.documents(spark, 6), bench, block_bytes=block, shard_bytes=3000).collect()
        assert sorted((str(r.doc_id), r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), sorted(map(str, r["items"]))) for r in got) == sorted(want)
    kept = decontaminate.decontaminate(cases.documents(spark, 6), bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(d for d, _, n, _ in want if not n)
    assert hashlib.sha256(b"").hexdigest()


def test_decontamination_in_pieces():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, k)) for k in (300, 0, 40, 700, 3)]
    items = [" ".join(texts[0].split()[50:90]), " ".join(texts[3].split()[-14:]), "w1 w2 w3", texts[2] + " w1 w9"]
    test = decontaminate.TestBlock([1, 2, 3, None], items, 10)
    shard = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    want = sorted(zip(*(x.tolist() for x in decontaminate._search(shard, test)[1:])))
    assert max(x[3] for x in want) == 40
    for piece in (20, 64, 97, 500):
        assert sorted(zip(*(x.tolist() for x in decontaminate._search(shard, test, piece)[1:]))) == want


def test_decontamination_of_a_text_of_many_words():
    rng = np.random.default_rng(6)
    base = [f"{x}" for x in rng.integers(0, 90, 1000)]
    n = 3000
    # the second item knows every word and is hit nowhere
    test = decontaminate.TestBlock([7, 8], [" ".join(base[200:260]), " ".join(map(str, range(90)))], 10)
    shard = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([" ".join(base * n)])], ["doc_id", "text_key", "text"])
    (got,) = [b.to_pylist()[0] for b in decontaminate._scan(test, iter([shard]), 8 << 20)]
    assert got["n_words"] == 1000 * n > 1 << 21 and got["longest"] == 60 and got["items"] == [7]
    assert got["starts"] == [200 + 1000 * i for i in range(n)] and got["ends"] == [260 + 1000 * i for i in range(n)]


def test_suffix_array_of_many_symbols():
    s = np.append(np.tile([*range(1, 65), 0], (3 << 20) // 64), 3)
    array = suffix_array(s, 40)
    assert len(array) == np.count_nonzero(s) and len(s) > 1 << 21
    # a lone 3 comes before every 3, 4, ..; suffixes alike stay in text order
    want = np.concatenate([np.r_[[len(s) - 1] if x == 3 else [], np.flatnonzero(s[:-1] == x)] for x in range(1, 65)])
    assert np.array_equal(array, want)


def test_orders_that_a_cell_cannot_hold(spark):
    """Up to five the weights are learned from every order; more is refused, not scored wrongly."""
    cell = np.array([(9 << 50) | (1 << 40) | (400 << 30) | (400 << 20) | (400 << 10) | 400], np.int64)
    assert lm_score.learned_weights(cell, np.array([10]), 100, order=5)[9].argmax() == 0
    for order in (0, 6):
        with pytest.raises(ValueError, match="1 to 5"):
            lm_score.scored(cases.documents(spark), order=order)
