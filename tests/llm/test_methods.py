"""Results that come through the named methods: against libraries, plain Python, and with the method taken away."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from tests.llm.test_near_and_lines import shingles
from tests.llm.test_repeats import plain
from trajlab.llm import decontaminate, line_dedup, lm_score, near_dedup, piece_model, pieces, quality, substring_dedup, suffix_dedup, tables, token_files

# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


ODD = ["   a  b", "x", "", None, "  " * 50 + "x", "a" * 150, " ", "\t\n x\n\n\n   y", "né 日本語テスト 😀\x00", "ab" * 3000, "ab " * 9, " lead", "trail "]


def test_ids_are_the_librarys(spark, path):
    """Whole texts and chunks of any length have the ids that the sentencepiece library gives."""
    p = library(path)
    rows = [*cases.rows(1, 24), *((300 + i, t) for i, t in enumerate(ODD))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(d), p.encode(t) if t else []) for d, t in rows)
    for chunk, group in ((1 << 13, 256), (40, 3), (7, 2)):
        got = pieces.encoded(df, path, chunk, group).collect()
        assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want


def test_matrices_decide(spark, path, monkeypatch):
    """The states at the borders of chunks come from the products of their matrices."""
    m = piece_model.model(path)
    s = m.normal("international" * 40)
    rows = pieces.cut(m, s, 50)
    chunks = pieces.Chunks(m, rows)
    matrices = chunks.matrices()
    states = pieces.borders(matrices, 0, 0)
    whole = pieces.product(matrices)
    assert whole.shape == (1, 1) and whole[0, 0].real == 0
    for cut in range(1, len(matrices)):
        left, right = pieces.product(matrices[:cut]), pieces.product(matrices[cut:])
        assert np.array_equal(pieces.crossed(left, right), whole)
        assert int(np.argmax(left[0] + right[:, 0])) == states[cut]
    got = np.concatenate(chunks.traced(list(zip(states[:-1], states[1:])))).tolist()
    assert got == library(path).encode("international" * 40)
    assert len({x for x in states}) > 1


def unigram(path, target):
    """The same file, its model type set to unigram: field 3 of trainer_spec (field 2)."""
    raw = open(path, "rb").read()
    i = 0

    def number(i):
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value, i

    while i < len(raw):
        tag, i = number(i)
        if tag & 7:
            size, i = number(i)
            if tag >> 3 == 2:
                j, end = i, i + size
                while j < end:
                    inner, j = number(j)
                    if inner >> 3 == 3:
                        assert raw[j] == 2
                        target.write_bytes(raw[:j] + b"\x01" + raw[j + 1 :])
                        return str(target)
                    if inner & 7 == 0:
                        _, j = number(j)
                    elif inner & 7 == 2:
                        k, j = number(j)
                        j += k
                    else:
                        j += 4 if inner & 7 == 5 else 8
            i += size
    raise AssertionError


def test_unigram_paths_have_the_librarys_score(spark, path, tmp_path):
    path = unigram(path, tmp_path / "u.model")
    p = library(path)
    rows = [(d, t) for d, t in cases.rows(3, 24) if t and "  " not in t and t.strip() == t][:12] + [(400, "ab" * 300)]
    score = {i: p.get_score(i) for i in range(p.get_piece_size())}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for chunk in (1 << 13, 64, 30):
        for r in pieces.encoded(df, path, chunk, 4).collect():
            t = next(t for d, t in rows if d == r.doc_id)
            assert sum(score[i] for i in r.ids) == pytest.approx(sum(score[i] for i in p.encode(t)))
            assert found.setdefault((r.doc_id, t), list(r.ids)) == list(r.ids)  # no chunk changes an id


# ---------------------------------------------------------------- repeats


@pytest.mark.parametrize("hot", [2, 6])
def test_hot_anchors(spark, hot):
    """Anchors with more segments than are indexed together, and cores with more pieces."""
    rng = random.Random(4)
    core = " ".join(f"w{rng.randint(0, 50)}" for _ in range(60))
    rows = [(i, f"{' '.join(f'a{rng.randint(0, 3)}' for _ in range(9))} {core} {' '.join(f'b{rng.randint(0, 3)}' for _ in range(9))}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seqs, marks = plain(lambda t: t.encode().split(), 12, rows)
    got = substring_dedup.dedup_words(df, 12, 4, hot).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(d, sum(g)) for (d, _), (g, _) in zip(rows, marks)]
    seqs, marks = plain(lambda t: t.encode(), 60, rows)
    got = suffix_dedup.dedup_bytes(df, 60, 10, hot).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got) == [(d, sum(g), n) for (d, _), (g, n) in zip(rows, marks)]


def test_parse_is_greedy_and_checked_at_borders():
    rng = np.random.default_rng(7)
    for seed in range(30):
        seqs = [rng.integers(0, 3, rng.integers(5, 60)).astype(np.uint64) for _ in range(6)]
        window = 8
        n = np.array([max(0, len(s) - window + 1) for s in seqs])
        many = np.arange(6) == seed % 12
        block = substring_dedup.ReferenceBlock(seqs, many)
        row, at, length = substring_dedup.parsed(block)
        for k, s in enumerate(seqs):  # the factors lie end to end and cover the sequence
            mine = sorted(zip(at[row == k].tolist(), length[row == k].tolist()))
            assert [a for a, _ in mine] == [0, *np.cumsum([max(m, 1) for _, m in mine])[:-1].tolist()]
        seen = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
        want = {(k, i) for k, s in enumerate(seqs) for i in range(n[k]) if seen[tuple(s[i : i + window])] > 1 or many[k]}
        r, a, b = substring_dedup.matcher(seqs, n, many, window)
        assert {(int(k), i) for k, x, y in zip(r, a, b) for i in range(x, y)} == want


def test_index_is_not_bypassed(spark, monkeypatch):
    """Without what the index tells nothing is removed, copies and frequent passages included."""
    none = (np.empty(0, np.int64),) * 3
    rows = [(i, "the same text over and over " * 20) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from trajlab.llm.repeats import Windows, repeated

    for w in (Windows("bytes", 200, 24), Windows("words", 35, 6)):
        assert repeated(df, w, lambda s, n, many: none).count() == 0


def test_the_mark_of_copies_removes_nothing_by_itself(monkeypatch):
    """Copies are found by the reference block, which holds them twice: where it finds no match, the mark is none."""
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 1 << 60, 60).astype(np.uint64) for _ in range(4)]
    m, many, few = np.full(4, 26), np.array([True, False, True, False]), np.zeros(4, bool)
    assert [(int(r), int(a), int(b)) for r, a, b in zip(*substring_dedup.matcher(words, m, many))] == [(0, 0, 26), (2, 0, 26)]
    assert not len(substring_dedup.matcher(words, m, few)[0])
    monkeypatch.setattr(substring_dedup, "common", lambda symbols, a, b, most: np.zeros(len(a), np.int64))
    assert not len(substring_dedup.matcher(words, m, many)[0])


def test_segments_across_chunks(monkeypatch):
    """A text longer than what is hashed at a time has the segments of the whole."""
    from trajlab.llm import repeats

    rng = np.random.default_rng(3)
    values = rng.integers(0, 5, 4000).astype(np.uint8)
    w = repeats.Windows("bytes", 30, 6)
    offsets = np.array([0, 2500, 2500, 4000])

    def windows():
        text, lo, n, anchor, _ = repeats.segments(values, offsets, w)
        return sorted((int(t), int(a) + i, int(h)) for t, a, k, h in zip(text, lo, n, anchor) for i in range(k))

    want = windows()
    monkeypatch.setattr(repeats, "CHUNK", 257)
    assert windows() == want and len(want) == 2500 - 29 + 1500 - 29


# ---------------------------------------------------------------- near duplicates


@pytest.mark.parametrize("chunk", [150, 600])
def test_many_chunks(spark, chunk, monkeypatch):
    """A neighbourhood of many chunks: the groups of brute force, and few sets sent more than once."""
    rng = random.Random(2)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(80)] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    chain = list(base)
    for i in range(12):
        chain[5 * i] = f"c{i}"
        rows.append((100 + i, " ".join(chain)))
    sent = []
    visits = near_dedup._visits
    monkeypatch.setattr(near_dedup, "_visits", lambda df: sent.append(visits(df)) or sent[-1])
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, rows[label[i]][0]) for i, (d, _) in enumerate(rows))
    assert len(sent) == 2


# ---------------------------------------------------------------- decontamination


def test_items_of_any_id(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(-5, " ".join(words[:12])), (-1, " ".join(words[5:20])), (None, " ".join(words[20:31])), (7, "w39"), (7, "w38 w39"), (1 << 40, " ".join(words[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w39"), (3, None)], "doc_id long, text string")
    for block in (1 << 22, 40):
        got = {r.doc_id: (r.longest, sorted(r["items"])) for r in decontaminate.matches(docs, bench, block_bytes=block).collect()}
        assert got == {1: (15, [-5, -1, 7, 1 << 40]), 2: (1, [7]), 3: (0, [])}
        assert [r.doc_id for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()] == [3]


def test_equal_windows_are_searched_once():
    test = decontaminate.TestBlock(list(range(2000)), ["same"] * 2000, 10)
    assert len(test.windows) == 1
    shard = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["same " * 2000])], ["doc_id", "text_key", "text"])
    assert len(decontaminate._search(shard, test)[1]) == 2000
    (got,) = [b.to_pylist()[0] for b in decontaminate._scan(test, iter([shard]), 1 << 20)]
    assert got["items"] == list(range(2000)) and got["longest"] == 1


def test_long_match_is_told():
    words = [f"w{i % 977}x{i}" for i in range(4000)]
    test = decontaminate.TestBlock([1], [" ".join(words)], 10)
    shard = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([" ".join(["a", *words[3:], "b"])])], ["doc_id", "text_key", "text"])
    (got,) = [b.to_pylist()[0] for b in decontaminate._scan(test, iter([shard]), 1 << 20)]
    assert got["longest"] == 3997 and got["starts"] == [1] and got["ends"] == [3998]


# ---------------------------------------------------------------- token files


def test_ids_beyond_16_bits():
    counts = np.zeros(70_001, np.int64)
    counts[:70_001] = 1 + np.arange(70_001) % 5
    n = token_files.code_lengths(counts)
    assert n.max() == 17 and (2.0 ** -n.astype(float)).sum() <= 1
    code = token_files.Code(n)
    ids = np.array([70_000, 0, 65_536, 4464] * 700)
    payload, offsets = code.encode(ids)
    assert (code.decode(payload, offsets, len(ids)) == ids).all()
    small = np.array([4464] * 3)
    blob = __import__("zstandard").ZstdCompressor().compress(np.array([70_000, 5], "<u4").tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["ids"])
    assert next(token_files._counted(iter([batch]), np.dtype("<u4"))).column("id").to_pylist() == [5, 70_000] and len(small) == 3


def test_ranges_and_files_are_joined(spark):
    """Texts over several ranges, files and chunks of codes have the starts of one list."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(7, f"text {i} " * 30) for i in range(40)] + [(i, f"word {i}") for i in range(60)] + [(None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_files.write_tokens(df, path, range_bytes=600, file_tokens=50)
    assert files.count() > 10
    got = sorted(token_files.read_tokens(files).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(ids) == len(rows)


# ---------------------------------------------------------------- language model


def test_scores_of_deleted_interpolation(spark):
    """The model by its definition, in plain Python."""
    rows = cases.rows(4, 40)
    docs = [(d, [*(t or "").encode().lower().split(), None], zlib.crc32(str(d).encode()) % 7 if d is not None else 0) for d, t in rows]
    deleted, held = lm_score.DELETED, lm_score.HELD_OUT

    def counts(part):
        uni, bi, n = Counter(), Counter(), 0
        for _, w, f in docs:
            if part(f):
                uni.update(w)
                bi.update(zip([None, *w], w))
                n += len(w)
        return uni, bi, n

    def bucket(c):
        return int(math.log2(c)) + 1 if c else 0

    def step(p):
        return None if p <= 0 else 2.0 ** (-round(-math.log2(p) * lm_score.STEPS) / lm_score.STEPS)

    uni, bi, n = counts(lambda f: f not in (deleted, held))
    seen = Counter()
    for _, w, f in docs:
        if f == deleted:
            for c, x in zip([None, *w], w):
                seen[bucket(uni[c]), step(bi[c, x] / max(uni[c], 1)), step(uni[x] / n)] += 1
    weights, last = {}, [0.4, 0.4, 0.2]
    for b in range(lm_score.BUCKETS):
        cells = [(p2 or 0.0, p1 or 0.0, 1 / (len(uni) + 1), k) for (x, p2, p1), k in seen.items() if x == b]
        if cells:
            w = [0.0, 0.5, 0.5] if b == 0 else [1 / 3] * 3
            for _ in range(lm_score.ROUNDS):
                new = [0.0] * 3
                for *p, k in cells:
                    total = sum(a * q for a, q in zip(w, p))
                    for i in range(3):
                        new[i] += k * w[i] * p[i] / total
                w = [max(x / sum(c[3] for c in cells), 1e-9 if b or i else 0.0) for i, x in enumerate(new)]
                w = [x / sum(w) for x in w]
            weights[b] = w
            last = w if b else last
        else:
            weights[b] = last if b else [0.0, 0.5, 0.5]
    uni, bi, n = counts(lambda f: f != held)
    want = []
    for d, w, _ in docs:
        s = 0.0
        for c, x in zip([None, *w], w):
            a = weights[bucket(uni[c])]
            s += math.log10(a[0] * bi[c, x] / max(uni[c], 1) + a[1] * uni[x] / n + a[2] / (len(uni) + 1))
        want.append((str(d), round(s, 5)))
    got = lm_score.scored(cases.documents(spark, 4), block_bytes=2000).collect()
    assert Counter((str(r.doc_id), round(r.score, 5)) for r in got) == Counter(want)


# ---------------------------------------------------------------- quality rules


def test_kept_follows_the_labels(spark):
    """The verdict is the threshold that keeps the share of good rows and rejects most bad ones."""
    rng = random.Random(8)
    rows = [(i, " ".join((rng.choice("#$%&|<>*") * 6 if i % 9 == 0 and k % 2 else f"word{rng.randint(0, 400)}") for k in range(80))) for i in range(270)]
    docs = spark.createDataFrame([*rows, (999, "short"), (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(0, 270, 2)] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.assessed(docs, labels).collect()
    good = {r.doc_id: r for r in got}
    marked = [(r.anomaly, r.doc_id % 9 != 0) for r in got if r.doc_id < 270 and r.doc_id % 2 == 0 and not r.base_failed]
    cells = sorted({math.floor(a * quality.CELLS) for a, _ in marked})
    n_good = sum(g for _, g in marked)

    def told(cell):
        kept = sum(g for a, g in marked if math.floor(a * quality.CELLS) <= cell)
        caught = sum(not g for a, g in marked if math.floor(a * quality.CELLS) > cell)
        return kept / n_good, caught, n_good - kept

    fit = [(told(c)[1], -c) for c in range(cells[0] - 1, cells[-1] + 1) if told(c)[0] >= quality.KEEP_GOOD and told(c)[1] > told(c)[2]]
    assert fit
    most, cell = max(fit)
    for r in got:
        assert r.kept == (not r.base_failed and math.floor(r.anomaly * quality.CELLS) <= -cell)
    assert most > 0 and not good[999].kept and not good[1000].kept


# ---------------------------------------------------------------- lines


def test_long_lines(spark):
    """Lines of many words, over the stretches of running hashes: one word replaced, added, or two."""
    w = [f"w{i % 91}v{i}" for i in range(900)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:500], "new", *w[501:]])), (3, " ".join([*w[:3], *w[4:]])), (4, " ".join([*w, "more"])), (5, " ".join([*w[:70], "a", *w[71:300], "b", *w[301:]]))]
    got = {r.doc_id: r.text for r in line_dedup.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "", 4: "", 5: rows[4][1]}


def test_clashing_names(spark):
    rows = [(1, "a b c d e f g h\na b c d e f g h", "x", 5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_n_lines` string, d int, `dropped` string")
    out = line_dedup.without_lines(df)
    assert out.columns == ["doc_id", "text", "_n_lines", "d", "dropped", "_n_lines_", "_n_removed"]
    assert tuple(out.first()) == (1, "a b c d e f g h", "x", 5, "y", 2, 1)


def test_steps_are_native(spark):
    """No step of line dedup runs Python: every table that it stores, not its last plan alone."""
    plans = []
    stored = tables.Scratch.stored
    tables.Scratch.stored = lambda self, df, name, codec="zstd": plans.append((name, df._jdf.queryExecution().toString())) or stored(self, df, name, codec)
    try:
        line_dedup.without_lines(cases.documents(spark)).count()
    finally:
        tables.Scratch.stored = stored
    assert {"lines", "first-lines", "candidates", "windows", "alike", "variants"} <= {n for n, _ in plans}
    assert not any(re.search("Python|Arrow|Pandas", p) for _, p in plans)


def test_scratch_goes_when_a_step_fails(spark):
    with pytest.raises(ZeroDivisionError), tables.Scratch(spark) as scratch:
        found = scratch.stored(spark.range(3), "x")
        raise ZeroDivisionError
    with pytest.raises(Exception):
        found.count()


def test_scores_of_any_order(spark):
    """A model of longer n-grams tells repeated texts better; each order gives probabilities."""
    rows = [(i, f"the {['red', 'blue'][i % 2]} house by the {['sea', 'lake'][i % 2]} is mine") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    means = [sum(r.score for r in lm_score.scored(df, 4000, order).collect() if r.held_out) for order in (1, 2, 3)]
    assert means[0] < means[1] < means[2] < 0
    g = lm_score.BlockGrams([5, 3], __import__("zstandard").ZstdCompressor().compress(b"a b aa b"), 3)
    assert [len(set(x.tolist())) for x in g.grams] == [3, 5, 5] and g.contexts[0][0] == g.contexts[1][0] == g.grams[0][3]


@pytest.mark.parametrize("columns", ["doc_id long, text string", "doc_id long, text string, g int, node long, label long, key long, part int, at long"])
def test_empty_tables(spark, columns):
    df = spark.createDataFrame([], columns)
    assert near_dedup.near_groups(df).count() == 0 and near_dedup.representatives(df).count() == 0
    assert line_dedup.without_lines(df).count() == 0
    assert substring_dedup.dedup_words(df).count() == 0
