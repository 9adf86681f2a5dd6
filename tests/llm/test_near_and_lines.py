"""Near duplicates and line dedup against brute force; filters of the pipeline on odd rows."""

import re

import pytest

import corpus_pipeline
from tests.llm import cases
from trajlab.llm import line_dedup, near_dedup
from trajlab.llm.components import labelled


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("bucket, chunk", [(20_000, 2_000_000), (2, 150)])
def test_groups(spark, bucket, chunk):
    rows = cases.rows(3, 64)
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    def least(i):
        if not sets[i]:
            return rows[i][0]
        ids = [rows[k][0] for k in range(len(rows)) if sets[k] and root(k) == root(i) and rows[k][0] is not None]
        return min(ids, default=None)
    want = sorted((str(d), len(sets[i]), str(least(i))) for i, (d, _) in enumerate(rows))
    got = near_dedup.near_groups(cases.documents(spark, 3, 64), bucket=bucket, chunk=chunk).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_pipeline_links_at_80(spark):
    def edited(t, *places):
        return " ".join(f"new{i}" if i in places else w for i, w in enumerate(t.split()))

    t = [" ".join(f"{c}{i}" for i in range(104)) for c in "ab"]
    rows = [(1, t[0]), (2, edited(t[0], 30, 60)), (3, t[1]), (4, edited(t[1], 30, 60, 90))]
    sets = [shingles(x) for _, x in rows]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (0, 2)]
    assert 0.81 < alike[0] < 0.82 and alike[1] < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in near_dedup.representatives(docs).collect()) == [1, 2, 3, 4]


def test_labels(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 9), (4, 7), (4, 8), (5, 5)], "g int, node int")
    assert {r.node: r.label for r in labelled(df).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7, 5: 5}


def edits(a, b):
    """Word edit distance up to 1."""
    if a == b:
        return 0
    for i in range(max(len(a), len(b))):
        if a[:i] + a[i + 1 :] == b or b[:i] + b[i + 1 :] == a or (len(a) == len(b) and a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :]):
            return 1
    return 2


def test_lines(spark):
    w = [f"w{i}" for i in range(12)]
    t = [" ".join(w), " ".join(w[:5] + ["new"] + w[6:]), " ".join(w[:3] + w[4:]), " ".join(w + ["more"]), " ".join(w[:7]), "  ".join(w), " ".join(w[::-1]), " ".join(["x"] + w + ["y"])]
    rows = [(1, "\n".join(t[:5])), (2, "\n".join([t[4], t[5], t[6], t[7]])), (3, None), (4, ""), (None, t[6] + "\n\n" + t[7])] + cases.rows(2, 24)[:24]
    lines = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    ids = [d for d, _ in rows]
    rows = [(1000 + i if ids.count(d) > 1 and i > 4 else d, x) for i, (d, x) in enumerate(rows)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    earlier, want = [], []
    for i in order:
        d, x = rows[i]
        kept = []
        for s in (x or "").split("\n"):
            words = [v for v in re.split(r"[\x20\x09-\x0D]+", s) if v]
            if len(words) >= 8:
                seen = any(edits(words, e) <= 1 for e in earlier)
                earlier.append(words)
                if seen:
                    continue
            kept.append(s)
        want.append((str(d), None if x is None else "\n".join(kept)))
    df = spark.createDataFrame([(d, x, 0) for d, x in rows], "doc_id long, text string, n_chars int")
    got = line_dedup.without_lines(df)
    assert got.columns == ["doc_id", "text", "n_chars", "_n_lines", "_n_removed"]
    assert sorted((str(r.doc_id), r.text) for r in got.collect() if r.text is not None) == sorted(x for x in want if x[1] is not None)


def test_pipeline_cuts_short_equal_lines(spark):
    w = [f"w{i}" for i in range(9)]
    near = " ".join(w[:4] + ["new"] + w[5:])
    rows = [(1, "Home\n\nread more\n" + " ".join(w)), (2, "read  more\n\n}\n" + near + "\nread some more"), (3, "Home"), (4, "} \n" + " ".join(w[:7])), (5, " ".join(w[:6])), (None, "Home\nlast"), (6, None), (7, " \n\n")]
    df = spark.createDataFrame([(d, x, 0) for d, x in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: "\n}\nread some more", 3: "", 4: " ".join(w[:7]), 5: " ".join(w[:6]), None: "last", 6: None, 7: " \n\n"}


def test_no_python_in_line_dedup(spark):
    plan = line_dedup.without_lines(cases.documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "tree1 house2 of3 the4 a b c d e f g"), (2, None), (None, "x y"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (cases.documents(spark), cases.empty(spark)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= n
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == n
        both = last.where("doc_id between 0 and 4").join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
        assert all(r.text == r.was for r in both.collect())


def test_unlinked_sets_of_a_chunk():
    """Sets alike enough for their sketches and too far apart to link: each pair is looked at once, in bulk."""
    import time

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n, shared = 3000, np.sort(rng.integers(0, 1 << 63, 12).astype(np.uint64))
    sets = [np.sort(np.concatenate([shared, rng.integers(0, 1 << 63, 4).astype(np.uint64)])) for _ in range(n)]
    sets[17] = np.sort(np.append(sets[4][:15], np.uint64(5)))  # one link: 15 of 17
    columns = {"label": [1] * n, "j": [0] * n, "guest": [0] * n, "root": pa.nulls(n, pa.int64()), "a": list(range(n)), "b": list(range(n)), "shingles": [x.tobytes() for x in sets], **{f"odd{k}": [0] * n for k in range(8)}}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) if isinstance(v, list) else v for k, v in columns.items()})
    began = time.time()
    (found,) = near_dedup._confirmed(iter([batch]), 85)
    assert sorted(zip(found.column("ga").to_pylist(), found.column("a").to_pylist())) == [(4, 4), (4, 17)]
    assert time.time() - began < 20


def test_chunks_of_few_sets(spark):
    """Groups are the same however few sets a chunk takes."""
    df = cases.documents(spark, 3, 64)
    told = lambda rows: sorted((str(r.doc_id), r.text_key, r.component_id or -1) for r in rows)
    assert told(near_dedup.near_groups(df, most_sets=2).collect()) == told(near_dedup.near_groups(df).collect())
    with pytest.raises(ValueError, match="70 to 100"):
        near_dedup.near_groups(df, percent=60)
