"""The factorisation machine: its identity, what it learns and from whom, and odd rows."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tests.llm import cases
from trajlab.llm import factor_machine as M

DATA = "/root/testdata/sf0.01"


def test_linear_time_identity():
    """The score equals the sum over all pairs of features."""
    texts = ["One two two, three!", "", None, "# # # 9 | x\nx\nx"]
    x = M.features(pa.array(texts, pa.string()), np.array([19, 0, np.nan, 13]))
    rng = np.random.default_rng(0)
    m = M.Machine()
    m.bias, m.weight, m.vector = 0.3, rng.normal(size=M.WIDTH), rng.normal(size=(M.WIDTH, M.FACTORS)) / 3
    for i, got in enumerate(m.score(x)):
        f, v = x.feature[x.start[i] : x.start[i + 1]], x.value[x.start[i] : x.start[i + 1]]
        logit = m.bias + sum(m.weight[a] * b for a, b in zip(f, v))
        logit += sum(m.vector[f[a]] @ m.vector[f[b]] * v[a] * v[b] for a in range(len(f)) for b in range(a))
        assert got == pytest.approx(1 / (1 + np.exp(-logit)))


def test_gradient():
    """A step goes down the loss by what the gradient says."""
    x = M.features(pa.array(["a b c", "c d e f", "a a"]), np.array([5.0, 7.0, 3.0]))
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda m: -np.mean(y * np.log(m.score(x)) + (1 - y) * np.log(1 - m.score(x)))
    before = M.Machine()
    assert loss(M.Machine().fit(x, y, epochs=30)) < loss(before) / 3


def test_features_of_rows_are_alone():
    """A row has the features it has among others; whole texts count."""
    texts = [t for _, t in cases.rows(3, 24)] + ["word " * 50_000 + "end!"]
    n = np.array([np.nan if t is None else len(t) for t in texts])
    together = M.features(pa.array(texts, pa.string()), n)
    for i, t in enumerate(texts):
        one = M.features(pa.array([t], pa.string()), n[i : i + 1])
        a, b = together.start[i : i + 2]
        assert (together.feature[a:b] == one.feature).all() and np.allclose(together.value[a:b], one.value)
    short, long = M.features(pa.array(["word " * 10, "word " * 10 + "new"]), np.array([50.0, 53.0])), M.features(pa.array(["word " * 10]), np.array([50.0]))
    assert len(short) == 2 and len(long) == 1 and len(short.rows(np.array([1])).feature) == len(long.feature) + 1


@pytest.fixture(scope="module")
def result(spark):
    return pd.DataFrame([r.asDict() for r in M.op12_quality_classifier(spark, DATA).collect()])


def test_held_out_accuracy(result):
    docs, labels = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/labels.parquet")
    assert sorted(result.doc_id) == sorted(docs.doc_id) and result.score.between(0, 1).all()
    assert (result.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in result.doc_id]).all()
    assert (result.predicted == (result.score >= 0.3)).all()
    x = result.merge(labels, on="doc_id")
    x = x[x.held_out]
    assert len(x) > 50 and (x.predicted == x.quality).mean() >= 0.97
    assert (x[x.quality == 1].predicted == 1).mean() >= 0.98


def test_held_out_labels_lang_and_source_play_no_part(spark, result):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    docs = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "label": F.lit(3), "score": F.lit("y"), "feature": F.lit(1)})
    labels = labels.withColumn("quality", F.when(M.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("text", F.lit("z"))
    got = {r.doc_id: r.score for r in M.scored(docs, labels).collect()}
    assert all(got[d] == s for d, s in zip(result.doc_id, result.score))


def test_bounded_sample(spark):
    docs, labels = cases.documents(spark), spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (5, 0, 0), (100, 1, 0), (101, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fit = M.Machine.fit
    try:
        M.Machine.fit = lambda self, x, y, *a: seen.append((len(x), len(y))) or fit(self, x, y, *a)
        M.fitted(docs, labels, sample=7)
        M.fitted(docs, labels)
    finally:
        M.Machine.fit = fit
    assert seen[0] == (7, 7) and seen[1][0] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in [*range(40), 100, 101])


def test_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = M.scored(cases.documents(spark), labels).collect()
    assert len(out) == len(cases.rows()) and {r.score for r in out} == {0.5}
    assert not any(r.held_out for r in out if r.doc_id is None)
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    by = {}
    for r in M.scored(cases.documents(spark), some).collect():
        by.setdefault((r.doc_id, r.held_out), set()).add(round(r.score, 9))
    assert len(by[5, zlib.crc32(b"5") % 5 == 0]) == 1
    assert M.scored(cases.empty(spark), some).count() == 0
