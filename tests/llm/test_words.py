"""Shared helpers against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trajlab.llm import text as X
from trajlab.llm.suffixes import bounds, common, suffix_array
from trajlab.llm.tables import same_row

TEXTS = ["", None, "a", "  A bc\n\nd\t", "é☃ x\x0by", "no end", "\x1cq r", "ünï 1a2B"]


@pytest.mark.parametrize("table, pattern, lower", [(X.NOT_SPACE, rb"[^\x20\x09-\x0D]+", False), (X.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)])
def test_words(table, pattern, lower):
    w = X.Words(pa.array(TEXTS), table, lower)
    plain = [re.findall(pattern, (t or "").encode().lower() if lower else (t or "").encode()) for t in TEXTS]
    assert w.counts.tolist() == [len(x) for x in plain]
    assert [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)] == [x for row in plain for x in row]
    h = w.hashes()
    seen = {}
    for word, value in zip([x for row in plain for x in row], h.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, 5000).astype(np.uint8)
    v[3000:3100] = v[100:200]
    h = X.window_hashes(v, 50)
    assert h[100] == h[3000] and h[150] == h[3050] and h[99] != h[2999]
    r = X.range_hashes(v, np.array([100, 3000]), np.array([200, 3100]))
    assert r[0] == r[1]


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(50):
        s = np.array([rng.randint(0, 3) for _ in range(60)] + [0])
        order = suffix_array(s, 64).tolist()
        def key(i):
            end = next(j for j in range(i, len(s)) if s[j] == 0)
            return (s[i:end].tolist(), i)
        assert order == sorted(np.flatnonzero(s).tolist(), key=key)


def test_search_and_common_prefix():
    s = np.array([1, 2, 1, 2, 3, 0, 1, 2, 0])
    a = suffix_array(s, 8)
    lo, hi = bounds(s, a, np.array([0]), np.array([len(a)]), 0, np.array([1]))
    assert sorted(a[lo[0] : hi[0]].tolist()) == [0, 2, 6]
    assert common(s, np.array([0, 0]), np.array([2, 6]), 9).tolist() == [2, 2]


def test_rows_join_null_safely(spark):
    df = spark.createDataFrame([(None, 1), (1, 2)], "doc_id long, text_key long")
    assert df.alias("x").join(df.withColumnRenamed("doc_id", "doc_id"), "text_key").count() == 2
    other = df.selectExpr("doc_id", "text_key", "1 as one")
    assert df.join(other, same_row(df, other)).count() == 2
