"""Removal of repeated bytes and words against brute force."""

import hashlib
from collections import Counter

import pytest

from tests.llm import cases
from trajlab.llm import substring_dedup, suffix_dedup


def plain(units_of, window, rows):
    seqs = [units_of(t) for _, t in rows]
    n = Counter(tuple(s[i : i + window]) if not isinstance(s, bytes) else s[i : i + window] for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if n[tuple(s[i : i + window]) if not isinstance(s, bytes) else s[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((gone, spans))
    return seqs, out


@pytest.mark.parametrize("window, gram, hot", [(200, 24, 4096), (60, 10, 4096), (60, 10, 1)])
def test_bytes(spark, window, gram, hot):
    rows = cases.rows()
    seqs, marks = plain(lambda t: (t or "").encode(), window, rows)
    want = sorted((str(d), len(s), sum(g), n, hashlib.sha256(bytes(b for b, x in zip(s, g) if not x)).hexdigest()) for (d, _), s, (g, n) in zip(rows, seqs, marks))
    got = suffix_dedup.dedup_bytes(cases.documents(spark), window, gram, hot).drop("kept").collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == want


@pytest.mark.parametrize("window, gram, hot", [(35, 6, 4096), (8, 3, 4096), (8, 3, 1)])
def test_words(spark, window, gram, hot):
    rows = cases.rows()
    seqs, marks = plain(lambda t: (t or "").encode().split(), window, rows)
    want = sorted((str(d), len(s), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(s, g) if not x)).hexdigest()) for (d, _), s, (g, _) in zip(rows, seqs, marks))
    got = substring_dedup.dedup_words(cases.documents(spark), window, gram, hot).drop("kept").collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == want


def test_empty(spark):
    assert suffix_dedup.dedup_bytes(cases.empty(spark)).count() == 0
    assert substring_dedup.dedup_words(cases.empty(spark)).count() == 0


def test_index_statistics():
    import random

    import numpy as np

    rng = random.Random(5)
    strings = [np.array([rng.randint(0, 1) for _ in range(rng.randint(0, 30))], np.uint8) for _ in range(12)]
    index = suffix_dedup.RunLengthIndex(strings)
    got = index.statistics()
    every = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    for k, i in every:
        best = 0
        for j, m in every:
            if (j, m) != (k, i):
                n = 0
                while i + n < len(strings[k]) and m + n < len(strings[j]) and strings[k][i + n] == strings[j][m + n]:
                    n += 1
                best = max(best, n)
        assert got[index.starts[k] + i] == best
    assert index.run_lengths.sum() == len(every)
