"""The Merkle manifest against plain hashlib."""

import hashlib
import zlib

import numpy as np
import pytest

from tests.llm import cases
from trajlab.llm import manifest
from trajlab.llm import midstate as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(nodes, fanout):
    """Levels from the nodes up, and of each node the siblings up to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def proof(levels, i, fanout):
    out = []
    for below in levels[:-1]:
        first = i // fanout * fanout
        out += [x for j, x in enumerate(below[first : first + fanout], first) if j != i]
        i //= fanout
    return out


def brute(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(r):
        return h(*map(field, r))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, grown([leaf(r) for r in own], fanout)
    top = grown([trees[x][1][-1][0] for x in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            changed = (*r[:3], r[3] + 1, r[4]) if bad else r
            copy = [leaf(changed) if j == i else x for j, x in enumerate(levels[0])]
            subroot = grown(copy, fanout)[-1][0]
            root = grown([subroot if j == k else x for j, x in enumerate(top[0])], fanout)[-1][0]
            out.append((str(r[0]), leaf(r), levels[-1][0], top[-1][0], h(*proof(levels, i, fanout), *proof(top, k, fanout)), root, not bad))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_states_are_those_of_sha256():
    d = [hashlib.sha256(b"%d" % i).digest() for i in range(50)]
    w = M.words(d)
    assert M.packed(w) == b"".join(d)
    for n in (1, 2, 3):
        state = M.fresh(50)
        for _ in range(n):
            state = M.taken(state, w)
        assert [x.tobytes().decode() for x in M.texts(M.finished(state, n))] == [hashlib.sha256(x.hex().encode() * n).hexdigest() for x in d]


@pytest.mark.parametrize(("fanout", "n"), [(2, 1), (2, 2), (2, 7), (3, 10), (5, 26)])
def test_states_are_resumed(fanout, n):
    """A path folds a replacement without what stands left of it: the states alone carry that."""
    leaves = M.words([hashlib.sha256(b"%d" % i).digest() for i in range(n)])
    tree = manifest.Tree(leaves, fanout, None)
    again = manifest.Tree.read(*tree.packed(), n, fanout)
    other = M.words([hashlib.sha256(b"other").digest()])
    for i, path in enumerate(again.paths()):
        levels = grown([("other" if j == i else str(j)) and hashlib.sha256(b"other" if j == i else b"%d" % j).hexdigest() for j in range(n)], fanout)
        assert M.packed(manifest.raised(other, path)).hex() == levels[-1][0]
        blind = b"".join(slot.to_bytes(2) + count.to_bytes(2) + state + b"".join(x if j >= slot else bytes(32) for j, x in enumerate(others)) for slot, count, state, others in manifest.steps(path))
        assert (manifest.raised(other, blind) == manifest.raised(other, path)).all()
    assert (again.folded(leaves) == tree.root).all()


@pytest.mark.parametrize(("fanout", "block"), [(2, 4096), (2, 4), (3, 9), (2, 2)])
def test_verified(spark, monkeypatch, fanout, block):
    """Blocks of any size, several stages of them, odd ends, nulls, ties, repeats and clashing columns."""
    rng = np.random.default_rng(fanout)
    rows = [(d, "s" if i % 3 else None, [None, "", "en", "é", "de", "=", "zz"][min(6, int(rng.integers(0, 9)))], None if i % 5 == 0 else len(t or ""), t) for i, (d, t) in enumerate(cases.rows(2, 40))]
    rows += [(7, None, "solo", 3, "abc"), (None, None, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as tree", "2 as i", "text as digest", "'x' as root", "0 as total")
    from pyspark.sql import functions as F

    found = manifest.verified(df, changes={"n_chars": F.col("n_chars") + 1}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fanout=fanout, block=block)
    assert got(found) == brute(rows, fanout)


def test_odd_tables(spark):
    df = cases.documents(spark)
    assert manifest.verified(cases.empty(spark)).count() == 0
    one = got(manifest.verified(df.where("doc_id = 100")))
    assert len(one) == 1 and one[0][1] == one[0][2] == one[0][3] == one[0][5] and one[0][4] == h() and one[0][6]
    assert all(r.verified for r in manifest.verified(df).collect())


def test_query(spark):
    import pandas as pd

    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(int(a), b, c, int(e), t) for a, b, c, e, t in zip(d.doc_id, d.source, d.lang, d.n_chars, d.text)]
    assert got(manifest.op11_manifest(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_sql(spark, tmp_path):
    """The SQL on rows with nulls, ties and repeats, and the query on the same."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(d, None if i % 4 == 0 else "s", [None, "en", "de", ""][i % 4], None if i % 5 == 0 else len(t or ""), t) for i, (d, t) in enumerate(cases.rows(4, 40))]
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()])], names), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    theirs = sorted((str(r[0]), *r[1:]) for r in con.execute(manifest.OP11_SQL).fetchall())
    assert theirs == brute(rows) == got(manifest.op11_manifest(spark, str(tmp_path)))
