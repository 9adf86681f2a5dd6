"""The whole pipeline against plain Python, stage after stage; the forest's verdicts are taken from op3's operator."""

import re

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_near_and_lines import edits, shingles
from trajlab.llm import quality
from trajlab.llm.tables import shared_dir

SCHEMA = "doc_id long, text string, lang string, n_chars long, dropped string"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]


def without_lines(rows):
    seen, out = [], []
    for d, t in rows:
        kept = []
        for s in t.split("\n"):
            w = words(s)
            if w:
                gone = any(w == e or (len(w) >= 8 and len(e) >= 8 and edits(w, e) <= 1) for e in seen)
                seen.append(w)
                if gone:
                    continue
            kept.append(s)
        out.append((d, "\n".join(kept)))
    return out


def representatives(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [r for i, r in enumerate(rows) if label[i] == i or not sets[i]]


def clean(rows, items):
    def tokens(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    grams = {}
    for _, t in items:
        w = tokens(t)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams.setdefault(k, set()).add(tuple(w[i : i + k]))
    return [(d, t) for d, t in rows if not any(tuple(w[i : i + k]) in found for w in [tokens(t)] for k, found in grams.items() for i in range(len(w) - k + 1))]


def test_run(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    rows = sorted({d: t for d, t in cases.rows(9, 64) if d is not None}.items())
    rows += [(200, rows[0][1] + "\nA line that is only here, of course, and nowhere else at all"), (201, " ".join(f"w{i}" for i in range(80))), (202, " ".join(f"w{i}" if i not in (20, 50) else "new" for i in range(80)))]
    items = [(1, " ".join(rows[3][1].split()[4:20])), (-2, "w1 w2 nothing like it"), (3, None)]
    docs = spark.createDataFrame([(d, t, "en", None if t is None else len(t), "x") for d, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(d, int(d % 5 != 0), 0) for d, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {r.doc_id for r in quality.assessed(docs, labels).collect() if r.kept}
    want = clean(representatives(without_lines([(d, t) for d, t in rows if d in kept])), items)
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, list(r.ids), r.text) for r in got.collect()) == [(d, p.encode(t) if t else [], t) for d, t in want]
    assert 10 < len(want) < len(kept) < len(rows)
    # the folders between the stages are gone
    fs = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    names = [x.getPath().getName() for x in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)]
    assert not [n for n in names if n.startswith(("quality_rules", "line_dedup", "near_dedup", "decontamination", "lines-", "sets-"))]
