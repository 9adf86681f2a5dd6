"""Near-duplicate groups: MinHash bands, odd sketches, and exact confirmation on full shingle sets.

1. Texts with equal shingle sets are one class; only classes go on.
2. Classes that share a MinHash band meet in a bucket. Their odd sketches tell
   which of them may be similar enough; a bucket so falls into clusters.
3. Clusters that share a class are joined: every link lies within such a
   neighbourhood. No pairs leave a task.
4. The full sets of a neighbourhood are compared, each pair at most once, only if
   their sketches are close, and only while its two sides aren't connected yet.
5. A neighbourhood too large for a task is dealt into chunks, each with some
   leaders of the neighbourhood, which connect most of it. Only what is left
   beside the largest component so found visits all chunks.
6. What the tasks connected is connected over all tasks.

The bands miss a pair at the threshold with probability (1 - s**4)**32, under
1e-10 at 0.85 and 5e-8 at 0.80; what they and the sketches propose is decided on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.components import labelled
from trajlab.llm.minhash import SIGNED, most_differing_bits, shingle_sets, signed
from trajlab.llm.tables import Scratch, keyed, same_row, table
from trajlab.llm.text import packed, released, unpacked

#: least similarity, in hundredths, of two linked sets
PERCENT = 85
#: classes of a bucket that are told apart by their sketches there; a larger bucket is one cluster, whose
#: sketches are looked at where its sets are compared
BUCKET = 20_000
#: leaders of a neighbourhood of several chunks
LEADERS = 16
#: shingles of a chunk of a neighbourhood, and sets of one, of which each may meet each
CHUNK, SETS = 2_000_000, 8_000
#: below, the bands would miss pairs
LEAST_PERCENT = 70


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows in order of key, a table for each value."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in key]
        cut = np.zeros(batch.num_rows, bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        cut[0] = last is not None and tuple(c[0] for c in columns) != last
        edges = np.unique(np.concatenate([[0], np.flatnonzero(cut), [batch.num_rows]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if cut[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _similar_sizes(n: np.ndarray, one: int, percent: int) -> np.ndarray:
    return (100 * np.minimum(n, one) >= percent * np.maximum(n, one))


@released
def _clusters(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(g, a): clusters of classes whose sketches may belong to linked sets, of each bucket."""
    most = most_differing_bits(percent / 100)
    for bucket in _groups(batches, ["bucket"]):
        a, n = bucket.column("a").to_numpy(), bucket.column("n").to_numpy()
        odd = np.stack([bucket.column(f"odd{i}").to_numpy().view(np.uint64) for i in range(8)], 1)
        left = np.arange(len(a))
        rows: list[tuple[np.ndarray, int]] = []
        # from a class to all it may be linked with, until a cluster is whole
        while len(left):
            todo, mine = [int(left[0])], [int(left[0])]
            left = left[1:]
            while todo and len(left):
                x = todo.pop()
                near = _similar_sizes(n[left], n[x], percent)
                near[near] = np.bitwise_count(odd[left[near]] ^ odd[x]).sum(1) <= most
                found = left[near]
                left = left[~near]
                todo += found.tolist()
                mine += found.tolist()
            if len(mine) > 1:
                rows.append((np.array(mine), len(rows)))
        if rows:
            key = bucket.column("bucket")[0].as_py()
            g = np.concatenate([np.full(len(m), k) for m, k in rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), key)), pa.array(g), pa.array(a[np.concatenate([m for m, _ in rows])])], ["bucket", "cluster", "a"])


@released
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set of each text as bytes of ascending 64-bit hashes."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            value, ranges = shingle_sets(pa.array([x for x in unpacked(part.column("blob"))], pa.binary()))
            sets = [value[x:y].tobytes() for x, y in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "b", "label", "chunks")), pa.array(sets, pa.binary())], ["a", "b", "label", "chunks", "shingles"])


@released
def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(j, ga, gb, a, b): classes connected by links between full sets, in each chunk. Guests from other
    chunks are compared with those at home; classes of one component (root, where known) aren't."""
    most = most_differing_bits(percent / 100)
    for share in _groups(batches, ["label", "j"]):
        # sets by size, so those similar in size stand together behind each
        n = np.array([len(x) // 8 for x in share.column("shingles").to_pylist()])
        share = share.take(pa.array(np.argsort(n, kind="stable")))
        n = np.sort(n)
        flat = np.frombuffer(b"".join(share.column("shingles").to_pylist()), np.uint64)
        start = np.concatenate([[0], np.cumsum(n)])
        guest = share.column("guest").to_numpy().astype(bool)
        odd = np.stack([share.column(f"odd{k}").to_numpy().view(np.uint64) for k in range(8)], 1)
        # the component of each set, renamed only when a link joins two
        roots = np.arange(len(n))

        def join(x: int, y: int, roots: np.ndarray = roots) -> None:
            one, other = sorted((roots[x], roots[y]))
            if one != other:
                roots[roots == other] = one

        first: dict[int, int] = {}
        for k, root in enumerate(share.column("root").to_pylist()):
            if root is not None:
                roots[k] = roots[first.setdefault(root, k)]
        for x in range(len(n)):
            own = flat[start[x] : start[x + 1]]
            others = np.arange(x + 1, int(np.searchsorted(n, 100 * n[x] // percent, "right")))
            if guest[x] or first:
                others = others[guest[others] != guest[x]]
            others = others[roots[others] != roots[x]]
            others = others[np.bitwise_count(odd[others] ^ odd[x]).sum(1) <= most]
            step = 64
            while len(others):
                # some at a time, as links found spare the comparisons of what they connect; more where none is found
                some, others = others[:step], others[step:]
                ends = np.cumsum(n[some])
                if some[-1] - some[0] + 1 == len(some):
                    joined = flat[start[some[0]] : start[some[-1] + 1]]
                else:
                    joined = flat[np.repeat(start[some] - ends + n[some], n[some]) + np.arange(ends[-1])]
                place = np.minimum(np.searchsorted(own, joined), n[x] - 1)
                total = np.concatenate([[0], np.cumsum(own[place] == joined)])
                shared = total[ends] - total[ends - n[some]]
                met = some[100 * shared >= percent * (n[some] + n[x] - shared)].tolist()
                for y in met:
                    join(x, y)
                if met:
                    others = others[roots[others] != roots[x]]
                else:
                    step = max(step, min(2 * step, (1 << 20) // n[x]))
        linked = np.flatnonzero(np.bincount(roots, minlength=len(roots))[roots] > 1)
        if len(linked):
            take = pa.array(linked)
            a, b = (share.column(c).combine_chunks() for c in ("a", "b"))
            top = pa.array(roots[linked])
            yield pa.RecordBatch.from_arrays([share.column("j").combine_chunks().take(take), a.take(top), b.take(top), a.take(take), b.take(take)], ["j", "ga", "gb", "a", "b"])


_LINKED = "j int, ga long, gb long, a long, b long"


def _visits(rows: DataFrame) -> DataFrame:
    """Rows as guests in every chunk of their neighbourhood but their own."""
    return rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("j <> chunk").withColumn("guest", F.lit(1))


def _links(sets: DataFrame, guests: DataFrame, percent: int) -> DataFrame:
    """Links between sets (a, b, label, chunk, chunks, root, odd.., shingles), each in its own chunk, and with guests."""
    home = sets.withColumn("j", F.col("chunk")).withColumn("guest", F.lit(0))
    dealt = home.unionByName(guests).repartition("label", "j").sortWithinPartitions("label", "j")
    return dealt.mapInArrow(lambda it: _confirmed(it, percent), _LINKED)


def _components(linked: DataFrame, step: int) -> DataFrame:
    return linked.select(F.struct(F.lit(step).alias("step"), "j", "ga", "gb").alias("g"), F.struct("a", "b").alias("node"))


def leftovers(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """The sets of neighbourhoods of several chunks with their component so far (root), and in `rest` whether
    they lie outside the largest of their neighbourhood."""
    found = labelled(_components(linked, 0)).select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.xxhash64("label").alias("root"))
    known = sets.drop("root").where("chunks > 1").join(found, ["a", "b"], "left").withColumn("root", F.coalesce("root", F.xxhash64("a", "b")))
    largest = known.groupBy("label", "root").agg(F.count("*").alias("n")).groupBy("label").agg(F.max(F.struct("n", "root")).alias("m")).select("label", F.col("m.root").alias("main"))
    return known.join(largest, "label").withColumn("rest", F.col("root") != F.col("main")).drop("main")


def near_groups(documents: DataFrame, percent: int = PERCENT, bucket: int = BUCKET, chunk: int = CHUNK, most_sets: int = SETS) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id of every row.

    component_id is the least doc_id that links reach. A null, empty or blank text has no set and is
    linked with nothing; its component is its own doc_id. Rows with equal sets are linked, so repeated
    rows are in one component. A null doc_id counts as larger than any; a group of such rows alone has a
    null component. An empty table gives no rows. percent is 70 to 100.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {LEAST_PERCENT} to 100")
    with Scratch(documents.sparkSession) as scratch:
        return scratch.result(_grouped(keyed(documents), percent, bucket, chunk, most_sets, scratch.stored))


def _grouped(docs: DataFrame, percent: int, bucket: int, chunk: int, most_sets: int, stored) -> DataFrame:
    rows = stored(docs.mapInArrow(signed, SIGNED), "signatures")
    key = ["n_shingles", "a", "b"]
    classes = stored(rows.where("a is not null").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "classes")
    sketch = [F.col("odd")[k].alias(f"odd{k}") for k in range(8)]

    banded = classes.select("a", "b", F.posexplode("bands").alias("band", "value")).select("a", "b", F.xxhash64("band", "value").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(shared, "bucket"), "members")
    usual = members.where(F.col("size") <= bucket).join(classes.select("a", "b", F.col("n_shingles").alias("n"), *sketch), ["a", "b"])
    told = usual.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _clusters(it, percent), "bucket long, cluster long, a long")
    crowded = members.where(F.col("size") > bucket).select("bucket", F.lit(-1).cast("long").alias("cluster"), "a")
    near = labelled(told.unionByName(crowded).select(F.struct("bucket", "cluster").alias("g"), F.col("a").alias("node")))

    places = classes.join(near.select(F.col("node").alias("a"), "label"), "a")
    sizes = places.groupBy("label").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("n")).where("n > 1").select("label", F.greatest(F.ceil(F.col("total") / chunk), F.ceil(F.col("n") / most_sets)).cast("int").alias("chunks"))
    wanted = stored(places.join(sizes, "label").select("a", "b", "label", "chunks", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), *sketch), "wanted")
    blobs = docs.mapInArrow(packed, "doc_id long, text_key long, blob binary")
    texts = blobs.join(wanted.hint("merge"), same_row(blobs, wanted)).select("a", "b", "label", "chunks", "blob")
    # repeated rows bring a set more than once
    sets = stored(texts.mapInArrow(_sets, "a long, b long, label long, chunks int, shingles binary"), "sets").dropDuplicates(["a", "b"])
    own = F.pmod(F.xxhash64("a", "b"), F.col("chunks")).cast("int")
    full = sets.join(wanted.select("a", "b", *[f"odd{k}" for k in range(8)]).distinct(), ["a", "b"]).withColumn("chunk", own).withColumn("root", F.lit(None).cast("long"))
    large = not sizes.where("chunks > 1").isEmpty()
    guests = full.limit(0).withColumn("j", F.lit(0)).withColumn("guest", F.lit(1))
    if large:
        pick = F.xxhash64(F.lit("leader"), "a", "b")
        leader = wanted.where("chunks > 1").groupBy("label", F.pmod(pick, F.lit(LEADERS)).alias("k")).agg(F.min(F.struct(pick, "a", "b")).alias("m")).select("m.a", "m.b")
        guests = _visits(full.join(leader, ["a", "b"]))
    linked = stored(_links(full, guests, percent), "links")
    both = _components(linked, 0)
    if large:
        known = stored(leftovers(full, linked), "leftovers")
        more = _links(known.drop("rest"), _visits(known.where("rest").drop("rest")), percent)
        both = both.unionByName(_components(more, 1))
    component = labelled(both)
    firsts = classes.select("a", "b", F.col("first.doc_id").alias("doc_id")).join(component.select("node.a", "node.b", "label"), ["a", "b"])
    ids = firsts.join(firsts.groupBy("label").agg(F.min("doc_id").alias("component")), "label").select("a", "b", "component")
    alone = classes.select("a", "b", F.col("first.doc_id").alias("own"))
    # a table of its own, so that the rows of a set with many copies are dealt to several tasks where they meet it
    found = stored(alone.join(ids, ["a", "b"], "left").select("a", "b", F.coalesce("component", "own").alias("component")), "found")
    return rows.join(found, ["a", "b"], "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def representatives(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of documents that stand for their group, with their columns: those whose doc_id is the
    group's least. Rows that repeat a kept one are kept with it; texts without words are kept."""
    gone = near_groups(documents, percent).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("trajlab_d"), F.col("text_key").alias("trajlab_k")).distinct()
    return documents.join(gone.hint("merge"), documents["doc_id"].eqNullSafe(gone["trajlab_d"]) & (F.xxhash64(documents["text"]) == gone["trajlab_k"]), "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the least document of its group."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i + 1 : i + 5], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
