"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared as words, with an edit bound of one word. A line within the
bound of an earlier one, or equal to it, goes; the earliest stays. The edit
bound holds for lines of some length on (min_words); equal lines may be found
from a lesser one on (equal_words).

1. Equal lines are found by hash; each distinct line goes on once.
2. Two lines within one word of each other agree in their first or in their
   last h words, for any h up to half of the shorter. Lines that share neither
   with a distinct line have no neighbour; the others are fetched. Of these, two
   such lines agree but for an eighth around the edit, so lines that share no
   such rest go as well.
3. Each line left emits all its variants with up to one word deleted, as
   hashed keys. Equal variants meet: with the deletion at one place they are a
   substitution, with a whole line an insertion. A group keeps its earliest line
   (partial sums first), so a key with many lines makes no pairs.
4. The edit is verified on the words of both lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.tables import Scratch, freed, keyed, quoted, same_row, table, unused

#: lines of fewer words are compared with no other for an edit
MIN_WORDS = 8
#: hashes that one running sum goes over before another begins, as a sum copies what it has so far
_STRETCH = 64


def line_words(line: Column) -> Column:
    """The words between white space; the regular expression is left to lines with more than spaces."""
    odd = reduce(lambda a, b: a | b, [line.contains(c) for c in "\t\n\x0b\x0c\r"])
    return F.filter(F.when(odd, F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " ")), lambda w: w != "")


def _half_keys(h: Column) -> Column:
    """Hashes of the first and last words: as many as the largest power of two up to half of the line.
    A line whose own number is a power of two also has those of lines one word shorter."""
    n = F.size(h)
    k = F.pow(F.lit(2), F.floor(F.log2(n / 2) + 1e-9)).cast("int")

    def both(k: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), k, F.slice(h, F.lit(1), k)), F.xxhash64(F.lit("last"), k, F.slice(h, n - k + 1, k))]

    return F.when(n == 2 * k, F.array(*both(k), *both((k / 2).cast("int")))).otherwise(F.array(*both(k)))


def _joined(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _total(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), _joined)


def _along(part: Column, first: Column) -> Column:
    none = F.array().cast("array<struct<u:bigint,v:bigint>>")

    def on(acc: Column, d: Column) -> Column:
        return F.struct(_joined(acc["u"], d["u"]).alias("u"), _joined(acc["v"], d["v"]).alias("v"))

    return F.aggregate(part, F.struct(first.alias("at"), none.alias("all")), lambda acc, d: F.struct(on(acc["at"], d).alias("at"), F.concat(acc["all"], F.array(on(acc["at"], d))).alias("all")), lambda acc: acc["all"])


def _running(hashes: Column, start: Column) -> Column:
    """start, then with the first of the hashes (u, v) joined to it, the first two, and so on."""

    def whole(part: Column) -> Column:
        return F.struct(_total(F.transform(part, lambda h: h["u"])).alias("u"), _total(F.transform(part, lambda h: h["v"])).alias("v"))

    stretches = F.transform(F.sequence(F.lit(0), F.ceil(F.size(hashes) / _STRETCH).cast("int") - 1), lambda i: F.slice(hashes, i * _STRETCH + 1, F.lit(_STRETCH)))
    firsts = F.concat(F.array(start), _along(F.transform(stretches, whole), start))
    long = F.flatten(F.zip_with(stretches, F.slice(firsts, F.lit(1), F.size(firsts) - 1), _along))
    return F.concat(F.array(start), F.when(F.size(hashes) <= _STRETCH, _along(hashes, start)).otherwise(long))


def _placed(words: DataFrame, *more: str) -> DataFrame:
    """The hash of each word at its place (own), and at the place before (moved)."""
    return words.select("at", *more, F.transform("words", lambda w, j: F.xxhash64(w, j)).alias("own"), F.transform("words", lambda w, j: F.xxhash64(w, j - 1)).alias("moved"))


def _step(m: Column) -> Column:
    """An eighth of a line of m words, as a power of two."""
    return F.pow(F.lit(2), F.floor(F.log2(F.greatest(m / 8, F.lit(1.0))) + 1e-9)).cast("int")


def _prefixes(hashes: Column, step: Column) -> Column:
    """The joined hashes of none, of the first `step`, of twice as many, and so on to all."""
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(hashes) / step).cast("int") - 1), lambda j: _total(F.slice(hashes, j * step + 1, step)))
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(parts, zero, lambda acc, d: F.concat(acc, F.array(_joined(F.element_at(acc, -1), d))))


def _window_keys(m: Column, ahead: Column, behind: Column) -> Column:
    """Hashes of a line but for a window, at each place, in a line of m words: what stands ahead of the
    window and what behind it, from prefixes of either."""
    total = F.element_at(behind, -1)
    return F.transform(F.sequence(F.lit(0), F.size(ahead) - 2), lambda j: F.xxhash64(m, j, F.get(ahead, j), _joined(total, F.get(behind, j + 1))))


def _windows(words: DataFrame) -> DataFrame:
    """at and a key for each window of an eighth of a line: with m its own length, and one less, as that of
    the shorter line of a pair, in which words behind the window stand one place on. Two lines that differ in
    a word agree on the rest of the window around it."""
    n = F.size("own")
    steps = _placed(words).select("*", n.alias("n"), _step(n).alias("step"), _step(n - 1).alias("less"))
    sums = steps.select("at", "n", _prefixes(F.col("own"), F.col("step")).alias("whole"), _prefixes(F.slice("own", F.lit(1), F.col("n") - 1), F.col("less")).alias("ahead"), _prefixes(F.slice("moved", F.lit(2), F.col("n") - 1), F.col("less")).alias("behind"))
    # outer, as for lines
    return sums.select("at", F.explode_outer(F.concat(_window_keys(F.col("n"), F.col("whole"), F.col("whole")), _window_keys(F.col("n") - 1, F.col("ahead"), F.col("behind")))).alias("key"))


def _lines(docs: DataFrame, min_words: int, equal_words: int) -> DataFrame:
    """at (doc_id null last, doc_id, text_key, line), id (two hashes of the words) and half keys of each
    line of equal_words words or more; one of fewer than min_words has no half keys."""
    least = min(min_words, equal_words)
    # outer, as Spark else asks first whether the array is empty, by making it twice; likewise the words'
    # hashes pass an explode of one, which keeps the filter on them above it
    line = docs.select("doc_id", "text_key", F.posexplode_outer(F.split("text", "\n")).alias("line", "s")).where(F.octet_length("s") >= 2 * least - 1)
    words = F.array(F.transform(line_words(F.col("s")), lambda w: F.xxhash64(w)))
    hashed = line.select("doc_id", "text_key", "line", F.explode_outer(words).alias("h")).where(F.size("h") >= least)
    keys = _half_keys(F.col("h"))
    if equal_words < min_words:
        keys = F.when(F.size("h") >= min_words, keys).otherwise(F.array().cast("array<bigint>"))
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line")
    return hashed.select(at.alias("at"), F.struct(F.xxhash64("h").alias("x"), F.xxhash64(F.lit(1), "h").alias("y")).alias("id"), keys.alias("keys"))


def _hashed(words: DataFrame) -> DataFrame:
    """at; variants: hashes (u, v) of the line without its word 1, 2, ..; u and v of the whole line. Words
    before the gap count at their own place, those behind it at the place before, so that one word leaves and
    one enters from variant to variant."""
    both = [F.transform(c, lambda h: F.struct(h.alias("u"), F.xxhash64(h).alias("v"))).alias(c) for c in ("own", "moved")]
    placed = _placed(words).select("at", F.size("own").alias("n"), *both)

    def total(c: Column, kind: str) -> Column:
        return _total(F.transform(c, lambda h: h[kind]))

    rest = F.slice("moved", F.lit(2), F.col("n") - 1)
    steps = F.zip_with(F.slice("own", F.lit(1), F.col("n") - 1), rest, lambda a, b: F.struct(_joined(a["u"], b["u"]).alias("u"), _joined(a["v"], b["v"]).alias("v")))
    ready = placed.select("at", steps.alias("steps"), F.struct(total(rest, "u").alias("u"), total(rest, "v").alias("v")).alias("start"), total(F.col("own"), "u").alias("u"), total(F.col("own"), "v").alias("v"))
    return ready.select("at", _running(F.col("steps"), F.col("start")).alias("variants"), "u", "v")


def _one_edit(a: Column, b: Column, place: Column) -> Column:
    """Whether word arrays a and b differ by at most the word at `place` (from 1), replaced in both or
    present in the longer alone."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    before = F.slice(longer, F.lit(1), place - 1) == F.slice(shorter, F.lit(1), place - 1)
    rest = F.size(longer) - place
    behind = F.slice(longer, place + 1, rest) == F.slice(shorter, F.size(shorter) - rest + 1, rest)
    return (F.size(longer) - F.size(shorter) <= 1) & before & behind


def _candidates(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """at and words of the distinct lines that share their first or last words with another. A document
    that repeats as a row brings its lines more than once."""
    keys = firsts.select("at", F.explode("keys").alias("key"))
    crowded = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    near = keys.join(crowded, "key").select("at").distinct()
    wanted = near.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(F.collect_list("at").alias("wanted"))
    met = docs.join(wanted.hint("merge"), same_row(docs, wanted)).select(F.split("text", "\n").alias("lines"), "wanted")
    # the lines are looked at twice, which keeps the split out of the function of each line
    picked = F.transform("wanted", lambda at: F.struct(at.alias("at"), F.when(F.size("lines") > at["line"], F.get("lines", at["line"])).alias("s")))
    return met.select(F.explode_outer(picked).alias("w")).select("w.at", line_words(F.col("w.s")).alias("words"))


def _alike(candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """The candidates that agree with another but for a window of an eighth."""
    windows = scratch.stored(_windows(candidates), "windows")
    met = windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    found = scratch.stored(candidates.join(windows.join(met, "key").select("at").distinct(), "at").distinct(), "alike")
    scratch.drop(windows, candidates)
    return found


def _near(candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """at of the candidates within a word of an earlier one."""
    spread = candidates.repartition(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = _hashed(spread)
    gaps = scratch.stored(hashed.select("at", F.posexplode_outer("variants").alias("gap", "key")).select("at", (F.col("gap") + 1).alias("place"), F.col("key.u").alias("u"), F.col("key.v").alias("v")), "variants")
    whole = scratch.stored(hashed.select("u", "v", F.col("at").alias("short")), "whole-lines")
    # most variants meet no other: they go before anything is made of their lines
    met = gaps.select("u", "v").unionByName(whole.select("u", "v")).groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1").select("u", "v")
    every, gaps = gaps, scratch.stored(gaps.join(met, ["u", "v"]), "met-variants")
    scratch.drop(every)
    # both lines lack their word at one place: one was replaced
    group = gaps.groupBy("u", "v", "place").agg(F.min("at").alias("other"), F.count("*").alias("n")).where("n > 1").select("u", "v", "place", "other")
    replaced = gaps.join(group, ["u", "v", "place"]).select("at", "place", "other")
    # the variant is a whole line: one word was added
    added = gaps.join(whole, ["u", "v"]).select("at", "place", "short")
    longer = added.select("at", "place", F.col("short").alias("other"))
    shorter = added.groupBy(F.col("short").alias("at0")).agg(F.min(F.struct(F.col("at").alias("other"), "place")).alias("m")).select(F.col("at0").alias("at"), "m.place", "m.other")
    pairs = replaced.unionByName(longer).unionByName(shorter).where(F.col("other") < F.col("at")).groupBy("at", "other").agg(F.min("place").alias("place"))
    verified = pairs.join(candidates, "at").join(candidates.select(F.col("at").alias("other"), F.col("words").alias("words2")), "other").where(_one_edit(F.col("words"), F.col("words2"), F.col("place")))
    return scratch.stored(verified.select("at").distinct(), "near-lines")


def dropped_lines(documents: DataFrame, min_words: int = MIN_WORDS, equal_words: int | None = None) -> DataFrame:
    """doc_id, text_key and the numbers (from 0) of the lines that go, for the rows that lose any.

    Lines of min_words words or more go if within a word of an earlier one; those of equal_words (by
    default min_words too) or more if equal to an earlier one. A line without words always stays.
    Lines end at line feeds; their order is (doc_id, hash of the text, line), null doc_ids last. Rows equal
    in doc_id and text are one document: their lines don't repeat each other. A null text has no lines; an
    empty table gives no rows.
    """
    docs, spark = keyed(documents), documents.sparkSession
    with Scratch(spark) as scratch:
        lines = scratch.stored(_lines(docs, min_words, min_words if equal_words is None else max(equal_words, 1)), "lines")
        firsts = scratch.stored(lines.groupBy("id").agg(F.min("at").alias("at"), F.first("keys").alias("keys")), "first-lines")
        candidates = scratch.stored(_candidates(docs, firsts), "candidates")
        freed(spark)
        candidates = _alike(candidates, scratch)
        freed(spark)
        near = _near(candidates, scratch).select("at", F.lit(True).alias("near"))
        kept = firsts.select("id", F.col("at")).join(near, "at", "left").select("id", F.col("at").alias("first"), "near")
        gone = lines.select("id", "at").join(kept, "id").where(F.coalesce("near", F.lit(False)) | (F.col("at") != F.col("first"))).select("at")
        # apart from the join, so that the lines of a frequent one are dealt to several tasks
        gone = scratch.stored(gone, "gone")
        by_row = gone.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(F.array_sort(F.collect_set("at.line")).alias("dropped"))
        return scratch.result(by_row)


def without_lines(documents: DataFrame, min_words: int = MIN_WORDS, equal_words: int | None = None) -> DataFrame:
    """documents with the lines that go cut from text, n_chars (where there is such a column) brought up
    to date for those texts, and two columns more: _n_lines and _n_removed, with underscores behind them
    where documents has such columns. A text that loses all lines is empty; a null one stays null, with no
    lines. Repeated rows lose the same lines each; an empty table stays empty."""
    gone = dropped_lines(documents, min_words, equal_words)
    freed(documents.sparkSession)
    d, k, dropped, lines = unused(documents, "d", "k", "dropped", "lines")
    n_lines, n_removed = unused(documents, "_n_lines", "_n_removed")
    joined = documents.join(gone.select(F.col("doc_id").alias(d), F.col("text_key").alias(k), F.col("dropped").alias(dropped)).hint("merge"), documents["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(documents["text"]) == F.col(k)), "left")
    split = joined.withColumn(lines, F.split("text", "\n"))
    # the lines are looked at twice, which keeps the split out of the function of each line
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    cut = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    touched = F.col(dropped).isNotNull()
    out = split.withColumn(n_lines, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn(n_removed, F.coalesce(F.size(dropped), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(touched, cut).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[out[quoted(c)] for c in documents.columns], n_lines, n_removed)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, how many go, and the digest of the rest (of nothing for a null text)."""
    found = without_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, i, ls[i + 1] AS line, list_filter(regexp_split_to_array(ls[i + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM s WHERE text IS NOT NULL)),
l AS MATERIALIZED (SELECT doc_id, i, w, array_to_string(w, ' ') AS t FROM e WHERE len(w) >= 8),
f AS MATERIALIZED (SELECT t, any_value(w) AS w, min((doc_id, i)) AS pos FROM l GROUP BY t),
v AS MATERIALIZED (SELECT t, pos, k, md5_number(array_to_string(list_concat(w[1 : k - 1], w[k + 1 : len(w)]), ' ')) AS h FROM (SELECT t, pos, w, unnest(range(1, len(w) + 1)) AS k FROM f)),
m AS (SELECT a.t FROM v a JOIN v b ON a.h = b.h AND a.k = b.k AND b.pos < a.pos UNION
      SELECT a.t FROM v a JOIN f b ON a.h = md5_number(b.t) AND b.pos < a.pos UNION
      SELECT b.t FROM v a JOIN f b ON a.h = md5_number(b.t) AND a.pos < b.pos),
g AS (SELECT l.doc_id, l.i FROM l JOIN f USING (t) LEFT JOIN (SELECT DISTINCT t, true AS near FROM m) m USING (t) WHERE near OR (l.doc_id, l.i) <> f.pos),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT s.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM s LEFT JOIN k USING (doc_id)
"""
