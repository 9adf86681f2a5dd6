"""Repair of conversations: the cheapest edits that make roles alternate as they should.

Kept roles must spell `(s?(ua)+)?` by their initials. An edit path is one integer: its
high digits are the cost, its low ones the letters of the edits, three octal digits a
row (up to two inserts and the row's own letter, zeros behind them), so the least
integer is the cheapest path and of equal ones the first in ASCII order. No slot's
letters begin another's, so slots compare as the strings they spell. A dynamic
programme over rows and four states takes plain minima of such integers.

Rows are ordered by ranges and cut into fragments of at most 1,024 rows. Each fragment
gives the least path for each state before and state after it; a conversation then
joins its fragments' costs and ranks of paths in one sorted pass, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.tables import Scratch, table
from trajlab.llm.text import released

DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: the digits' letters, which ascend as they do
LETTERS = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: states: nothing yet, after the system's row, after a user's, after an assistant's
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: the state that a user's or assistant's row leads to from each
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: inserts that end a conversation in each state
CLOSING = (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
#: binary logarithm of a fragment's most rows, and bits of a row's slot
CUT, SLOT = 10, 9
#: characters of a text that rows of one turn and role are ordered by
HEAD = 200
EMPTY = hashlib.sha256(b"").hexdigest()
_NOT_SPACE = r"[^\x20\x09-\x0D]"


def after_keeping(state: int, initial: str) -> int | None:
    """The state behind a kept row, None where it can't stand there."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return NEXT[state] if initial == {USER: "u", ASSISTANT: "a"}[NEXT[state]] else None


@lru_cache(maxsize=64)
def edges(initial: str, lost: bool, truncated: bool) -> list[tuple[int, int, int, int]]:
    """(before, after, cost, slot) of a row: of the ways between two states the cheapest, then the least slot."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for before in range(4):
        state, slot, cost = before, 0, 0
        for inserts in range(3):
            if inserts:
                state, slot, cost = NEXT[state], slot | INSERT << (9 - 3 * inserts), cost + COST[INSERT]
            ways = [(DELETE, state)]
            if not lost:
                ways.append((REROLE, NEXT[state]))
                if (to := after_keeping(state, initial)) is not None:
                    ways.append((KEEP, to))
            for letter, to in ways:
                found = cost + COST[letter] + (truncated and letter != DELETE), slot | letter << (6 - 3 * inserts)
                best[before, to] = min(best.get((before, to), found), found)
    return [(a, b, cost, slot) for (a, b), (cost, slot) in sorted(best.items())]


def least(rows: list[tuple[str, bool, bool]], start: int) -> list[int | None]:
    """For each state behind rows (initial, lost, truncated) the least path from `start`, as an integer of the
    cost and 9 bits a row."""
    bits = SLOT * len(rows)
    best: list[int | None] = [None] * 4
    best[start] = 0
    for i, row in enumerate(rows):
        shift, now = bits - SLOT * (i + 1), [None] * 4
        for before, after, cost, slot in edges(*row):
            if best[before] is not None:
                path = best[before] + (cost << bits) + (slot << shift)
                if now[after] is None or path < now[after]:
                    now[after] = path
        best = now
    return best


def digits(path: int, n: int) -> str:
    """The octal digits of a path's n slots."""
    return format(path & (1 << SLOT * n) - 1, "o").zfill(3 * n) if n else ""


# ---------------------------------------------------------------- in tasks

_FRAGMENT = "frag long, n long, initials string, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, costs array<long>, ranks array<long>, digits array<string>"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _fragment(rows: list[dict], alone: bool) -> dict:
    """alone: no row of the conversation stands before these, so they begin in the first state."""
    first_faults = [(r["blank"], r["repeated"] and not r["blank"], r["cut"] and not r["blank"] and not r["repeated"]) for r in rows]
    kinds = [(r["initial"], blank or repeated, cut) for r, (blank, repeated, cut) in zip(rows, first_faults, strict=True)]
    paths = [p for start in range(4) for p in (least(kinds, start) if start == NOTHING or not alone else [None] * 4)]
    n = len(rows)
    letters = [None if p is None else p & (1 << SLOT * n) - 1 for p in paths]
    rank = {x: i for i, x in enumerate(sorted({x for x in letters if x is not None}))}
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["initial"] for r in rows]
    return {
        "frag": rows[0]["pos"], "n": n, "initials": "".join(initials), "blank": sum(x[0] for x in first_faults), "duplicate": sum(x[1] for x in first_faults), "truncated": sum(x[2] for x in first_faults), "illegal": _illegal(initials),
        "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
        "costs": [None if p is None else p >> SLOT * n for p in paths], "ranks": [None if x is None else rank[x] for x in letters], "digits": [None if x is None else digits(x, n) for x in letters],
    }


@released
def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of pos; a fragment ends with its conversation, its stretch of pos, or the batch."""
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        rows, found, at = batch.to_pylist(), [], 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i]["conv_id"] != rows[at]["conv_id"] or rows[i]["stretch"] != rows[at]["stretch"]:
                # the row before is of this stretch and another conversation, so this one begins here
                alone = at > 0 and rows[at - 1]["stretch"] == rows[at]["stretch"] and rows[at - 1]["pos"] == rows[at]["pos"] - 1
                found.append({"conv_id": rows[at]["conv_id"]} | _fragment(rows[at:i], alone))
                at = i
        if found:
            yield pa.RecordBatch.from_pylist(found, pa.schema([("conv_id", kind), *((k, _ARROW[v]) for k, v in (x.split() for x in _FRAGMENT.split(", ")))]))


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_PICK = "frag long, pick long, closing string, cost long, across long, gaps long"


class _Chain:
    """One conversation's fragments, taken in order: the least integers of cost and rank for each state, and
    for each fragment the state before it that led there."""

    def __init__(self, conv):
        self.conv, self.best, self.frags, self.back = conv, [0, None, None, None], [], []
        self.last, self.across, self.low, self.high, self.turns = None, 0, None, None, 0

    def take(self, frag: int, initials: list[str], low, high, turns: int, costs: list, ranks: list) -> None:
        now, back = [None] * 4, [0] * 4
        for before in range(4):
            for after in range(4):
                cost = costs[4 * before + after]
                if self.best[before] is not None and cost is not None:
                    # the cost above the rank of the path so far, above that of the fragment's
                    path = self.best[before] + (cost << 16) + ranks[4 * before + after]
                    if now[after] is None or path < now[after]:
                        now[after], back[after] = path, before
        order = {x: i for i, x in enumerate(sorted({p & 0xFFFF for p in now if p is not None}))}
        self.best = [None if p is None else p >> 16 << 16 | order[p & 0xFFFF] << 8 for p in now]
        self.frags.append(frag)
        self.back.append(back)
        if self.last is not None:
            self.across += self.last + initials[0] not in LEGAL
        self.last = initials[1]
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def picks(self) -> list[dict]:
        ends = [None if p is None else (p >> 16) + COST[INSERT] * CLOSING[s] << 18 | (p & 0xFFFF) << 2 | CLOSING[s] for s, p in enumerate(self.best)]
        at = min((p, s) for s, p in enumerate(ends) if p is not None)
        cost, state, out = at[0] >> 18, at[1], []
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        closing = str(INSERT) * CLOSING[state]
        for k in range(len(self.frags) - 1, -1, -1):
            before, last = self.back[k][state], k == len(self.frags) - 1
            out.append({"conv_id": self.conv, "frag": self.frags[k], "pick": 4 * before + state, "closing": closing if last else "", "cost": cost if last else 0, "across": self.across if last else 0, "gaps": gaps if last else 0})
            state = before
        return out


@released
def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order of (conv_id, frag)."""
    chain, schema = None, None
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), *((k, _ARROW[v]) for k, v in (x.split() for x in _PICK.split(", ")))])
        done: list[dict] = []
        for r in batch.to_pylist():
            if chain is None or chain.conv != r["conv_id"]:
                done += chain.picks() if chain else []
                chain = _Chain(r["conv_id"])
            chain.take(r["frag"], r["ends"], r["low"], r["high"], r["turns"], r["costs"], r["ranks"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if chain:
        yield pa.RecordBatch.from_pylist(chain.picks(), schema)


def applied(initials: str, slots: str, closing: str, state: int) -> Iterator[list[dict]]:
    """What each row becomes: its inserts, then itself with a new role or its own (None), unless deleted."""
    n = len(initials)
    for i in range(n):
        out = []
        for letter in slots[3 * i : 3 * i + 3] + (closing if i == n - 1 else ""):
            if letter == str(KEEP):
                state = after_keeping(state, initials[i])
                out.append({"role": None, "own": True})
            elif letter in (str(INSERT), str(REROLE)):
                state = NEXT[state]
                out.append({"role": ROLE[state], "own": letter == str(REROLE)})
        yield out


@released
def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("own", pa.bool_())]))
    for batch in batches:
        pos, lines = [], []
        for r in batch.to_pylist():
            for i, out in enumerate(applied(r["initials"], r["slots"], r["closing"], r["pick"] // 4)):
                if out:
                    pos.append(r["frag"] + i)
                    lines.append(out)
        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(lines, kind)], ["pos", "lines"])


@released
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order of conv_id and place; a conversation's text passes by, it isn't gathered."""
    conv, state, schema = None, None, None
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("repaired_sha256", pa.string())])
        ids, done = batch.column("conv_id").to_pylist(), []
        for own, line in zip(ids, batch.column("line").to_pylist(), strict=True):
            if state is None or own != conv:
                if state is not None:
                    done.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                conv, state = own, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema)


# ---------------------------------------------------------------- the operator


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): rows damaged by crc32(`conv_id:turn`) % 20, nulls taken as one space
    there and in role and text. 0 drops the row, 1 empties its text, 2 removes `[.!?]` from it, 3 repeats the
    row, 4 makes its role user."""
    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


class Repair:
    """The repair of conversations (conv_id, turn, role, text).

    A conversation's rows stand by turn, nulls first; rows of one turn by role and text (its first 200
    characters, then a hash), equal ones side by side. A null conv_id is a conversation of its own; a null role or text counts as one space. A
    row's first fault counts: blank, duplicate (role and text seen earlier), truncated. An empty table has no
    conversation."""

    def __init__(self, scratch: Scratch, rows: DataFrame):
        role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
        rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumns({"head": F.left("text", F.lit(HEAD)), "h": F.xxhash64("text")})
        order = ["conv_id", "turn", "role", "head", "h"]
        ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "h").withColumn("pos", F.monotonically_increasing_id())
        self.rows = scratch.stored(ranged, "rows")
        # two rows are equal if their digests are
        same = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
        ending = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
        initial = F.substring("role", 1, 1)
        kept = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
        light = self.rows.select("conv_id", "turn", "pos", F.shiftright("pos", CUT).alias("stretch"), kept.alias("initial"), (ending == "").alias("blank"), (~ending.isin("", ".", "!", "?")).alias("cut"), same.alias("same"))
        firsts = light.groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(False).alias("again"))
        marked = light.drop("same").join(firsts, "pos", "left").withColumn("repeated", F.col("again").isNull()).drop("again")
        kind = rows.schema["conv_id"].dataType.simpleString()
        dealt = marked.repartition("stretch").sortWithinPartitions("pos")
        self.fragments = scratch.stored(dealt.mapInArrow(_fragments, f"conv_id {kind}, {_FRAGMENT}"), "fragments")
        ends = F.array(F.substring("initials", 1, 1), F.substring("initials", -1, 1))
        chains = self.fragments.select("conv_id", "frag", ends.alias("ends"), "low", "high", "turns", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", "frag")
        picks = chains.mapInArrow(_picked, f"conv_id {kind}, {_PICK}").drop("conv_id")
        self.chosen = scratch.stored(self.fragments.join(picks, "frag").withColumn("slots", F.get("digits", F.col("pick").cast("int"))).drop("digits", "costs", "ranks"), "chosen")

    def counts(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations with a row."""
        sums = [F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")]
        parts = F.array_sort(F.collect_list(F.struct("frag", F.concat("slots", "closing").alias("letters"))))
        audit = F.translate(F.array_join(F.transform(parts, lambda x: x["letters"]), ""), "12340", LETTERS)
        return self.chosen.groupBy("conv_id").agg(*sums, F.sum(F.col("illegal") + F.col("across")).alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))

    def lines(self) -> DataFrame:
        """(conv_id, pos, k, turn, role, text): the repaired rows in order of pos and k; an inserted one has no text."""
        edits = self.chosen.select("frag", "initials", "slots", "closing", "pick").mapInArrow(_edits, "pos long, lines array<struct<role string, own boolean>>")
        made = self.rows.join(edits, "pos").select("conv_id", "pos", "turn", F.col("role").alias("was"), "text", F.posexplode("lines").alias("k", "line"))
        return made.select("conv_id", "pos", "k", F.when(F.col("line.own"), F.col("turn")).alias("turn"), F.coalesce("line.role", "was").alias("role"), F.when(F.col("line.own"), F.col("text")).otherwise("").alias("text"))

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of conversations that have a line: the SHA-256 of `role:text` lines."""
        lines = self.lines().select("conv_id", "pos", "k", F.concat("role", F.lit(":"), "text").alias("line"))
        kind = lines.schema["conv_id"].dataType.simpleString()
        return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k").select("conv_id", "line").mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text): the conversations once repaired; place ascends in each. See Repair for
    nulls, ties and repeated rows; other columns don't come along."""
    with Scratch(conversations.sparkSession) as scratch:
        lines = Repair(scratch, conversations).lines()
        return scratch.result(lines.select("conv_id", F.struct("pos", "k").alias("place"), "turn", "role", "text"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after the damage, the cheapest repair's cost and letters, and the hash of what
    it gives; one whose rows are all dropped has zeros, no letters and the hash of nothing."""
    conversations = table(spark, sf_dir, "conversations")
    with Scratch(spark) as scratch:
        work = Repair(scratch, damaged(conversations))
        found = work.counts().join(work.digests().withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
        every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
        told = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return scratch.result(told.select(F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256")))


#: the same in DuckDB SQL, the edits as text
OP13_SQL = r"""WITH RECURSIVE b AS (SELECT *, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda c: ascii(c)::UBIGINT) AS told FROM conversations),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(told, lambda c, x: list_reduce(range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END, xor(c, x)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS kind FROM b),
dm AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
od AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS ending FROM dm),
fl AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM od),
mv(q, r, letters, cost, made) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (0, 2, 'I', 2, ['user:']), (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 2, ['user:']), (1, 3, 'II', 4, ['user:', 'assistant:']),
  (2, 2, '', 0, []), (2, 3, 'I', 2, ['assistant:']), (2, 2, 'II', 4, ['assistant:', 'user:']), (3, 3, '', 0, []), (3, 2, 'I', 2, ['user:']), (3, 3, 'II', 4, ['user:', 'assistant:'])),
ac(q, r, letter, cost, initial, role) AS (VALUES (0, 0, 'D', 3, NULL, NULL), (1, 1, 'D', 3, NULL, NULL), (2, 2, 'D', 3, NULL, NULL), (3, 3, 'D', 3, NULL, NULL), (0, 2, 'R', 2, NULL, 'user'), (1, 2, 'R', 2, NULL, 'user'), (2, 3, 'R', 2, NULL, 'assistant'), (3, 2, 'R', 2, NULL, 'user'),
  (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL)),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'made': []::VARCHAR[]} AS s FROM fl
  UNION ALL SELECT p.conv_id, f.i, a.r, min({'cost': p.s.cost + m.cost + a.cost + (f.fault = 'truncated' AND a.letter <> 'D')::INT, 'audit': concat(p.s.audit, m.letters, a.letter), 'made': list_concat(p.s.made, m.made, CASE WHEN a.letter = 'D' THEN [] ELSE [concat(coalesce(a.role, f.role), ':', f.text)] END)})
  FROM dp p JOIN fl f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN mv m ON m.q = p.q JOIN ac a ON a.q = m.r AND (a.initial IS NULL OR a.initial = f.initial) AND (a.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) GROUP BY p.conv_id, f.i, a.r),
fc AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE concat(before, initial) NOT IN ('su', 'ua', 'au') AND i > 1) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM fl) GROUP BY conv_id),
fi AS (SELECT fc.conv_id, min({'cost': s.cost + CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': concat(s.audit, CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END), 'made': list_concat(s.made, CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS s FROM fc JOIN dp ON dp.conv_id IS NOT DISTINCT FROM fc.conv_id AND dp.i = fc.n GROUP BY fc.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.cost, 0)::BIGINT AS cost, coalesce(s.audit, '') AS audit, sha256(coalesce(array_to_string(s.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN fc ON fc.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fi ON fi.conv_id IS NOT DISTINCT FROM o.conv_id"""
