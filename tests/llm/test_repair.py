"""Conversation repair against a plain recursion over suffixes."""

import functools
import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict

import pyarrow as pa

from trajlab.llm import repair

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(told).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, lost, truncated), by the least suffix of each place and state."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    @functools.cache
    def rest(i, state, inserts=0):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for x in step[state].keys() & name.keys():
                c, audit, lines = rest(i, x, inserts + 1)
                found.append((c + 2, "I" + audit, (f"{name[x]}:", lines)))
        if i < len(rows):
            role, text, lost, cut = rows[i]
            c, audit, lines = rest(i + 1, state)
            found.append((c + 3, "D" + audit, lines))
            if not lost:
                if role[:1] in step[state]:
                    c, audit, lines = rest(i + 1, step[state][role[:1]])
                    found.append((c + cut, "K" + audit, (f"{role}:{text}", lines)))
                for x in step[state].keys() & name.keys():
                    c, audit, lines = rest(i + 1, x)
                    found.append((c + 2 + cut, "R" + audit, (f"{name[x]}:{text}", lines)))
        return min(found, key=lambda x: x[:2]) if found else (1 << 60, "", ())

    for i in range(len(rows), -1, -1):
        for state in step:
            rest(i, state)
    cost, audit, lines = rest(0, "")
    out = []
    while lines:
        out.append(lines[0])
        lines = lines[1]
    return cost, audit, out


def brute(rows):
    groups = defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, kinds, faults = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            marks = SPACE.findall(text)
            fault = 0 if not marks else 1 if (role, text) in seen else 2 if marks[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            kinds.append((role, text, fault in (0, 1), int(fault == 2)))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(tuple(kinds))
        out.append((str(conv), gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def query(spark, rows, tmp_path):
    import pyarrow.parquet as pq

    cols = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["conv_id", "turn", "role", "text"]
    data = pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)
    for extra in ("pos", "lines", "h", "same", "stretch"):
        data = data.append_column(extra, pa.array(["x"] * len(rows), pa.string()))
    pq.write_table(data, tmp_path / "conversations.parquet")
    return sorted((str(r.conv_id), r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect())


def some(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u", None])
            text = rng.choice(["Yes.", "no", "What now?", "", " \n", "é!", "so. ", "😀", None, f"word {rng.random()}.", f"word {rng.random()}"])
            rows.append((c, None if rng.random() < 0.03 else t + rng.randint(0, 1), role, text))
    return rows


def test_query_on_small_tables(spark, tmp_path):
    rng = random.Random(5)
    rows = some(rng, 150, 7) + [(None, t, r, "Hm.") for t in (0, 1, 2, None) for r in ("user", "assistant")]
    rng.shuffle(rows)
    assert query(spark, rows, tmp_path) == brute(rows)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    assert sorted((str(r[0]), *r[1:]) for r in con.execute(repair.OP13_SQL).fetchall()) == brute(rows)


def test_long_conversations_cross_fragments(spark, tmp_path, monkeypatch):
    """One conversation of most rows, over many ranges, fragments and states between them."""
    sys.setrecursionlimit(20_000)
    rng = random.Random(6)
    rows = some(rng, 3, 900) + some(rng, 40, 3)
    rows = [(c if i < 1500 else 100 + c, *x) for i, (c, *x) in enumerate(rows)]
    rows += [(7, t, "user" if t % 2 else "assistant", "The same.") for t in range(2500)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_fragments_of_any_cut_agree():
    """The joined picks equal the least path over the whole, wherever it is cut."""
    rng = random.Random(7)
    for _ in range(60):
        rows = [{"conv_id": 1, "pos": i, "turn": i, "initial": rng.choice("sua?ua"), "blank": rng.random() < 0.1, "repeated": rng.random() < 0.1, "cut": rng.random() < 0.2} for i in range(rng.randint(1, 30))]
        kinds = [(r["initial"], r["blank"] or r["repeated"], r["cut"] and not r["blank"] and not r["repeated"]) for r in rows]
        whole = [(p >> 9 * len(rows), repair.digits(p, len(rows)) + "2" * repair.CLOSING[s], s) for s, p in enumerate(repair.least(kinds, 0)) if p is not None]
        cost, letters = min((c + 2 * repair.CLOSING[s], d) for c, d, s in whole)
        chain, parts, at = repair._Chain(1), {}, 0
        while at < len(rows):
            end = at + rng.randint(1, 9)
            f = repair._fragment(rows[at:end], at == 0)
            chain.take(f["frag"], [f["initials"][0], f["initials"][-1]], f["low"], f["high"], f["turns"], f["costs"], f["ranks"])
            parts[f["frag"]] = f["digits"]
            at = end
        picks = sorted(chain.picks(), key=lambda x: x["frag"])
        assert (sum(x["cost"] for x in picks), "".join(parts[x["frag"]][x["pick"]] + x["closing"] for x in picks)) == (cost, letters)


def test_paths_are_integers_in_order():
    """The least integer is the least (cost, letters)."""
    kinds = [("u", False, True), ("a", True, False), ("?", False, False)]
    for path in repair.least(kinds, 0):
        if path is not None:
            letters = repair.digits(path, 3)
            assert len(letters) == 9 and path == (path >> 27 << 27) + int(letters, 8)
    assert repair.edges("s", True, False) == [(a, b, c, d) for a, b, c, d in repair.edges("s", True, False) if d & 7 != 3]


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi there"), (2, 0, "system", "Be kind."), (2, 1, "user", " "), (3, 5, "user", "One."), (3, 6, "assistant", "Two.")]
    got = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    lines = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id, r.place)):
        lines[r.conv_id].append((r.role, r.text))
    want = {c: cheapest(tuple((r, t, not SPACE.search(t), int(bool(SPACE.search(t)) and SPACE.findall(t)[-1] not in ".!?")) for k, _, r, t in rows if k == c))[2] for c in (1, 2, 3)}
    assert {c: [f"{r}:{t}" for r, t in x] for c, x in lines.items()} == {c: x for c, x in want.items() if x}


def test_empty(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
