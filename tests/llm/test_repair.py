"""Conversation repair against every sequence of edits, and over ranges and segments of any size."""

import binascii
import hashlib
import itertools
import random
import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import same

from quillgraph.llm import repair

SPACE = "\x20\x09-\x0d"
ROLE = {"u": "user", "a": "assistant"}


def faults_of(rows):
    """First fault of each row: b, d, t or none."""
    out, seen = [], set()
    for role, text in rows:
        blank = re.search(f"[^{SPACE}]", text) is None
        out.append("b" if blank else "d" if (role, text) in seen else "" if re.search(f"[.!?][{SPACE}]*\\Z", text) else "t")
        seen.add((role, text))
    return out


def every_edit(rows, faults, most_inserts):
    """Cheapest cost, audit and repaired turns over all edits with a few inserts."""
    best = None
    for inserts in range(most_inserts + 1):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
            for choice in itertools.product("KRD", repeat=len(rows)):
                if any(f in ("b", "d") and c != "D" for f, c in zip(faults, choice)):
                    continue
                edits = []
                for i in range(len(rows) + 1):
                    edits += [("I", None)] * places.count(i)
                    edits += [(choice[i], i)] if i < len(rows) else []
                cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e, _ in edits) + 5 * sum(f == "t" and c != "D" for f, c in zip(faults, choice))
                audit = "".join(e for e, _ in edits)
                if best is not None and (cost, audit) >= best[:2]:
                    continue
                left = [(e, i) for e, i in edits if e != "D"]
                for roles in itertools.product(*[[rows[i][0]] if e == "K" else ["user", "assistant"] for e, i in left]):
                    if all(roles) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles)):
                        best = (cost, audit, [f"{r}:{'' if i is None else rows[i][1]}" for r, (_, i) in zip(roles, left)])
                        break
    return best


def step_by_step(rows, faults):
    """The same by a table of all states, for conversations of any length."""
    ends = {0: (0, "", [])}

    def better(to, state, path):
        if state not in to or path[:2] < to[state][:2]:
            to[state] = path

    def inserted(ends):
        for _ in range(2):
            for state, (c, a, t) in sorted(ends.items()):
                better(ends, repair.AFTER[state], (c + 5, a + "I", [*t, f"{repair.EXPECTED[state]}:"]))

    for (role, text), fault in zip(rows, faults):
        inserted(ends)
        new = {}
        for state, (c, a, t) in ends.items():
            better(new, state, (c + 2, a + "D", t))
            if fault not in ("b", "d"):
                charge = 5 * (fault == "t")
                better(new, repair.AFTER[state], (c + 1 + charge, a + "R", [*t, f"{repair.EXPECTED[state]}:{text}"]))
                if role[:1] in repair.KEPT[state]:
                    better(new, repair.KEPT[state][role[:1]], (c + charge, a + "K", [*t, f"{role}:{text}"]))
        ends = new
    inserted(ends)
    return min((ends[e] for e in (0, 3) if e in ends), key=lambda p: p[:2])


def made(n, rng, texts=("Yes.", "No", "Why?", "", " \t", "Well", "a!  ")):
    return [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant", " ", "sun", "under", ""]), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}{rng.choice(['.', '?', ''])}") for _ in range(n)]


def test_search_finds_the_cheapest_edits():
    rng = random.Random(4)
    kinds = {"": repair.SOUND, "t": repair.CUT_OFF, "b": repair.MUST_GO, "d": repair.MUST_GO}
    for k in range(260):
        rows = made(k % 5, rng)
        faults = faults_of(rows)
        r = repair.Rows([a for a, _ in rows], [b for _, b in rows], [kinds[f] for f in faults])
        ((cost, audit),) = repair.search(r, 0, True).values()
        want = step_by_step(rows, faults)
        assert (cost, audit, repair.edited(r, audit, 0)) == want
        if len(rows) < 4:
            assert want == every_edit(rows, faults, 3)


def summary(rows):
    """All that a conversation's row says but its id; rows are (turn, role, text) in any order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = faults_of([r[1:] for r in rows])
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, left = step_by_step([r[1:] for r in rows], faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def conversations():
    rng = random.Random(9)
    rows = [(c, t, *r) for c in range(60) for t, r in zip(sorted(rng.choices(range(30), k=rng.randrange(0, 9))), made(9, rng))]
    rows += [(70, t // 3, *r) for t, r in enumerate(made(700, rng))]  # long, with ties
    rows += [(71, 5, "user", "Same.")] * 40 + [(72, None, "user", "No turn."), (72, None, None, None), (72, 3, "assistant", "Yes.")]
    rows += [(None, 1, "user", "Lost?"), (None, 9, "assistant", "Found."), (73, 4, "system", "Only."), (74, 1, "user", "word " * 3000)]
    return rows


@pytest.mark.parametrize("rows_, ranges", [(256, 8), (3, 8), (7, 1), (1, 30)])
def test_conversations_in_segments(spark, monkeypatch, rows_, ranges):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", rows_)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, audit string, seq int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in repair.digests(repair.repair(df.repartition(5))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {c: summary([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_damage_and_sql(spark, tmp_path):
    """Dropped, emptied, unended, doubled and reroled rows, some conversations with none left."""
    rows = conversations() + [(c, t, *r) for c in range(100, 400) for t, r in zip(range(1 + c % 2), made(2, random.Random(c)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = {}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fate = binascii.crc32(key.encode()) % 20
        role, text = ("user" if fate == 4 else " " if role is None else role), (" " if text is None else text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        damaged.setdefault(c, []).extend([(t, role, text)] * {0: 0, 3: 2}.get(fate, 1))
    assert any(not v for v in damaged.values())
    query = repair.op13_repair_conversations(spark, str(tmp_path))
    assert {r["conv_id"]: tuple(r)[1:] for r in query.collect()} == {c: summary(v) for c, v in damaged.items()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert same(query, con, repair.OP13_SQL) == len(damaged)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digests(repair.repair(df)).count() == 0
    gone = spark.createDataFrame([(1, 2, "user", "x", 0)], "conv_id long, turn long, role string, text string, copies int")
    assert [tuple(r) for r in repair.digests(repair.repair(gone)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
