"""Repair of conversations against a search of all edits."""

import hashlib
import random
import re

import duckdb

from veilscan.llm import queries
from veilscan.llm import structure_repair as S

ROLES = ["user", "assistant", "system", "tool", "u", "", "assistant", "user"]
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, turns) of rows (role, text, fault), by trying all edits with two inserts at most in a place."""
    best = None

    def go(at, last, cost, audit, out, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(rows) and last in ("", "a"):
            best = min(best or (cost, audit, tuple(out)), (cost, audit, tuple(out)))
        to = NEXT[last]
        if inserts < 2:
            go(at, to, cost + 3, audit + "I", [*out, (NAMES[to], "")], inserts + 1)
        if at == len(rows):
            return
        role, text, fault = rows[at]
        go(at + 1, last, cost + 4, audit + "D", out, 0)
        if fault in (S.BLANK, S.DUPLICATE):
            return
        more = 3 if fault == S.TRUNCATED else 0
        go(at + 1, to, cost + 3 + more, audit + "R", [*out, (NAMES[to], text)], 0)
        if role[:1] == to or (last == "" and role[:1] == "s"):
            go(at + 1, role[:1], cost + more, audit + "K", [*out, (role, text)], 0)

    go(0, "", 0, "", [], 0)
    return best


def repaired(rows):
    own, nodes = S.Repair(), []
    for x in rows:
        nodes += own.add(*x)
    last, cost = own.finish()
    nodes += last
    return (cost, "".join(x.edit for x in nodes), tuple(x.row for x in nodes if x.row is not None)), own


def test_all_edits():
    for seed in range(2500):
        r = random.Random(seed)
        rows = [(r.choice(ROLES), str(k), r.choice([0, 0, 0, 0, 1, 2, 3])) for k in range(r.randrange(0, 7))]
        assert repaired(rows)[0] == cheapest(rows), rows


def test_memory_is_what_is_open():
    rows = [(x, str(k), 0) for k in range(20_000) for x in ("user", "assistant")]
    (cost, audit, turns), own = repaired(rows)
    assert cost == 0 and audit == "K" * 40_000 and len(turns) == 40_000 and own.open <= 3
    r = random.Random(1)
    _, own = repaired([(r.choice(ROLES), str(k), r.choice([0, 0, 0, 1, 3])) for k in range(20_000)])
    assert own.open < 200


def test_paths_that_never_meet_are_compared_as_wholes():
    (cost, audit, _), own = repaired([("tool", "x", 0)] * 3001)
    assert (cost, audit) == (3 * 3000 + 4, "D" + "R" * 3000) and own.open > 3000


def expected(rows):
    """All columns of the summary from damaged rows (turn, role, text) in order."""
    seen, marked = set(), []
    for _, role, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = S.BLANK if not found else S.DUPLICATE if (role, text) in seen else S.TRUNCATED if found[-1] not in ".!?" else 0
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, turns = cheapest(marked)
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = [sum(x[2] == k for x in marked) for k in (S.BLANK, S.DUPLICATE, S.TRUNCATED)]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string, lost boolean, item string, audit string"


def messy(seed):
    r = random.Random(seed)
    out = []
    for conv in (None, 0, 1, 2, 3, -4):
        turns = sorted({r.choice([None, *range(9)]) for _ in range(6)}, key=lambda t: -1 if t is None else t)
        for turn in turns:
            role, text = r.choice([*ROLES, None]), r.choice([None, "", " ", "ok.", "ok.", "x\x0b", "é! \t", "no", "z" * 3000 + "."])
            out.append((conv, turn, role, text, r.random() < 0.2, "i", "a"))
    return out + [(9, 1, "user", "lost.", True, None, None)]


def test_messy_rows(spark):
    for seed in range(6):
        rows = messy(seed)
        want = {}
        for conv, turn, role, text, lost, *_ in rows:
            own = want.setdefault(conv, [])
            if not lost:
                own.append((turn, " " if role is None else role, " " if text is None else text))
        got = {x.conv_id: tuple(x)[1:] for x in S.audit_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3), "lost").collect()}
        assert got == {conv: expected(own) for conv, own in want.items()}


def test_turns_are_the_digest(spark):
    df = spark.createDataFrame(messy(3), SCHEMA)
    texts = {}
    for x in S.repair_conversations(df, "lost").orderBy("conv_id", "place").collect():
        texts.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
        assert x.place == len(texts[x.conv_id]) - 1 and x.edit in "KRI"
    for x in S.audit_conversations(df, "lost").collect():
        assert x.repaired_sha256 == hashlib.sha256("\n".join(texts.get(x.conv_id, [])).encode()).hexdigest()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.audit_conversations(none).collect() == S.repair_conversations(none).collect() == []


def test_one_shuffle(spark):
    plan = S.audit_conversations(spark.createDataFrame(messy(1), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_statement_on_messy_rows(spark, tmp_path):
    """Damage, and order of rows without turns or role, as in the statement."""
    rows = [(c, t, r, x) for seed in range(8) for c, t, r, x, *_ in messy(seed + 50) if c is not None]
    rows = [(c + 10 * k, t, r, x) for k, (c, t, r, x) in enumerate(rows)] + [(7000, t, r, x) for k, (_, _, r, x) in enumerate(rows[:40]) for t in (k,)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    got = queries.op11_structure_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.statements()["op11_structure_repair"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(x[c] for c in names) for x in got.collect()) == sorted(want.fetchall())
