"""The trie against one built node by node."""

import hashlib
import random
import zlib

import duckdb
import pytest

from veilscan.llm import prefix_trie as P
from veilscan.llm import queries


def said(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), len(text.encode())


def trie(conversations):
    """All nodes of {conv_id: [(digest, bytes), ...]}."""
    members, size = {}, {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            node = tuple(x for x, _ in turns[:d])
            members.setdefault(node, set()).add(conv)
            size[node] = turns[d - 1][1] if d else 0
    children, under = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
        for d in range(len(node) + 1):
            under.setdefault(node[:d], []).append(node)
    out = []
    for node, own in members.items():
        ends = sorted(c for c in own if len(conversations[c]) == len(node))
        out.append(
            (
                min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])),
                sum(x not in children for x in under[node]), sum((len(members[x]) - 1) * size[x] for x in under[node]),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def ordered(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            out.setdefault(conv, []).append(((turn is not None, turn or 0, said(role, text)[0]), said(role, text)))
    return {conv: [x for _, x in sorted(turns)] for conv, turns in out.items()}


def rebuilt(conversations):
    out = {}
    for conv, own in conversations.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        out[conv] = conversations.get(base, [])[:h] + own[h:]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"


def some_rows(seed, convs=60, deep=30):
    r = random.Random(seed)
    rows = []
    for conv in range(-7, convs):
        if r.random() < 0.2:
            continue
        for turn in range(r.choice([1, 2, 5, 9, deep])):
            same = r.random() < 0.8
            role, text = r.choice(["user", None]) if not same else "user", f"t{turn}" if same else r.choice(["", None, "é", "x" * 200])
            rows.append((conv, None if r.random() < 0.05 else turn, role, text, "d", "k"))
    rows += rows[:20] + [(None, 1, "user", "x", "", ""), (500, None, None, None, None, None)]
    return rows


def found(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


@pytest.mark.parametrize("small", [3, 40, 4096])
def test_trie(spark, small):
    for seed in range(2):
        rows = some_rows(seed)
        turns = P.numbered_turns(P.turn_digests(spark.createDataFrame(rows, SCHEMA).repartition(3)))
        got = P.prefix_trie(turns, turns.select("conv_id").distinct(), small)
        assert found(got) == trie(ordered(rows))


def test_deep_and_wide(spark):
    """One long conversation, many copies of one, and many first turns."""
    rows = [(1, k, "user", f"a{k}", "", "") for k in range(3000)]
    rows += [(c, k, "user", f"a{k}", "", "") for c in range(2, 300) for k in range(4)]
    rows += [(c, 0, "user", f"b{c}", "", "") for c in range(300, 900)]
    turns = P.numbered_turns(P.turn_digests(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    got = P.prefix_trie(turns, turns.select("conv_id").distinct(), 500).collect()
    by = {(x.conv_id, x.depth): x for x in got}
    assert len(got) == 1 + 3000 + 600
    assert by[1, 0].n_leaves == 601 and by[1, 0].n_convs == 899 and by[1, 0].n_children == 601 and by[1, 0].parent_conv_id is None
    assert by[1, 4].n_convs == 299 and by[1, 4].n_leaves == 1 and by[1, 3000].n_children == 0
    assert by[1, 4].ends_sha256 == hashlib.sha256(",".join(map(str, range(2, 300))).encode()).hexdigest()
    assert by[1, 1].saved_tokens == 4 * 298 * 2 and by[1, 5].saved_tokens == 0 and by[1, 3].saved_tokens == 2 * 298 * 2


def test_empty(spark):
    turns = P.numbered_turns(P.turn_digests(spark.createDataFrame([], SCHEMA)))
    assert P.prefix_trie(turns, turns.select("conv_id").distinct()).collect() == []


def test_query_on_messy_rows(spark, tmp_path):
    rows = some_rows(9, convs=40, deep=12)
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    assert found(queries.op12_prefix_trie(spark, str(tmp_path))) == trie(rebuilt(ordered(rows)))


def test_statement(spark, tmp_path):
    rows = list({(x[0], x[1]): x for x in some_rows(11, convs=40, deep=12)}.values())  # one row a turn
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.statements()["op12_prefix_trie"])
    names = [d[0] for d in want.description]
    got = queries.op12_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted((tuple(x[c] for c in names) for x in got), key=repr) == sorted(want.fetchall(), key=repr)
