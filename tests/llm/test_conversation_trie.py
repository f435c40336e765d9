"""The conversation trie against SQL over a whole table, and against brute force on small and odd tables."""

import hashlib
import random
import zlib

import duckdb
import pytest

from waymark.llm import conversation_trie, oracles, queries

SF2 = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, n_convs string"


def brute(rows):
    """Nodes as the contract has them, by prefixes held whole."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    own = {c: [r[2:] for r in sorted(t, key=lambda r: (r[0], r[1], key(r)))] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {n: [k for k in nodes if len(k) == len(n) + 1 and k[: len(n)] == n] for n in nodes}

    def folded(n):
        mine = (len(nodes[n]) - 1) * (len(n[-1][1].encode().split()) if n else 0)
        parts = [folded(k) for k in children[n]]
        return sum(p[0] for p in parts) or 1, mine + sum(p[1] for p in parts)

    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if made[c] == n)))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children[n]), *folded(n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 1, "k", "x") for r in rows], SCHEMA)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op13_conversation_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF2}/conversations.parquet'")
    cursor = duck.execute(oracles.oracle_sql()["op13_conversation_trie"])
    names = [x[0] for x in cursor.description]
    df = queries.op13_conversation_trie(spark, SF2)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a  c\n", "", None])) for c in [*range(-25, 45), 60] for t in range(rnd.randrange(1, 6))]
    rnd.shuffle(rows)
    assert found(spark, tmp_path, rows) == brute(rows)


def test_edges(spark, tmp_path):
    """Null turns first, ties, repeated rows, rows without an id, copies by the dozen, a conversation of many turns, one very long text."""
    rows = [(0, None, "user", "first"), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "bot", "x"), (None, 1, "user", "lost"), (5, 3, None, None), (3, 1, "user", "only"), (7, 0, "user", "word " * 100_000)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(3)]
    rows += [(200, t, "user", f"turn {t % 7}") for t in range(500)] + [(201, 0, "user", "turn 0")]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_hash_is_not_fooled_by_the_place_of_the_cut(spark, tmp_path):
    rows = [(20, 0, "a", "bc"), (40, 0, "ab", "c"), (60, 0, "", "abc"), (80, 0, "a", "bc")]
    got = found(spark, tmp_path, rows)
    assert got == brute(rows) and len(got) == 4


def test_no_conversations(spark, tmp_path):
    assert found(spark, tmp_path, []) == []


@pytest.mark.parametrize("chunk", [1, 40, 16_384])
def test_digests_of_many_members(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    members = {(1, 2): range(-3, 3000), (1, 3): [5], (-7, 2): range(10, 400, 3)}
    df = spark.createDataFrame([(c, d, m) for (c, d), all_ in members.items() for m in all_], "conv_id long, depth int, member long").repartition(5)
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in conversation_trie.ends_digest(df).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in members.items()}
