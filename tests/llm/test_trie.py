import hashlib
import random
import re
import zlib

import duckdb
import pytest

from haltbook.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def by_hand(rows):
    """The trie as nested dictionaries of member lists."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def saved(p):
        return (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0

    total = {}
    for p in sorted(members, key=len, reverse=True):
        below = [total[q] for q in children.get(p, [])]
        total[p] = (sum(x[0] for x in below) or 1, saved(p) + sum(x[1] for x in below))
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), len(children.get(p, [])), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def rows_of(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(docs, **settings).collect()), key=lambda r: (r[1], r[0]))


def conversations(seed, n, most=7):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-30, 4 * n), n):
        for t in range(rng.randrange(1, most)):
            out.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]) if rng.random() < 0.2 else "user", rng.choice(["a", "b c", None, "", "d e\tf", "é"][: rng.randrange(1, 7)])))
    out += [(None, 1, "user", "lost"), (5, 3, "user", "same"), (5, 3, "user", "same"), (5, 3, None, "same")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("settings", [{}, {"convs": 2, "turns": 4}])
def test_against_brute_force(spark, settings):
    rows = conversations(1, 60)
    assert rows_of(spark, rows, **settings) == by_hand(rows)


def test_long_conversations_in_spans(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 3)
    monkeypatch.setattr(trie, "CHUNK", 2)
    rows = conversations(2, 25, most=5)
    for c in (400, 401, 402, 403, 460):  # of one path, nested: each goes on where another ends
        rows += [(c, t, "user", "go" if t < 9 + 4 * (c % 20) else f"own {c} {t}") for t in range(30 - c % 7)]
    rows += [(1000 + c, t, "user", "twin") for c in range(12) for t in range(7)]
    assert rows_of(spark, rows, convs=3) == by_hand(rows)


def test_nested_paths(spark):
    """Conversation i shares i turns with the one before, so that paths hang on paths."""
    rows = [(20 * i, t, "u", f"w{min(t, 10**6)} of" if t < i else f"own {i}") for i in range(40) for t in range(i + 2)]
    assert rows_of(spark, rows) == by_hand(rows)


def test_many_children_of_one_node(spark):
    rows = [(20 * i, t, "u", f"{i} {t}" if t or i % 3 == 0 else "hot start") for i in range(3300) for t in range(2)]
    assert rows_of(spark, rows) == by_hand(rows)


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, t, "u", f"t{t % 5}") for t in range(6000)] + conversations(3, 10)
    assert rows_of(spark, rows) == by_hand(rows)


def test_empty_tables_and_turnless_conversations(spark):
    assert rows_of(spark, []) == [] and rows_of(spark, [(None, 1, "u", "t")]) == []
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(lone, 1, "u", "gone"), (lone, 2, "u", "gone too")]
    assert rows_of(spark, rows) == by_hand(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        want = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.oracle_sql()})").fetchall(), key=lambda r: (r[1], r[0]))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(spark.read.parquet(path)).collect()), key=lambda r: (r[1], r[0]))
    assert got == want
