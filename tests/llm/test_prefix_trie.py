"""Prefix trie: against nested dictionaries, long and repeated conversations, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from pairforge.llm import prefix_trie as P
from pairforge.llm.oracles import OP13_SQL
from pairforge.operators import skew

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())
            convs[c].append((key, (role, text)))
    turns = {c: [t for _, t in sorted(x)] for c, x in convs.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def trie(convs):
    """The definition, node by node."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        path = tuple(convs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids[node]
        leaves[node] = sum(leaves[k] for k in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in below)
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(map(str, ends.get(n, [])))))
        for n, m in members.items()
    )


def got(frame):
    assert frame.columns == COLUMNS and {t for c, t in frame.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(tuple(r) for r in frame.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def random_rows(seed, n, alphabet, most):
    draw, rows = random.Random(seed), []
    for c in draw.sample(range(3 * n), n):
        for t in range(draw.randrange(0, most)):
            rows.append((c, t * draw.randrange(1, 3), draw.choice(("user", "user", None)), draw.choice(alphabet)))
    return rows


@pytest.mark.parametrize("seed, alphabet, most", [(1, ["a"], 14), (2, ["a", "é", ""], 11), (3, ["x", None], 30)])
def test_against_the_definition(spark, seed, alphabet, most):
    rows = random_rows(seed, 60, alphabet, most)
    assert got(P.conversation_trie(frame(spark, rows))) == trie(rebuilt(rows))


def test_sql_on_random_rows(spark):
    rows = random_rows(4, 50, ["a", "bé", None], 12) + [(-7, 0, "u", "a"), (-5, 0, "u", "a"), (-5, None, "u", "b"), (None, 1, "u", "a")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall())
    assert want == trie(rebuilt(rows))
    assert got(P.conversation_trie(frame(spark, rows))) == want


def test_hot_prefixes_are_salted(spark, monkeypatch):
    """Common first turns, copies, and long conversations that part late, with almost every key called hot."""
    monkeypatch.setattr(skew, "TARGET_ROWS", 2)
    common = [("user", f"turn {i}") for i in range(9)]
    convs = {c: common + [("user", str(c % 7))] * (c % 4) for c in range(40)} | {100 + c: common[:5] for c in range(30)} | {200: []}
    turns = [(c, len(x), p, hashlib.sha256(repr(t).encode()).digest(), len(t[1])) for c, x in convs.items() for p, t in enumerate(x)]
    rows = spark.createDataFrame(turns, "conv_id long, n_turns long, pos long, digest binary, n_bytes long")
    ids = spark.createDataFrame([(c, len(x)) for c, x in convs.items()], "conv_id long, n_turns long")
    assert got(P.prefix_trie(rows, ids)) == trie(convs)


def test_long_conversations(spark):
    """More than two pieces, equal until late."""
    long = [("u", f"{i % 13}") for i in range(2 * P.PIECE + 9)]
    convs = {1: long, 2: long[:-3], 3: long[: P.PIECE], 4: long[: P.PIECE + 1] + [("u", "other")], 5: long[:6]}
    rows = [(5 * c, i, r, t) for c, x in convs.items() for i, (r, t) in enumerate(x)]
    expect = rebuilt(rows)
    frame_ = P.conversation_trie(frame(spark, rows))
    # The definition compares whole paths; here the few conversations are walked side by side.
    want = {(c, d): t for c, path in expect.items() for d, t in enumerate(path, 1)}
    seen = {(r.conv_id, r.depth): r for r in frame_.collect()}
    nodes, members = {}, defaultdict(list)
    for c in sorted(expect):
        state = b""
        for d, t in enumerate(expect[c], 1):
            state = hashlib.sha256(state + repr(t).encode()).digest()
            members[state].append(c)
            nodes[state] = d
    assert len(seen) == len(members) + 1
    for state, m in members.items():
        row = seen[m[0], nodes[state]]
        assert row.n_convs == len(m)
        ends = [c for c in m if len(expect[c]) == nodes[state]]
        assert row.ends_sha256 == sha(",".join(map(str, ends)))
    assert seen[5, 0].saved_tokens == sum((len(m) - 1) * len(want[m[0], nodes[s]][1].encode()) for s, m in members.items())


def test_odd_rows(spark):
    one = [(3, None, None, None), (3, None, None, None), (3, 5, "u", "x" * 1_000_000), (None, 1, "u", "t"), (3, 5, "u", "x" * 1_000_000)]
    wide = frame(spark, one).selectExpr("*", "1 AS depth", "2 AS node", "3 AS n", "4 AS pos")
    assert got(P.conversation_trie(wide)) == trie(rebuilt(one))
    assert P.conversation_trie(frame(spark, one).limit(0)).count() == 0
    turnless = [(c, 0, "u", "a") for c in range(1, 5)]
    assert got(P.conversation_trie(frame(spark, turnless))) == trie(rebuilt(turnless))


def test_many_ends_are_hashed_in_chunks(spark):
    convs = {c: [("u", "a")] for c in range(0, 5 * P.CHUNK, 3)}
    turns = spark.range(0, 5 * P.CHUNK, 3).selectExpr("id AS conv_id", "1L AS n_turns", "0L AS pos", "unhex(sha2('a', 256)) AS digest", "1L AS n_bytes")
    assert got(P.prefix_trie(turns, turns.select("conv_id", "n_turns"))) == trie(convs)
