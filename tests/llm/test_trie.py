import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from voxframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, shard int"


def turns_of(cases):
    return [(c, n, r, t, "extra", 1) for c, turns in cases.items() for n, r, t in turns]


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, n, r, t, *_ in rows:
        if c is not None:
            own[c].append((-1 if n is None else n, digest(r, t), (r or "", t or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, found in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(found) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, found in members.items():
        ends = ",".join(str(c) for c in found if len(paths[c]) == len(p))
        out.append((found[0], len(p), members[p[:-1]][0] if p else None, len(found), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CASES = {0: [(0, "user", "hi"), (1, "assistant", "ho")], 1: [(0, "user", "other"), (1, "assistant", "way")], 2: [(None, None, None), (5, "user", "é😀")],
         3: [(1, "user", "same"), (1, "user", "same"), (1, "tool", "same")], 7: [(0, "user", "no base")], 2048: [(n, "user", f"turn {n % 7}") for n in range(300)],
         -3: [(0, "user", "below zero")], 1_000_000_005: [(0, "user", "x" * 200_000)], None: [(0, "user", "nobody's")]}
CASES |= {c: [(0, "user", "hi"), (1, "assistant", "ho")] for c in range(10, 200)}                            # copies, some over base turns
CASES |= {c: [(n, "ua"[n % 2], f"{'common' if n < c % 6 else c}") for n in range(c % 11 + 1)] for c in range(3000, 3300)}


@pytest.mark.parametrize("bits", [trie.SHARD_BITS, 3])
def test_nodes_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(trie, "SHARD_BITS", bits)
    rows = turns_of(CASES) + turns_of({3: CASES[3]})
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_sql_agrees(spark):
    conversations = spark.createDataFrame([r for r in turns_of(CASES) if r[0] is None or r[0] >= 0], SCHEMA).toArrow()  # noqa: F841
    wanted = duckdb.sql(trie.trie_sql()).fetchall()
    assert sorted(wanted, key=str) == brute(turns_of({c: t for c, t in CASES.items() if c is None or c >= 0}))


def test_empty_table_and_turnless_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    short = next(c for c in range(6, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)  # its base is absent, its own turn is cut
    got = trie.prefix_trie(spark.createDataFrame(turns_of({short: [(0, "user", "gone")]}), SCHEMA)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(short, 0, 1, 0, 1, 0)]
    assert got[0].ends_sha256 == hashlib.sha256(str(short).encode()).hexdigest()
