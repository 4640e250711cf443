"""Tries of conversations against plain Python; lists ranked over many rounds."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulcro.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(said):
    """Result rows from conversations as lists of (role, text)."""
    members = defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        leaf = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)]
        ends = ",".join(str(c) for c in sorted(convs) if len(said[c]) == len(key))
        rows.append((
            min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs),
            sum(len(x) == len(key) + 1 and x[: len(key)] == key for x in members), len(leaf),
            sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    said = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        said[c] = own.get(base, [])[:h] + turns[h:]
    return said


def given(rng, n):
    rows = []
    for c in [rng.randrange(-20, 4 * n) for _ in range(n)]:
        for turn in range(rng.randrange(12)):
            rows.append((c, turn if rng.random() > 0.05 else None, rng.choice(["user", "bot", None]), rng.choice(["a", "é", "long text", None])))
    return rows


@pytest.mark.parametrize("walked", [3, 4096])
def test_trie_equals_plain_python(spark, walked):
    rng = random.Random(4)
    rows = given(rng, 60)
    rows += rows[:7] + [(None, 1, "user", "x")] + [(9001 + k, 0, "system", "same") for k in range(30)]
    rows += [(7000, t, "user", "turn %d" % (t % 3)) for t in range(60)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).withColumn("n", F.lit("x"))
    turns = prefix_trie.store(prefix_trie.numbered_turns(table.repartition(4)), "turns")
    found = prefix_trie.prefix_trie(*queries._rebuilt(turns), walked)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rebuilt(rows))


def test_long_conversations_go_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    rng = random.Random(6)
    rows = [(c, t, "user", rng.choice("ab") if t == 5 + c else "x") for c in range(10) for t in range(23)]
    rows += [(c, t, "user", "x") for c in range(40, 60) for t in range(9)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    found = prefix_trie.prefix_trie(*queries._rebuilt(prefix_trie.store(turns, "turns")))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rebuilt(rows))


def test_empty_table(spark):
    turns = prefix_trie.store(prefix_trie.numbered_turns(spark.createDataFrame([], SCHEMA)), "turns")
    assert prefix_trie.prefix_trie(*queries._rebuilt(turns)).count() == 0


def test_list_ranks(spark):
    n = 2000
    order = list(range(n))
    random.Random(8).shuffle(order)
    rows = [
        (x, order[k - 1] if k else None, order[k + 1] if k + 1 < n else None, 1, x)
        for k, x in enumerate(order)
    ]
    items = spark.createDataFrame(rows, "id long, prev long, next long, one long, w long")
    found = {r["id"]: (r["one"], r["w"]) for r in prefix_trie.rank_list(items, ["one", "w"], walked=20).collect()}
    total = 0
    for k, x in enumerate(order):
        assert found[x] == (k, total)
        total += x
