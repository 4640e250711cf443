"""Runs of repeated words against a search by brute force."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulcro.llm import periodic_runs
from pulcro.llm.queries import op11_periodic_runs


def brute(words, least):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, 2 * q):
                found.setdefault((s, length), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def searched(texts, least):
    return [sorted(r) for r in periodic_runs._search([[str(w).encode() for w in t] for t in texts], least)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5), st.integers(2, 6))
def test_equals_brute_force(texts, least):
    assert searched(texts, least) == [brute(t, least) for t in texts]


def test_periodic_texts():
    rng = random.Random(1)
    texts = []
    for period in (1, 2, 5, 13):
        unit = [rng.randrange(4) for _ in range(period)]
        texts.append([9, 8] + unit * 12 + unit[: period // 2] + [7] + unit * 3)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts += [fib[-1], []]
    assert searched(texts, 2) == [brute(t, 2) for t in texts]


def test_time_does_not_follow_the_square():
    spent = []
    for n in (20_000, 200_000):
        began = time.time()
        assert searched([[1] * n], 12) == [[(0, n, 1)]]
        spent.append(time.time() - began)
    assert spent[1] < 40 * max(spent[0], 0.05)


def test_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a " * 11), (5, "\x0ba " * 12 + "b"), (5, "\x0ba " * 12 + "b"),
        (None, "x\u00a0y z " * 6), (6, "a b c d e f " * 2 + "q " + "u v " * 6), (7, "w" * 50_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("period", F.lit(2))
    found = periodic_runs.find_runs(docs)
    assert found.columns == ["doc_id", "text", "found", "period"]
    answers = [(r["doc_id"], r["found"]) for r in found.collect()]
    told = {k: (f["n_kept"], f["n_runs"], f["start"], f["length"], f["period"], f["collapsed"][:30]) for k, f in answers}
    assert len(answers) == len(rows) and sum(k == 5 for k, _ in answers) == 2
    for k in (1, 2, 3):
        assert told[k] == (0, 0, None, None, None, "")
    assert told[4] == (11, 0, None, None, None, ("a " * 11)[:-1])
    assert told[5] == (2, 1, 0, 12, 1, "a b")
    assert told[None] == (2, 1, 0, 12, 2, "x\u00a0y z")
    assert told[6][:5] == (9, 2, 0, 12, 6) and told[7][:2] == (1, 0)
    runs = [tuple(r) for k, f in answers if k == 6 for r in f["runs"]]
    assert runs == [(0, 12, 6), (13, 12, 2)]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_plan_has_one_python_step_and_no_shuffle(spark, sf):
    plan = op11_periodic_runs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_suffix_array():
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(0, 3, 60), 60 + rng.integers(0, 2, 40)])
    owner = np.repeat([0, 1], [60, 40])
    suffixes, rank, levels = periodic_runs.suffix_ranks(words, owner)
    ends = [60, 100]
    tails = [tuple(words[i : ends[owner[i]]]) for i in range(100)]
    assert suffixes.tolist() == sorted(range(100), key=lambda i: tails[i])
    assert rank[suffixes].tolist() == list(range(100))
    shared = periodic_runs.common_prefixes(suffixes, owner, levels)
    for k in range(1, 100):
        a, b = tails[suffixes[k - 1]], tails[suffixes[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == same


@pytest.mark.parametrize("texts", [[["a"] * 12], [["a", "b"] * 9, [], ["a"] * 5]])
def test_groups_of_texts_are_answered_in_order(texts, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 6)
    answers = list(periodic_runs._answers([" ".join(t) for t in texts], 12))
    assert [a[1] for a in answers] == [len(brute(t, 12)) for t in texts]
