import random
from collections import defaultdict

import numpy as np
import pytest
from pulcro.llm import jaccard_join
from pulcro.llm.jaccard_join import runs_needed, similar_documents


def brute(documents):
    """(doc_id, class, copies, links) of (doc_id, text) by comparing all pairs that share a shingle."""
    sets = []
    for _, text in documents:
        words = (text or "").lower().split()
        width = min(5, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                shared[a, b] += 1
    label = list(range(len(sets)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    links, copies = [0] * len(sets), [0] * len(sets)
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            for x in (a, b):
                links[x] += 1
                copies[x] += sets[a] == sets[b]
            label[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(documents):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return [
        (d, min(least[find(i)], default=None) if sets[i] else None, copies[i], links[i])
        for i, (d, _) in enumerate(documents)
    ]


def check(frame):
    documents = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    rows = similar_documents(frame).select("doc_id", "class_id", "n_copies", "n_links").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(brute(documents), key=str)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def variants(seed, n, words=60, change=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(change):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        yield " ".join(own)


def test_groups_larger_than_nodes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "NODE_SETS", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 20)
    monkeypatch.setattr(jaccard_join, "LAST_DEPTH", 3)
    texts = [t for seed in range(4) for t in variants(seed, 90)] + list(variants(9, 40, change=0))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_special_texts(spark):
    documents = [
        (1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "One  TWO"), (None, "a b c d e f"), (None, "a b c d e f"),
        (6, "same text here is it"), (6, "same text here is it"), (7, "x " * 50_000), (8, "x " * 40_000), (9, "y " * 9 + "z"),
    ]
    frame = spark.createDataFrame([(*d, "s", 5) for d in documents], "doc_id long, text string, root string, node int")
    check(frame)
    assert similar_documents(frame.limit(0)).count() == 0


def test_recall_of_runs():
    assert runs_needed(0.9, 1) == 3
    assert runs_needed(0.9999, 3) == pytest.approx(20, abs=1)


def test_sketches_estimate_the_similarity():
    random_keys = np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    agree = [
        (jaccard_join.sketch(np.sort(random_keys[i : i + 900])) == jaccard_join.sketch(np.sort(random_keys[i + 100 : i + 1000]))).mean()
        for i in range(0, 2000, 100)
    ]
    assert np.mean(agree) == pytest.approx(0.8, abs=0.05)


def test_recall_holds_down_to_the_last_depth():
    """Drawn pairs at the threshold, with one sketch for all runs as the operator has it."""
    rng = np.random.default_rng(3)
    depth, pairs = jaccard_join.LAST_DEPTH, 20_000
    runs = jaccard_join.runs_for(jaccard_join.RECALL, depth)
    agree = rng.binomial(jaccard_join.PLACES, jaccard_join.THRESHOLD, pairs)
    met = np.zeros(pairs, dtype=bool)
    for _ in range(runs):
        nodes = np.ones(pairs, dtype=int)
        for _ in range(depth):
            nodes = rng.binomial(nodes * agree, 1 / (jaccard_join.THRESHOLD * jaccard_join.PLACES))
        met |= nodes > 0
    assert met.mean() >= 0.9995
    assert jaccard_join.recall_of(runs, depth) >= jaccard_join.RECALL
    assert jaccard_join.recall_of(20, depth) < 0.993


def test_a_large_group_of_near_copies_is_not_split_again(spark, monkeypatch):
    """Rows of split nodes do not grow with the copies of a large group, and no link is lost."""
    kept, plain = [], jaccard_join.store

    def counting(df, name, *by):
        out = plain(df, name, *by)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "store", counting)
    monkeypatch.setattr(jaccard_join, "NODE_SETS", 64)
    texts = [*variants(3, 250, words=150), *(f"x{i} " * 3 + f"y{i} z" for i in range(40)), *variants(4, 8, words=150)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    first, *split = [n for name, n in kept if name == "nodes"]
    assert first > 250 * 40 and sum(split) < first / 10
