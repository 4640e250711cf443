import zlib
from collections import Counter

from pulcro.llm.common import number_within
from pulcro.llm.queries import op4_sharding
from pulcro.llm.sharding import Leaf, place, regular_tree, shard_documents


def test_whole_table(spark, sf):
    rows = op4_sharding(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    slots = Counter()
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        assert r["grown_shard"] in (r["shard"], 24)
    assert set(slots) <= set(range(24))


def placed(spark, tree, n=4000):
    frame = place(spark.range(n).withColumnRenamed("id", "doc_id"), tree, "shard")
    return {r["doc_id"]: r["shard"] for r in frame.collect()}


def test_shares_follow_weights_and_moves_stay_in_the_changed_subtree(spark):
    tree = [Leaf(0, 0, 0), Leaf(0, 0, 1), Leaf(0, 1, 0, 2.0), Leaf(1, 0, 0), Leaf(1, 1, 0), Leaf(1, 1, 1)]
    before = placed(spark, tree)
    counts = Counter(before.values())
    for k, leaf in enumerate(tree):
        assert abs(counts[k] / 4000 - leaf.weight / 7) < 0.03
    heavier = [leaf._replace(weight=3.0) if k == 3 else leaf for k, leaf in enumerate(tree)]
    after = placed(spark, heavier)
    moves = {(before[i], after[i]) for i in before if before[i] != after[i]}
    assert moves and all(tree[to].region == 1 for _, to in moves)
    # Outside the region that grew nothing moves but into it.
    assert all(tree[to].region == 1 and (tree[at].region == 0 or tree[to].rack == 0) for at, to in moves)


def test_regular_trees_grow_by_a_region(spark):
    for n in (8, 16, 24):
        before, after = placed(spark, regular_tree(n)), placed(spark, regular_tree(n + 1))
        assert {after[i] for i in before if after[i] != before[i]} == {n}


def test_nulls_repeated_rows_and_extra_columns(spark):
    rows = [(None, None, 1), (None, "", 2), (None, None, 3), (1, "é", 4), (1, "é", 5), (2, "x" * 100_000, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int").selectExpr("*", "7 as slot", "8 as size")
    out = shard_documents(frame, regular_tree(3)).collect()
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    assert sorted((r["shard"], r["slot"]) for r in out) == sorted(
        (s, k) for s, n in Counter(r["shard"] for r in out).items() for k in range(n)
    )
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] is None} == {(8, 0)}
    assert all(r["grown_shard"] is None for r in out)
    assert shard_documents(frame.limit(0), regular_tree(3)).count() == 0


def test_numbers_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("pulcro.llm.common.BLOCK_ROWS", 7)
    frame = spark.range(0, 1000, 1, 5).selectExpr("id % 3 as g", "(id * 7919) % 1000 as o")
    rows = number_within(frame, "g", ["o"], "k").collect()
    for g in range(3):
        own = sorted((r["o"], r["k"]) for r in rows if r["g"] == g)
        assert [k for _, k in own] == list(range(len(own)))


def test_stays_in_the_jvm(spark, sf):
    assert "Python" not in op4_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
