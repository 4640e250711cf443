import numpy as np
import pytest
from pulcro.llm import topk
from pulcro.llm.topk import top_k


def brute(rows, step=20, k=20):
    vectors = []
    for vec_id, x in rows:
        if x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        vectors.append((vec_id, [int(np.floor(64 * float(np.float32(c)))) for c in x]))
    out = []
    for i, (q, a) in enumerate(vectors):
        if q is None or q % step:
            continue
        scored = []
        for j, (v, b) in enumerate(vectors):
            if i != j:
                scored.append((-sum(x * y for x, y in zip(a, b, strict=False)), v is None, v or 0, v))
        for rank, (s, _, _, v) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out.append((q, rank, v, -s))
    return sorted(out, key=str)


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(frame.repartition(3), **options).collect()), key=str) == brute(rows, **options)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_buckets_of_many_lengths(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    random = np.random.default_rng(5)
    vectors = random.standard_normal((600, 12)) * np.exp(spread * random.standard_normal((600, 1)))
    vectors[:, 0] *= 5
    vectors[100:130] = vectors[100]
    check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(vectors)])


def test_few_negative_null_and_odd_vectors(spark):
    rows = [
        (0, [1.0, -1.0]), (20, [-1.0, 0.5]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
        (5, [float("inf"), 1.0]), (6, []), (7, [2.0]), (None, [3.0, 3.0]), (None, [3.0, 3.0]), (0, [1.0, -1.0]), (40, [1e6, 1e9]),
    ]
    check(spark, rows)
    check(spark, rows, k=2)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as row", "2 as n")
    assert top_k(frame.limit(0)).count() == 0
    assert top_k(frame).count() == len(brute(rows))
