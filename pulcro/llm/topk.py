"""Operator 7, exact top-k search: norm-bucketed retrieval of the largest inner products.

Vectors are sorted by length and packed into buckets of bounded size, the longest first. The first
buckets give each query a lower bound of its k-th score. Every other bucket turns that bound into a
local cosine threshold, bound / (length of the query * longest vector): above 1 the pair is skipped;
if it is high, candidates are those whose value in the query's largest coordinate can still reach
it; otherwise those long enough. Candidates are verified by the exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulcro.llm.common import store

BUCKET_ROWS, QUERY_ROWS = 4096, 256
#: Local cosine thresholds from here on prune by coordinate, lower ones by length.
COORDINATE_FROM = 0.5
SLACK = 1e-9
PACKED = "first_row long, n long, longest double, ids binary, known binary, rows binary, dim int, vectors binary"
HITS = "query_row long, query_id long, vec_row long, vec_id long, score long"


def quantise(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """(row, vec_id, v, length) with v = floor(scale * x); rows with null or non-finite parts go."""
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    whole = embeddings.where(F.col("embedding").isNotNull() & finite)
    return whole.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    ).withColumn(
        "length",
        F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))),
    )


def _pack(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                dim = max((len(v) for v in part["v"]), default=0)
                vectors = np.zeros((len(part), dim), dtype=np.int64)
                for k, v in enumerate(part["v"]):
                    vectors[k, : len(v)] = v
                ids = part["vec_id"]
                yield pd.DataFrame(
                    {
                        "first_row": [int(part["row"].iloc[0])],
                        "n": [len(part)],
                        "longest": [float(part["length"].max())],
                        "ids": [ids.fillna(0).to_numpy(dtype=np.int64).tobytes()],
                        "known": [ids.notna().to_numpy().tobytes()],
                        "rows": [part["row"].to_numpy(dtype=np.int64).tobytes()],
                        "dim": [dim],
                        "vectors": [vectors.tobytes()],
                    }
                )

    return pack


def _packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most ``size`` vectors, numbered by falling length."""
    order = [F.col("length").desc(), "row"]
    blocks = store(vectors.orderBy(*order).mapInPandas(_pack(size), PACKED), name)
    numbers = blocks.select(
        "first_row",
        "longest",
        "n",
        (F.row_number().over(Window.orderBy(F.col("longest").desc(), "first_row")) - 1).alias(name),
    )
    return blocks.drop("n", "longest").join(numbers, "first_row").withColumnRenamed("first_row", f"{name}_first")


def _unpack(ids, known, rows, dim, vectors):
    rows = np.frombuffer(rows, dtype=np.int64)
    return (
        np.frombuffer(ids, dtype=np.int64),
        np.frombuffer(known, dtype=bool),
        rows,
        np.frombuffer(vectors, dtype=np.int64).reshape(len(rows), dim),
    )


def _wider(a: np.ndarray, dim: int) -> np.ndarray:
    return a if a.shape[1] == dim else np.pad(a, ((0, 0), (0, dim - a.shape[1])))


def _products(q: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products; doubles hold them as long as ``bound`` does."""
    if bound < 2**52:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ v.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _search(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                yield _search_pair(pair, k)

    return search


def _search_pair(pair, k: int) -> pd.DataFrame:
    qid, _, qrow, q = _unpack(pair.q_ids, pair.q_known, pair.q_rows, pair.q_dim, pair.q_vectors)
    vid, vknown, vrow, v = _unpack(pair.ids, pair.known, pair.rows, pair.dim, pair.vectors)
    dim = max(q.shape[1], v.shape[1])
    q, v = _wider(q, dim), _wider(v, dim)
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    v_len = np.sqrt((v.astype(np.float64) ** 2).sum(1))  # falls along the bucket
    floor = np.frombuffer(pair.floors, dtype=np.float64) if pair.floors is not None else np.full(len(q), -np.inf)
    reach = q_len * (v_len[0] if len(v_len) else 0.0)
    local = np.where(floor > 0, floor / np.maximum(reach, 1e-300), -np.inf)
    live = np.flatnonzero(local <= 1 + SLACK)
    steep = [i for i in live if local[i] >= COORDINATE_FROM]
    flat = [i for i in live if local[i] < COORDINATE_FROM]
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    bound = float(q_len.max(initial=0.0)) * float(v_len.max(initial=0.0))
    if steep:
        unit = v / np.maximum(v_len, 1e-300)[:, None]
        focus = np.abs(q[steep]).argmax(1)
        sorted_by = {f: np.argsort(unit[:, f], kind="stable") for f in set(focus.tolist())}
        columns = {f: unit[o, f] for f, o in sorted_by.items()}
        for i, f in zip(steep, focus.tolist(), strict=True):
            c, t = q[i, f] / q_len[i], min(local[i], 1.0)
            spread = np.sqrt(max((1 - t * t) * (1 - c * c), 0.0)) + 1e-7
            low, high = c * t - spread, c * t + spread
            # The angle around the query may include the axis itself.
            if t <= c:
                high = 1.0
            if t <= -c:
                low = -1.0
            order, column = sorted_by[f], columns[f]
            at = order[np.searchsorted(column, low, "left") : np.searchsorted(column, high, "right")]
            if len(at):
                out.append((i, at, _products(q[i : i + 1], v[at], bound)[0]))
    if flat:
        need = np.where(floor[flat] > 0, floor[flat] / np.maximum(q_len[flat], 1e-300), 0.0)
        n = np.searchsorted(-v_len, -need * (1 - SLACK), "right")
        n = np.where(floor[flat] > 0, n, len(v))
        products = _products(q[flat], v[: int(n.max())], bound)
        for row, (i, m) in enumerate(zip(flat, n.tolist(), strict=True)):
            if m:
                out.append((i, np.arange(m), products[row, :m]))
    places, found, scores = [], [], []
    for i, at, score in out:
        good = (score >= floor[i]) & (vrow[at] != qrow[i])
        at, score = at[good], score[good]
        if len(at) > k:
            # All that tie with the k-th stay: the smaller id is chosen at the end.
            least = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= least], score[score >= least]
            best = np.lexsort((vid[at], ~vknown[at], -score))[:k]
            at, score = at[best], score[best]
        places.append(np.full(len(at), i))
        found.append(at)
        scores.append(score)
    # One frame for the pair: frames a query cost more than the products.
    none = [np.empty(0, np.int64)]
    place, at, score = (np.concatenate(x or none) for x in (places, found, scores))
    return pd.DataFrame(
        {
            "query_row": qrow[place],
            "query_id": qid[place],
            "vec_row": vrow[at],
            "vec_id": pd.arrays.IntegerArray(vid[at].copy(), ~vknown[at]),
            "score": score,
        }
    )


def top_k(embeddings: DataFrame, query_step: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each query, ties to smaller ids.

    Queries are the rows whose vec_id is divisible by ``query_step``; candidates all rows but the
    query's own, so a repeated row is a candidate of its twin. Rows with a null id are candidates
    only and come last among ties; shorter vectors count as filled up with zeros. Vectors that are
    null or hold null or non-finite parts take no part. Other columns are not read.
    """
    best_first = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("vec_row")]
    vectors = store(quantise(embeddings), "vectors")
    buckets = store(_packed(vectors, BUCKET_ROWS, "bucket"), "buckets")
    queries = store(
        _packed(vectors.where(F.col("vec_id") % query_step == 0), QUERY_ROWS, "block")
        .withColumnsRenamed({c: f"q_{c}" for c in ("ids", "known", "rows", "dim", "vectors", "n", "longest")}),
        "queries",
    )
    sizes = buckets.select("bucket", "n", "longest")
    so_far = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    # The buckets before k + 1 vectors are seen, and the one that completes them.
    sizes = sizes.withColumn("seed", F.coalesce(so_far, F.lit(0)) <= k)
    counts = sizes.agg(F.count("*").alias("n"), F.count_if("seed").alias("seeds")).first()
    every = F.sequence(F.lit(0), F.lit(max(counts["n"] - 1, 0)))
    pairs = queries.select("block", F.explode(every).alias("bucket")).join(sizes.drop("n"), "bucket")

    def searched(chosen: DataFrame, blocks: DataFrame) -> DataFrame:
        whole = chosen.join(blocks, "block").join(buckets.drop("n", "longest"), "bucket")
        fields = ["q_ids", "q_known", "q_rows", "q_dim", "q_vectors", "floors", "ids", "known", "rows", "dim", "vectors"]
        return whole.select(*fields).mapInPandas(_search(k), HITS)

    no_floor = queries.withColumn("floors", F.lit(None).cast("binary"))
    seeds = store(searched(pairs.where("seed").select("block", "bucket"), no_floor), "seeds")
    ranked = F.row_number().over(Window.partitionBy("query_row").orderBy(*best_first))
    kth = seeds.withColumn("rank", ranked).where(F.col("rank") == k).select("query_row", "score")
    floors = store(
        queries.select("block", "q_rows").mapInPandas(_rows_of, "block long, place int, query_row long")
        .join(kth, "query_row", "left")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("place", F.col("score").cast("double").alias("score")))).alias("f")),
        "floors",
    )
    with_floor = (
        queries.join(floors, "block")
        .withColumn("worst", F.array_min(F.transform("f", lambda x: F.coalesce(x["score"], F.lit(float("-inf"))))))
    )
    # A block meets a bucket unless no query of it can reach its bound there.
    rest = (
        pairs.where("not seed")
        .join(with_floor.select("block", "worst", "q_longest"), "block")
        .where(F.col("worst") <= F.col("q_longest") * F.col("longest") * (1 + SLACK))
        .select("block", "bucket")
    )
    packed_floors = with_floor.drop("worst").mapInPandas(
        _floor_bytes, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields) + ", floors binary"
    )
    hits = seeds.unionByName(searched(rest, packed_floors))
    return (
        hits.withColumn("rank", ranked)
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, rows in zip(batch["block"], batch["q_rows"], strict=True):
            rows = np.frombuffer(rows, dtype=np.int64)
            yield pd.DataFrame({"block": block, "place": np.arange(len(rows), dtype=np.int32), "query_row": rows})


def _floor_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        scores = [
            np.array([-np.inf if x["score"] is None else x["score"] for x in f], dtype=np.float64).tobytes()
            for f in batch["f"]
        ]
        yield batch.drop(columns="f").assign(floors=scores)
