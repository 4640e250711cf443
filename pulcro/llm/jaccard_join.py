"""Operator 10, n-gram Jaccard join by chosen paths.

Documents become sets of word shingles; equal sets are one. Each set has a sketch of minimum hashes,
and two sketches agree at a place with the probability of their similarity. A run starts with all
sets, draws places at random (1 / threshold of them on average, the same for all sets of a node),
and a set goes to a child node for each drawn place, by its value there. Small nodes are compared by
brute force, larger ones split again; runs repeat until a pair at the threshold has met with the
target recall. Sets that met and look alike form groups; inside a group, which a pair never leaves,
the exact similarity of all pairs is computed in blocks and only counts and links per set go out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulcro.llm.common import components, sorted_groups, store, text_key, text_or_empty
from pulcro.llm.shingling import ODD, WordHashes, mix, shingles
from pulcro.session import is_small

THRESHOLD, WIDTH = 0.8, 5
PLACES = 64
#: Sketches must agree at this share of places to be compared exactly: five deviations below 0.8.
ALIKE = 0.55
RECALL = 0.9999
#: Nodes of up to so many sets are compared by brute force; at the last depth all are, in blocks.
NODE_SETS, LAST_DEPTH = 2048, 6
BLOCK_SETS = 256
_SEEDS = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * ODD) | np.uint64(1)


def runs_needed(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold meets with ``recall`` down to ``depth``.

    Each drawn place is shared with probability threshold / threshold, so shared children are
    Poisson with mean 1 and a pair survives a level as a critical branching process does.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def recall_of(runs: int, depth: int) -> float:
    """Share of the pairs at the threshold that meet in ``runs`` down to ``depth`` and look alike.

    All runs draw from one sketch, so the places at which a pair agrees are binomial and the same in
    all of them: a pair that agrees at few has less of a chance in every run.
    """
    found = 0.0
    for agree in range(math.ceil(ALIKE * PLACES), PLACES + 1):
        chance = math.comb(PLACES, agree) * THRESHOLD**agree * (1 - THRESHOLD) ** (PLACES - agree)
        alive = 1.0
        for _ in range(depth):
            # Each place that agrees is drawn with probability 1 / (THRESHOLD * PLACES).
            alive = 1 - (1 - alive / (THRESHOLD * PLACES)) ** agree
        found += chance * (1 - (1 - alive) ** runs)
    return found


def runs_for(recall: float, depth: int) -> int:
    """Least runs that reach ``recall`` down to ``depth``, with the spread of the sketches."""
    if recall_of(10**6, depth) < recall:
        raise ValueError(f"sketches of {PLACES} places cannot reach a recall of {recall}")
    runs = runs_needed(recall, depth)
    while recall_of(runs, depth) < recall:
        runs += 1
    return runs


def sketch(keys: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set, its low 32 bits."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(keys), 2048):
        np.minimum(least, (keys[at : at + 2048, None] * _SEEDS).min(0), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHashes()
    for batch in batches:
        n, first, second, sketches = [], [], [], []
        for text in batch["text"]:
            keys = shingles(text, words, WIDTH)
            n.append(len(keys))
            # Sums of mixed values name a set, whatever the order of its elements.
            first.append(int(mix(keys).sum(dtype=np.uint64).view(np.int64)))
            second.append(int(mix(keys ^ _SEEDS[0]).sum(dtype=np.uint64).view(np.int64)))
            sketches.append(sketch(keys).tobytes() if len(keys) else None)
        yield batch.drop(columns="text").assign(n=n, s1=first, s2=second, sketch=sketches)


def _children(values: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the child nodes of each sketch at its node: places drawn by hash of the node."""
    draw = mix(nodes[:, None] ^ _SEEDS)
    rows, places = np.nonzero(draw < np.uint64(int(2**64 / (THRESHOLD * PLACES))))
    return rows, mix(mix(draw[rows, places]) + values[rows, places].astype(np.uint64))


def _first_nodes(runs: int):
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * ODD)
        for batch in batches:
            values = np.frombuffer(b"".join(batch["sketch"]), dtype=np.uint32).reshape(-1, PLACES)
            sid = batch["sid"].to_numpy()
            for root in roots:
                rows, keys = _children(values, np.full(len(sid), root))
                yield pd.DataFrame({"sid": sid[rows], "node": keys.view(np.int64)})

    return first


def _hubbed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets that look like the hub of their node, once a batch and hub, and (node, sid) of those that do not."""
    for batch in batches:
        if len(batch):
            values, hubs = (
                np.frombuffer(b"".join(batch[c]), dtype=np.uint32).reshape(-1, PLACES).astype(np.uint8)
                for c in ("sketch", "hub_sketch")
            )
            near = (values == hubs).sum(1) >= ALIKE * PLACES
            links = batch.loc[near, ["sid", "hub"]].drop_duplicates()
            apart = batch.loc[~near, ["node", "sid"]]
            yield pd.concat([links[links["sid"] != links["hub"]], apart])[["node", "sid", "hub"]].astype("Int64")


def _crossed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets apart from the hub of a node and what they are connected with in a piece of it.

    All others of the piece look like the hub, so whatever looks like one of them goes to the hub.
    """
    for whole in sorted_groups(batches, "piece"):
        for _, part in whole.groupby("piece"):
            values = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint32).reshape(-1, PLACES).astype(np.uint8)
            apart, sids = part["apart"].to_numpy(), part["sid"].to_numpy()
            same = np.zeros((int(apart.sum()), len(part)), dtype=np.uint8)
            for k in range(PLACES):
                same += values[apart, k, None] == values[None, :, k]
            alike = same >= ALIKE * PLACES
            own, label = sids[apart], _labels(alike[:, apart])
            linked = alike[:, ~apart].any(1)
            left, right = np.r_[part["hub"].to_numpy()[apart][linked], own[label]], np.r_[own[linked], own]
            yield pd.DataFrame({"a": left, "b": right})[left != right]


def _next_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            values = np.frombuffer(b"".join(batch["sketch"]), dtype=np.uint32).reshape(-1, PLACES)
            rows, keys = _children(values, batch["node"].to_numpy().view(np.uint64))
            yield pd.DataFrame({"sid": batch["sid"].to_numpy()[rows], "node": keys.view(np.int64)})


def _labels(alike: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation, the first row that it is connected with."""
    n = len(alike)
    label = np.arange(n)
    while True:
        new = np.where(alike, label[None, :], n).min(1)
        new = np.minimum(new, label)
        if (new == label).all():
            return label
        label = new


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Brute force in small nodes: each set and the least set that it is connected with there."""
    for whole in sorted_groups(batches, "node"):
        sids = whole["sid"].to_numpy()
        values = np.frombuffer(b"".join(whole["sketch"]), dtype=np.uint32).reshape(-1, PLACES).astype(np.uint8)
        node = whole["node"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(node)) + 1, len(node)]
        left, right = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a == 2:
                if (values[a] == values[a + 1]).sum() >= ALIKE * PLACES:
                    left.append(sids[a : a + 1])
                    right.append(sids[a + 1 : b])
                continue
            part = values[a:b]
            same = np.zeros((b - a, b - a), dtype=np.uint8)
            for k in range(PLACES):
                same += part[:, k, None] == part[None, :, k]
            label = _labels(same >= ALIKE * PLACES)
            moved = np.flatnonzero(label != np.arange(b - a))
            left.append(sids[a + label[moved]])
            right.append(sids[a + moved])
        if left:
            edges = pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})
            if len(edges):
                yield edges


def _grouped(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def _without_hubs(large: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large nodes (node, sid, size, hub) that must be split, and edges (a, b) found in the others.

    Sets that look like the least set of their node, the hub, are connected by it and need not meet
    again. If few are apart from it, they are compared with all sets of the node, in pieces, at no more
    than the cost of a small node; so a large group of near copies costs no more than its size.
    """
    chosen = large.select(F.col("hub").alias("sid")).distinct().join(nodes, "sid")
    chosen = store(chosen.select(F.col("sid").alias("hub"), F.col("sketch").alias("hub_sketch")), "hubs")
    hubs = F.broadcast(chosen) if is_small(chosen) else chosen
    hubbed = store(
        large.join(nodes, "sid").join(hubs, "hub").select("node", "sid", "sketch", "hub", "hub_sketch")
        .mapInPandas(_hubbed, "node long, sid long, hub long"),
        "hubbed",
    )
    links = hubbed.where("node is null").select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    apart = hubbed.where("node is not null").select("node", "sid", F.lit(True).alias("apart"))
    counts = store(apart.groupBy("node").agg(F.count("*").alias("many")), "apart")
    counts = F.broadcast(counts) if is_small(counts) else counts
    few = F.col("many") * F.col("size") <= NODE_SETS**2
    told = large.join(counts, "node")
    members = told.where(few).join(apart, ["node", "sid"], "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    pieces = F.ceil(F.col("size") / NODE_SETS).cast("int")
    own = F.array(F.pmod(F.xxhash64("sid"), pieces).cast("int"))
    dealt = members.withColumn("at", F.explode(F.when(F.col("apart"), F.sequence(F.lit(0), pieces - 1)).otherwise(own)))
    dealt = dealt.select(F.xxhash64("node", "at").alias("piece"), "sid", "hub", "apart").join(nodes, "sid")
    crossed = _grouped(dealt, "piece").mapInPandas(_crossed, "a long, b long")
    edges = store(links.unionByName(crossed).distinct(), "alike")
    return store(told.where(~few).drop("many"), "large"), edges


def _alike(nodes: DataFrame, runs: int) -> DataFrame:
    """Edges (a, b) between sets that met in a node and look alike, from distinct sketches."""
    records = store(nodes.mapInPandas(_first_nodes(runs), "sid long, node long"), "nodes")
    edges = []
    for depth in range(1, LAST_DEPTH + 1):
        sizes = records.groupBy("node").agg(F.count("*").alias("size"), F.min("sid").alias("hub")).where(F.col("size") > 1)
        met = store(records.join(sizes, "node"), "met")
        small = F.col("size") <= NODE_SETS
        leaves = met.where(small).select("node", "sid")
        large = met.where(~small)
        some = not large.isEmpty()
        if some:
            large, found = _without_hubs(large, nodes)
            edges.append(found)
        if depth == LAST_DEPTH:
            # What draws cannot part is compared in pairs of blocks, so nothing is left out.
            blocks = F.ceil(F.col("size") / NODE_SETS * 2).cast("int")
            dealt = large.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("sid"), blocks).cast("int")})
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            pair = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
            leaves = leaves.unionByName(dealt.select(pair.alias("node"), "sid"))
        found = _grouped(leaves.join(nodes, "sid"), "node").mapInPandas(_stars, "a long, b long")
        edges.append(store(found.distinct(), "alike"))
        if depth == LAST_DEPTH or not some or large.isEmpty():
            break
        records = store(large.select("node", "sid").join(nodes, "sid").mapInPandas(_next_nodes, "sid long, node long"), "nodes")
    whole = edges[0]
    for each in edges[1:]:
        whole = whole.unionByName(each)
    return whole


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact similarities in a pair of blocks: links of each set, weighted by copies, and a root."""
    for whole in sorted_groups(batches, "pair"):
        pairs = whole["pair"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(pairs[1:] != pairs[:-1]) + 1, len(pairs)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = whole.iloc[a:b]
            linked = _linked([np.frombuffer(x, dtype=np.uint64) for x in part["keys"]])
            if part["two"].iloc[0]:
                block = part["block"].to_numpy()
                linked &= block[:, None] != block[None, :]
            sids, copies = part["sid"].to_numpy(), part["copies"].to_numpy()
            label = _labels(linked)
            links = linked @ copies
            rows = np.flatnonzero(links)
            yield pd.DataFrame({"sid": sids[rows], "links": links[rows], "root": sids[label[rows]]})


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs reach the threshold: common elements by products of 0/1 matrices, in columns."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((n, n), dtype=np.float32)
    for at in range(0, len(distinct), 4096):
        a, b = np.searchsorted(place, [at, at + 4096])
        held = np.zeros((n, 4096), dtype=np.float32)
        held[owner[a:b], place[a:b] - at] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= THRESHOLD * union - 1e-4
    np.fill_diagonal(linked, False)
    return linked


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHashes()
    for batch in batches:
        keys = [shingles(t, words, WIDTH).tobytes() for t in batch["text"]]
        yield batch.drop(columns="text").assign(keys=keys)


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, set_id, class_id, n_copies, n_links of every input row.

    ``n_links`` counts the other rows at a similarity of at least 0.8, copies included; ``n_copies``
    those with the same set of shingles. ``class_id`` is the least document id connected by links,
    ``set_id`` numbers the connected class. Words are lower-cased and cut at white space; texts of
    one to four words are one shingle. Null and empty texts have none: no links, a null class and
    set. Null ids are kept; a class of null ids only has a null class_id. Repeated rows are copies.
    Other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", *text_key(text_or_empty()), text_or_empty().alias("text"))
    schema = f"doc_id {kind}, t1 long, t2 long, n int, s1 long, s2 long, sketch binary"
    rows = store(slim.mapInPandas(_sketched, schema), "sketches")
    some = rows.where(F.col("n") > 0)
    sets = store(
        some.groupBy("s1", "s2", "n").agg(
            F.count("*").alias("copies"),
            F.min(F.struct("doc_id", "t1", "t2")).alias("one"),
            F.min("doc_id").alias("least"),
            F.min("sketch").alias("sketch"),
        ).withColumn("sid", F.monotonically_increasing_id()),
        "sets",
    )
    twins = store(sets.groupBy("sketch").agg(F.min("sid").alias("sid"), F.count("*").alias("many")), "twins")
    nodes = twins.select("sid", "sketch")
    equal = twins.where("many > 1").select("sketch", F.col("sid").alias("a"))
    equal = sets.select("sketch", F.col("sid").alias("b")).join(equal, "sketch").select("a", "b").where("a <> b")
    edges = equal.unionByName(_alike(nodes, runs_for(RECALL, LAST_DEPTH)))
    groups = store(components(edges), "groups")

    # Members of a group are dealt to blocks; each pair of blocks is compared once.
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "root").withColumnRenamed("node", "sid")
    blocks = F.ceil(F.col("size") / BLOCK_SETS).cast("int")
    members = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("sid"), blocks).cast("int")})
    members = store(
        members.join(sets.select("sid", "copies", "one"), "sid").select(
            "sid", "root", "blocks", "block", "copies",
            *[F.col(f"one.{c}").alias(f"m_{c}") for c in ("doc_id", "t1", "t2")],
        ),
        "members",
    )
    chosen = F.broadcast(members) if is_small(members) else members
    texts = slim.join(
        chosen,
        slim["doc_id"].eqNullSafe(members["m_doc_id"]) & (slim["t1"] == members["m_t1"]) & (slim["t2"] == members["m_t2"]),
    ).select("sid", "root", "blocks", "block", "copies", "text")
    held = store(
        texts.dropDuplicates(["sid"]).mapInPandas(
            _shingled, "sid long, root long, blocks int, block int, copies long, keys binary"
        ),
        "shingles",
    )
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.withColumns({"pair": F.concat_ws("/", "root", low, high), "two": low != high})
    compared = store(
        _grouped(dealt.select("pair", "two", "sid", "block", "copies", "keys"), "pair").mapInPandas(
            _compared, "sid long, links long, root long"
        ),
        "compared",
    )
    links = compared.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("root").alias("a"), F.col("sid").alias("b")))
    named = sets.select("s1", "s2", "n", "sid", "copies", "least")
    named = named.join(links, "sid", "left").join(classes.withColumnRenamed("node", "sid"), "sid", "left")
    named = store(named.withColumn("root", F.coalesce("root", "sid")), "classes")
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(least, "root").drop("least", "sid")
    return rows.drop("sketch").join(named, ["s1", "s2", "n"], "left").select(
        "doc_id", "t1", "t2",
        F.col("root").alias("set_id"),
        "class_id",
        (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )
