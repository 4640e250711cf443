"""Trie of conversation prefixes; what lies below each node comes from an Euler tour ranked as a list."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulcro.llm.common import number_within, store, text_or_empty

#: Turns of a conversation that one window takes; longer conversations are summed over such blocks.
BLOCK_TURNS = 512
#: Conversation numbers that are put together in one row before they are hashed in order.
CHUNK_IDS = 1024
#: The rest of a list is walked by one task once contraction has made it this short.
WALKED = 4096
#: Characters of a text that decide among turns of one number and role, before its digest does.
TIE_CHARS = 32

#: A prefix: its length and 128 bits of its turns.
KEY = ["depth", "k1", "k2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, bytes) of every turn: place 0, 1, ... by turn, null turns first.

    Null roles and texts are empty. Turns of one number go by role, text (its first characters, then
    its digest); equal ones all count. Rows without conv_id belong to no conversation and are left
    out, other columns are ignored. Texts are not shuffled, only their digests; no window holds a
    whole conversation.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), F.left(text, F.lit(TIE_CHARS)).alias("head"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("second"), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = ["conv_id", "turn", "role", "head", "t1", "t2"]
    return number_within(rows, "conv_id", order, "place").select("conv_id", "place", "t1", "t2", "bytes")


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds the key of the prefix that ends in each turn, and the turn's own part (x1, x2) of it.

    A key is the exclusive or of hashes of (depth, turn), so it is summed inside blocks of a
    conversation and carried over them, and the parent's key is the key without the own part.
    """
    block = F.floor((F.col("depth") - 1) / BLOCK_TURNS)
    rows = turns.withColumns({
        "block": block, "x1": F.xxhash64("depth", "t1", "t2"), "x2": F.xxhash64(F.lit("second"), "depth", "t2", "t1"),
    })
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("conv_id", "block")
        .agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
        .select("conv_id", "block", F.bit_xor("s1").over(before).alias("c1"), F.bit_xor("s2").over(before).alias("c2"))
        .where("block > 0")
    )
    rows = rows.withColumns({"k1": F.bit_xor("x1").over(inside), "k2": F.bit_xor("x2").over(inside)})
    rows = rows.join(carried, ["conv_id", "block"], "left")
    for k, c in (("k1", "c1"), ("k2", "c2")):
        rows = rows.withColumn(k, F.col(k).bitwiseXOR(F.coalesce(F.col(c), F.lit(0).cast("long"))))
    return rows.drop("block", "c1", "c2")


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the pieces of each key, in the order in which they come, a piece at a time."""
    now, running = None, None
    for batch in batches:
        done = []
        for *key, piece in batch.itertuples(index=False):
            if key != now:
                if now is not None:
                    done.append((*now, running.hexdigest()))
                now, running = key, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, running.hexdigest())], columns=[*KEY, "ends_sha256"])


def _digests_of_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending numbers of the conversations that end with each key."""
    pieces = (
        ends.groupBy(*KEY, F.floor(F.col("conv_id") / CHUNK_IDS).alias("chunk"))
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
        .repartition(*KEY)
        .sortWithinPartitions(*KEY, "chunk")
    )
    return pieces.select(*KEY, "piece").mapInPandas(_stream_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _walk(sums: Sequence[str]):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = list(batches)
        if not given:
            return
        rows = pd.concat(given, ignore_index=True)
        place = {i: k for k, i in enumerate(rows["id"].tolist())}
        following = [place.get(n) if pd.notna(n) else None for n in rows["next"].tolist()]
        weights = rows[list(sums)].to_numpy().tolist()
        at = next((k for k, p in enumerate(rows["prev"].tolist()) if pd.isna(p)), None)
        total, told = [0] * len(sums), []
        ids = rows["id"].tolist()
        while at is not None:
            told.append((ids[at], *total))
            total = [t + w for t, w in zip(total, weights[at])]
            at = following[at]
        yield pd.DataFrame(told, columns=["id", *sums])

    return walk


def rank_list(items: DataFrame, sums: Sequence[str], walked: int = WALKED) -> DataFrame:
    """(id, sums): for every item of a doubly linked list the sums of all items before it.

    ``items`` has id, prev, next (long; null at the two ends) and the long columns ``sums``. In each
    round the items whose hash is below those of both neighbours, a third of them at random, are
    spliced out: their predecessor takes their sums. One shuffle a round, of a table that shrinks in
    proportion, so all rounds together cost three of the first. When at most ``walked`` items are
    left, one task walks them; then rounds are undone, each item telling the one it took where it is.
    """
    now = store(items.select("id", "prev", "next", *sums), "list")
    levels: list[DataFrame] = []
    while now.count() > walked:
        salt = F.lit(len(levels))
        own, before, after = (F.xxhash64(c, salt) for c in ("id", "prev", "next"))
        gone = F.col("prev").isNotNull() & F.col("next").isNotNull() & (own < before) & (own < after)
        nothing = F.lit(None).cast("long")
        stays = now.where(~gone).select(
            "id", "prev", "next", nothing.alias("new_prev"), nothing.alias("new_next"), nothing.alias("took"),
            *[F.col(s).alias(f"own_{s}") for s in sums], *sums,
        )
        to_prev = now.where(gone).select(
            F.col("prev").alias("id"), nothing, nothing, nothing, F.col("next"), F.col("id"), *[nothing for _ in sums], *sums
        )
        to_next = now.where(gone).select(
            F.col("next").alias("id"), nothing, nothing, F.col("prev"), nothing, nothing, *[nothing for _ in sums], *[nothing for _ in sums]
        )
        level = (
            stays.union(to_prev)
            .union(to_next)
            .groupBy("id")
            .agg(
                F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"),
                F.coalesce(F.max("new_next"), F.max("next")).alias("next"),
                F.max("took").alias("took"),
                *[F.max(f"own_{s}").alias(f"own_{s}") for s in sums],
                *[F.sum(s).alias(s) for s in sums],
            )
        )
        now = store(level, "list")
        levels.append(now)
        now = now.select("id", "prev", "next", *sums)
    schema = ", ".join(f"{c} long" for c in ["id", *sums])
    known = now.coalesce(1).mapInPandas(_walk(sums), schema)
    for level in reversed(levels):
        told = known.join(level.select("id", "took", *[f"own_{s}" for s in sums]), "id")
        both = F.array(
            F.struct("id", *sums),
            F.struct(F.col("took").alias("id"), *[(F.col(s) + F.col(f"own_{s}")).alias(s) for s in sums]),
        )
        known = store(told.select(F.explode(both).alias("x")).select("x.*").where("id IS NOT NULL"), "ranked")
    return known


def euler_tour(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """The tour as a list: arc 2 * node enters a node, 2 * node + 1 leaves it.

    ``nodes`` has node, family, sibling (0, 1, ... within the family) and the weights; ``families``
    has each parent's node with its first and last child.
    """
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    following = nodes.select("family", (F.col("sibling") - 1).alias("sibling"), F.col("node").alias("right"))
    links = [
        families.where("first IS NOT NULL").select(enter("node"), enter("first")),
        families.where("first IS NOT NULL").select(leave("last"), leave("node")),
        families.where("first IS NULL").select(enter("node"), leave("node")),
        nodes.join(following, ["family", "sibling"]).select(leave("node"), enter("right")),
    ]
    none = F.lit(None).cast("long")
    rows = families.select(
        enter("node").alias("id"), none.alias("prev"), none.alias("next"), F.col("leaf").alias("leaves"), "saved"
    )
    zero = F.lit(0).cast("long")
    for link in links:
        link = link.toDF("a", "b")
        rows = rows.union(link.select("a", none, "b", zero, zero)).union(link.select("b", "a", none, zero, zero))
    return rows.groupBy("id").agg(
        F.max("prev").alias("prev"), F.max("next").alias("next"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )


def prefix_trie(turns: DataFrame, conversations: DataFrame, walked: int = WALKED) -> DataFrame:
    """Nodes of the trie of all prefixes of conversations, from the empty one, each with what lies below it.

    ``turns`` has conv_id, depth (1, 2, ... without gaps), n_turns of its conversation, two digests
    t1 and t2 of the turn and the bytes of its text; ``conversations`` has each conv_id once, not
    null, with its n_turns (0 without turns: it belongs to the root only). A result row is a node:
    conv_id (its least member) and depth, which name it, parent_conv_id (root: null), n_convs,
    n_children, n_leaves and saved_tokens (sums over its subtree: childless nodes, and (n_convs - 1)
    * bytes of the last text) and ends_sha256 (of the ascending numbers of the conversations that
    end here, joined by commas). No conversations give no nodes.

    Prefixes are told apart by 128 bits. Siblings are numbered without a window over them, the tour
    is linked by unique keys and ranked as a list, so no step holds a node's children or members
    together; the one join with a hot side (children with their parent) has one row a key on its
    other side and can be split by adaptive execution.
    """
    keyed = store(prefixes(turns), "prefixes")
    zero = F.lit(0).cast("long")
    found = keyed.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        *[F.max(c).alias(c) for c in ("bytes", "x1", "x2")],
    )
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[zero.alias(k) for k in KEY], "n_convs", "conv_id", *[zero.alias(c) for c in ("bytes", "x1", "x2")])
    found = store(found.select(*root.columns).unionByName(root), "nodes")
    up = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                      F.col("conv_id").alias("parent_conv_id"))
    below = found.withColumns({
        "p1": F.col("k1").bitwiseXOR(F.col("x1")), "p2": F.col("k2").bitwiseXOR(F.col("x2")),
    }).join(up, ["depth", "p1", "p2"], "left")
    linked = store(below.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "bytes"), "linked")
    linked = linked.withColumn("family", F.struct("depth", "parent_conv_id"))
    nodes = number_within(linked, "family", ["family", "conv_id"], "sibling")
    nodes = store(nodes.withColumn("node", F.monotonically_increasing_id()), "numbered")
    ends_of = nodes.where("depth > 0").groupBy("family").agg(
        F.min_by("node", "sibling").alias("first"), F.max_by("node", "sibling").alias("last"), F.count("*").alias("n_children")
    )
    ends_of = ends_of.select((F.col("family.depth") - 1).alias("depth"), F.col("family.parent_conv_id").alias("conv_id"),
                             "first", "last", "n_children")
    families = nodes.join(ends_of, ["depth", "conv_id"], "left").withColumns({
        "n_children": F.coalesce("n_children", zero),
        "leaf": F.col("first").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"),
    })
    families = store(families.drop("family", "sibling", "bytes"), "families")
    ranked = rank_list(euler_tour(nodes, families), ["leaves", "saved"], walked)
    entered = F.col("id") % 2 == 0
    between: Column = F.sum(F.when(entered, -F.col("leaves")).otherwise(F.col("leaves")))
    totals = ranked.groupBy(F.floor(F.col("id") / 2).alias("node")).agg(
        between.alias("n_leaves"),
        F.sum(F.when(entered, -F.col("saved")).otherwise(F.col("saved"))).alias("saved_tokens"),
    )
    ends = keyed.where("depth = n_turns").select(*KEY, "conv_id").unionByName(
        conversations.where("n_turns = 0").select(*[zero.alias(k) for k in KEY], "conv_id")
    )
    return (
        families.join(totals, "node")
        .join(_digests_of_ends(ends), KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
