"""Operator 4, sharding: a hierarchical weighted hash tree places documents in shards.

A shard lies in a rack, a rack in a region. A document descends the three levels; at each one every
child draws ``-ln(u) / weight`` from a hash of (path of the child, document id) and the least draw
wins, so a child gets its share by weight. A weight that changes alters only the draws of that child:
documents move into a subtree whose weight grows (out of one whose weight shrinks) and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulcro.llm.common import number_within, text_or_empty


class Leaf(NamedTuple):
    """One shard of the tree: its place at each level and its weight."""

    region: int
    rack: int
    slot: int
    weight: float = 1.0


def regular_tree(shards: int, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """Shards of equal weight, filling rack after rack and region after region.

    A shard that opens a region takes rows only into itself, as with the 25th of the default shape;
    one that joins an open rack also moves rows among the shards of its own region.
    """
    return [
        Leaf(k // (racks * per_rack), k // per_rack % racks, k % per_rack) for k in range(shards)
    ]


def _draw(doc: Column, path: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(path, F.lit("|"), doc)), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def _choose(doc: Column, parent: Column, weights: dict[str, dict[int, float]]) -> Column:
    """Path of the child of ``parent`` with the least draw; ``weights`` by parent and child."""
    table = F.create_map(
        *[F.lit(x) for p, c in weights.items() for k, w in c.items() for x in (f"{p}/{k}", w)]
    )
    draws = []
    for child in sorted({k for c in weights.values() for k in c}):
        path = F.concat(parent, F.lit(f"/{child}"))
        weight = F.element_at(table, path)
        draws.append(
            F.when(weight > 0, F.struct(_draw(doc, path, weight).alias("d"), path.alias("p")))
        )
    return F.array_min(F.array(*draws))["p"]


def place(df: DataFrame, tree: Sequence[Leaf], name: str) -> DataFrame:
    """Adds the int ``name``: the shard of column doc_id, its position in ``tree``.

    A null id counts as an id of its own. Each level is a column of its own, so that the next level
    reads the chosen child instead of choosing again for each of its draws.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    levels: list[dict[str, dict[int, float]]] = [{}, {}, {}]
    for leaf in tree:
        path = "t"
        for level, step in enumerate(leaf[:3]):
            children = levels[level].setdefault(path, {})
            children[step] = children.get(step, 0.0) + leaf.weight
            path = f"{path}/{step}"
    at = F.lit("t")
    for level, weights in enumerate(levels):
        df = df.withColumn(f"__at{level}", _choose(doc, at, weights))
        at = F.col(f"__at{level}")
    numbers = F.create_map(
        *[F.lit(x) for k, leaf in enumerate(tree) for x in ("t/" + "/".join(map(str, leaf[:3])), k)]
    )
    placed = df.withColumn(name, F.element_at(numbers, at).cast("int"))
    return placed.drop(*[f"__at{level}" for level in range(3)])


def shard_documents(
    docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf] | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, with ``grown``, the shard in that tree.

    ``size`` is the UTF-8 length of the text plus 8, a null text has none and the checksum 0; ``slot``
    counts the rows of a shard from 0 without gaps, by document id (null first), then size and
    checksum. Rows with one id lie in one shard, repeated rows each get a slot; other columns of the
    input, whatever their names, are not read. An empty table gives an empty result.
    """
    text = text_or_empty()
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    slim = place(slim, tree, "shard")
    if grown:
        slim = place(slim, grown, "grown_shard")
    else:
        slim = slim.withColumn("grown_shard", F.lit(None).cast("int"))
    return number_within(slim, "shard", ["doc_id", "size", "text_crc32"], "slot")
