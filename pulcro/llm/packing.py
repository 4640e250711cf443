"""Operator 1, best-fit packing: a grouping genetic algorithm fills sequences with documents.

Documents become token pieces. Pieces as long as a sequence are sequences; the others are dealt to
shards of bounded size, and each shard to several islands. An island keeps a population of packings
of its shard. Crossover injects whole well-filled bins of one parent into the other, removes the
documents that then lie in two bins by dissolving the older bins, and best-fits the displaced ones.
After each epoch the best packing of an island migrates to its neighbour. The best of a shard wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulcro.llm.common import store, text_or_empty
from pulcro.llm.token_ids import encoder

END = 2
SHARD_ITEMS, ISLANDS, EPOCHS = 16_384, 3, 2
POPULATION, CROSSOVERS = 4, 16

ISLAND = "shard int, island int, rows binary, sizes binary, packings array<binary>"


def tokenize(docs: DataFrame, tokenizer: str, ranks: str | None, length: int, with_ids: bool) -> DataFrame:
    """One stored row per document: its tokens, the length of its first piece, a checksum a piece.

    A null text is empty and still has its end token. ``row`` numbers the input rows.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer, ranks)
        end = END.to_bytes(4, "little")
        for batch in batches:
            totals, heads, sums, pieces = [], [], [], []
            for text in batch["text"]:
                ids = own.encode(text) + end
                n = len(ids) // 4
                head = n if n <= length else (n - 1) % length + 1
                cuts = [0, *range(4 * head, 4 * n + 1, 4 * length)]
                parts = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                totals.append(n)
                heads.append(head)
                sums.append([zlib.crc32(part) for part in parts])
                if with_ids:
                    pieces.append([np.frombuffer(part, dtype="<u4").astype(np.int32) for part in parts])
            out = batch.drop(columns="text").assign(n_tokens=totals, head=heads, checksums=sums)
            yield out.assign(ids=pieces) if with_ids else out

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, n_tokens long, head int, checksums array<long>"
    slim = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    return store(slim.mapInPandas(encode, schema + (", ids array<array<int>>" if with_ids else "")), "tokens")


class Packer:
    """Packings of one shard: ``sizes`` of its items, each packing the bin of every item."""

    def __init__(self, sizes: np.ndarray, length: int, seed: int):
        self.sizes, self.length, self.random = sizes, length, np.random.default_rng(seed)
        self.order = np.argsort(-sizes, kind="stable")

    def best_fit(self, bins: np.ndarray, fill: list[int], items: np.ndarray) -> None:
        """Puts each of ``items`` into the fullest bin that takes it, in the given order."""
        length, rooms, by_room = self.length, 0, [[] for _ in range(self.length + 1)]
        for number, used in enumerate(fill):
            if 0 < used < length:
                by_room[length - used].append(number)
                rooms |= 1 << (length - used)
        for item, size in zip(items.tolist(), self.sizes[items].tolist(), strict=True):
            fits = rooms >> size
            if fits:
                # The lowest set bit is the least room that suffices.
                room = size + (fits & -fits).bit_length() - 1
                number = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, number = length, len(fill)
                fill.append(0)
            bins[item] = number
            fill[number] += size
            if room > size:
                by_room[room - size].append(number)
                rooms |= 1 << (room - size)

    def start(self, noise: float) -> np.ndarray:
        """Best fit by falling size, with sizes blurred by ``noise``."""
        blur = 1 + noise * self.random.standard_normal(len(self.sizes))
        bins = np.full(len(self.sizes), -1, dtype=np.int32)
        self.best_fit(bins, [], np.argsort(-self.sizes * blur, kind="stable"))
        return bins

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, weights=self.sizes).astype(np.int64)

    def cost(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first; among equals, the more uneven fill leaves room that is easier to use."""
        fill = self.fills(bins) / self.length
        return len(fill), -float((fill * fill).sum())

    def cross(self, into: np.ndarray, giver: np.ndarray) -> np.ndarray:
        """A child of ``into`` with well-filled bins of ``giver``."""
        fill = self.fills(giver)
        good = np.flatnonzero(fill >= self.length)
        if not len(good):
            good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
        chosen = np.zeros(len(fill), dtype=bool)
        chosen[good[self.random.random(len(good)) < 0.5]] = True
        injected = chosen[giver]
        hit = np.zeros(int(into.max()) + 1, dtype=bool)
        hit[into[injected]] = True  # bins that would hold a document twice
        kept_fill = self.fills(into)
        weak = kept_fill < self.length * (1 - 0.02 * self.random.random())
        weak[self.random.random(len(weak)) < 0.3] = False
        dissolved = hit | weak
        child = np.full(len(into), -1, dtype=np.int32)
        number = np.cumsum(~dissolved) - 1
        stays = ~injected & ~dissolved[into]
        child[stays] = number[into[stays]]
        base = int((~dissolved).sum())
        order = np.cumsum(chosen) - 1
        child[injected] = base + order[giver[injected]]
        fill = kept_fill[~dissolved].tolist() + self.fills(giver)[chosen].tolist()
        displaced = self.order[child[self.order] < 0]
        self.best_fit(child, fill, displaced)
        return child


def _evolve(length: int, epoch: int):
    def evolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                sizes = np.frombuffer(row.sizes, dtype=np.int32).astype(np.int64)
                # One seed per place: a task that runs again makes the same packing.
                packer = Packer(sizes, length, [row.shard, row.island, epoch])
                herd = [np.frombuffer(p, dtype=np.int32) for p in row.packings]
                while len(herd) < POPULATION:
                    first = not herd and row.island == 0
                    herd.append(packer.start(0.0 if first else 0.02 * (1 + row.island)))
                for _ in range(CROSSOVERS):
                    herd.sort(key=packer.cost)
                    a, b = packer.random.choice(min(3, len(herd)), 2, replace=False)
                    child = packer.cross(herd[a], herd[b])
                    if packer.cost(child) < packer.cost(herd[-1]):
                        herd[-1] = child
                herd.sort(key=packer.cost)
                out.append(row._replace(packings=[p.tobytes() for p in herd]))
            yield pd.DataFrame(out, columns=batch.columns)

    return evolve


def _collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for shard, items in zip(batch["shard"], batch["items"], strict=True):
            pairs = sorted((x["row"], x["size"]) for x in items)
            rows = np.array([p[0] for p in pairs], dtype=np.int64).tobytes()
            sizes = np.array([p[1] for p in pairs], dtype=np.int32).tobytes()
            yield pd.DataFrame(
                {"shard": shard, "island": range(ISLANDS), "rows": rows, "sizes": sizes, "packings": [[]] * ISLANDS}
            )


def _best(length: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sizes = np.frombuffer(row.sizes, dtype=np.int32).astype(np.int64)
                packer = Packer(sizes, length, [0])
                bins = min((np.frombuffer(p, dtype=np.int32) for p in row.packings), key=packer.cost)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.r_[True, np.diff(bins[order]) > 0]
                starts = ends - sizes[order]
                offsets = starts - starts[first][np.cumsum(first) - 1]
                yield pd.DataFrame(
                    {
                        "row": np.frombuffer(row.rows, dtype=np.int64)[order],
                        "bin": (np.int64(row.shard) << 20) + bins[order],
                        "offset": offsets,
                    }
                )

    return best


def assign_bins(items: DataFrame, length: int) -> DataFrame:
    """(row, bin, offset) for the stored ``items`` (row, size), sizes from 1 to ``length`` - 1."""
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    dealt = items.groupBy(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")).agg(
        F.collect_list(F.struct("row", "size")).alias("items")
    )
    state = store(dealt.mapInPandas(_collect, ISLAND).repartition("shard", "island"), "islands")
    for epoch in range(EPOCHS):
        state = store(state.mapInPandas(_evolve(length, epoch), ISLAND), f"epoch{epoch}")
        if epoch + 1 < EPOCHS:
            elite = state.select(
                "shard",
                ((F.col("island") + 1) % ISLANDS).alias("island"),
                F.slice("packings", 1, 1).alias("elite"),
            )
            state = state.join(elite, ["shard", "island"]).select(
                "shard", "island", "rows", "sizes",
                F.concat("elite", F.slice("packings", 1, POPULATION - 1)).alias("packings"),
            ).repartition("shard", "island")
    whole = state.groupBy("shard").agg(
        F.first("rows").alias("rows"),
        F.first("sizes").alias("sizes"),
        F.collect_list(F.element_at("packings", 1)).alias("packings"),
    )
    return whole.mapInPandas(_best(length), "row long, bin long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, length: int = 1024, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, with ids if asked.

    Every input row is a document of its own, repeated rows and null ids too; null and empty texts
    are one end token. A document of more than ``length`` tokens is cut into pieces of that length,
    the first may be shorter. ``ranks`` names the same vocabulary as a table of ranks, for speed.
    Other columns of the input are not read; an empty table gives an empty result.
    """
    tokens = tokenize(docs, tokenizer, ranks, length, with_ids)
    short = tokens.where(F.col("head") < length).select("row", F.col("head").alias("size"))
    bins = store(assign_bins(short, length), "bins").select(F.col("row").alias("__row"), "bin", "offset")
    parts = tokens.select(
        "row", "doc_id", "head",
        F.posexplode(F.arrays_zip("checksums", "ids") if with_ids else F.arrays_zip("checksums")).alias("piece", "part"),
    )
    fields = [
        "doc_id",
        "piece",
        F.when(F.col("piece") == 0, 0).otherwise(F.col("head") + (F.col("piece") - 1) * F.lit(length).cast("long")).alias("start"),
        F.when(F.col("piece") == 0, F.col("head")).otherwise(length).cast("long").alias("length"),
        F.col("part.checksums").alias("ids_crc32"),
    ] + ([F.col("part.ids").alias("ids")] if with_ids else [])
    full = parts.where((F.col("piece") > 0) | (F.col("head") == length)).select(
        # Odd numbers, so that they differ from those of the packed bins.
        *fields, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    first = parts.where((F.col("piece") == 0) & (F.col("head") < length)).join(bins, F.col("row") == F.col("__row"))
    return full.unionByName(first.select(*fields, (F.col("bin") * 2).alias("sequence_id"), "offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces packed ``with_ids``: the token ids of each whole sequence."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
