"""Operator 5, benchmark decontamination by canonical templates.

Numbers, names and units of a text become typed placeholders; what is left is its template. Windows
of the templates of benchmark items are joined by hash with those of the documents. Windows that lie
on one diagonal (same distance between the places in document and item) must fill their slots
consistently: one value of the item always stands against one value of the document. So a question
with other numbers or names is still caught, and a chance likeness of templates is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulcro.llm.common import store, text_key, text_or_empty
from pulcro.llm.shingling import CACHE_WORDS, hash64, windows

WIDTH = 8
#: A window needs so many words that are no placeholders.
LITERALS = 4
#: Least share of an item's windows that a contaminated document holds.
COVERAGE = 0.5
#: Size of the filter of benchmark windows that every task gets, whatever the benchmark's size.
FILTER_BITS = 1 << 23

#: Units of measure and currency, as words of their own or right behind a number.
UNITS = frozenset(
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
    "lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon "
    "gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years usd eur gbp dollar dollars euro euros cent cents percent hz khz mhz ghz w kw kwh v a "
    "mph kmh °c °f".split()
)
LITERAL, NUMBER, NAME, UNIT, NOTHING = range(5)
#: What a placeholder of each kind hashes to.
SLOT = {k: hash64(b"slot", k) for k in (NUMBER, NAME, UNIT)}
EDGES = re.compile(r"^\W+|\W+$")
AMOUNT = re.compile(r"[\d][\d.,:/]*([^\W\d]*)")


class Canon(dict):
    """What a word is without its neighbours: its place in the arrays kind, hash and ends."""

    def __init__(self) -> None:
        super().__init__()
        self.core: list[str] = []
        self.kind, self.hash = np.zeros(1024, dtype=np.int8), np.zeros(1024, dtype=np.uint64)
        self.ends = np.zeros(1024, dtype=bool)

    def __missing__(self, word: str) -> int:
        core = word.strip(".,;:!?") if word[:1].isalpha() else word
        if not core.isalpha():
            core = EDGES.sub("", word)
        low = core.lower()
        amount = AMOUNT.fullmatch(core) if core[:1].isdigit() else None
        if not core:
            kind = NOTHING
        elif amount and (not amount[1] or amount[1].lower() in UNITS):
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif core[0].isupper() and core[1:].islower():
            kind = NAME
        else:
            kind = LITERAL
        at = len(self.core)
        if at == len(self.kind):
            self.kind, self.hash, self.ends = (np.concatenate([x, x]) for x in (self.kind, self.hash, self.ends))
        self.kind[at], self.ends[at] = kind, word[-1] in ".!?:;"
        self.hash[at] = hash64(low.encode("utf-8", "surrogatepass"))
        self.core.append(low if kind in SLOT else "")
        self[word] = at
        return at

    def template(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the canonical tokens, which of them are slots, their places in ``core``.

        A capitalised word is a name unless it begins a sentence; a unit is one behind a number only.
        """
        if len(self.core) > CACHE_WORDS:
            self.clear()
            self.__init__()
        own = text.split()
        at = np.fromiter(map(self.__getitem__, own), dtype=np.int64, count=len(own))
        at = at[self.kind[at] != NOTHING]
        kind = self.kind[at]
        if not len(at):
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool), at
        starts = np.r_[True, self.ends[at[:-1]]]
        counted = np.r_[False, kind[:-1] == NUMBER]
        kind = np.where((kind == NAME) & starts | (kind == UNIT) & ~counted, LITERAL, kind)
        tokens = self.hash[at]
        for k, value in SLOT.items():
            tokens[kind == k] = np.uint64(value)
        return tokens, kind != LITERAL, at


def template_windows(canon: Canon, text: str) -> tuple[np.ndarray, np.ndarray, list]:
    """Hashes of the windows with enough literal words, their places, and a reader of their slots."""
    tokens, slots, at = canon.template(text)
    width = min(WIDTH, len(tokens))
    if not width:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), []
    keys = windows(tokens, width)
    filled = np.cumsum(np.r_[0, slots])
    literal = width - (filled[width:] - filled[:-width])
    places = np.flatnonzero(literal >= min(LITERALS, width))
    return keys[places], places, [slots, at, width]


def _slots(canon: Canon, where: list, place: int) -> list[str]:
    slots, at, width = where
    return [canon.core[at[i]] for i in range(place, place + width) if slots[i]]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Stored (h, item_id, place, n_windows, slots) of every item; items without words have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon()
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                keys, places, where = template_windows(canon, text)
                if not len(keys):
                    continue
                yield pd.DataFrame(
                    {
                        "h": keys.view(np.int64),
                        "item_id": item,
                        "place": places,
                        "n_windows": len(keys),
                        "slots": [_slots(canon, where, p) for p in places.tolist()],
                    }
                )

    kind = dict(benchmark.dtypes)["item_id"]
    slim = benchmark.select("item_id", text_or_empty().alias("text")).where(F.col("item_id").isNotNull())
    schema = f"h long, item_id {kind}, place int, n_windows int, slots array<string>"
    return store(slim.distinct().mapInPandas(cut, schema), "benchmark")


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, t1, t2, item_id, n_matched, n_windows, coverage, exact: one row per document and item.

    ``exact`` tells that all slots have the item's own values. A document is named by its id and 128
    bits of its text, so repeated rows give one row. Null and empty texts, items without an id or
    without words match nothing. An item shorter than a window is too short to tell a copy from
    chance: it matches only a document that has no other words. Other columns are not read.
    """
    items = benchmark_windows(benchmark)
    spots = items.select(F.pmod("h", F.lit(FILTER_BITS)).alias("s")).distinct().toPandas()["s"]  # bounded
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bits[spots.to_numpy(dtype=np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon()
        known = np.unpackbits(np.frombuffer(sent.value, dtype=np.uint8)).view(bool)
        for batch in batches:
            out = []
            for doc_id, t1, t2, text in zip(*[batch[c] for c in ("doc_id", "t1", "t2", "text")], strict=True):
                keys, places, where = template_windows(canon, text)
                for i in np.flatnonzero(known[(keys % np.uint64(FILTER_BITS)).astype(np.int64)]).tolist():
                    out.append((doc_id, t1, t2, keys[i].view(np.int64), places[i], _slots(canon, where, int(places[i]))))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "t1", "t2", "h", "at", "own"])

    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", *text_key(text_or_empty()), text_or_empty().alias("text"))
    schema = f"doc_id {kind}, t1 long, t2 long, h long, at long, own array<string>"
    hits = store(slim.mapInPandas(find, schema), "hits")
    met = hits.join(items, "h").where(F.size("own") == F.size("slots"))
    # Every slot pairs a value of the item with one of the document.
    pairs = F.zip_with("slots", "own", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    diagonal = ["doc_id", "t1", "t2", "item_id", "n_windows", (F.col("at") - F.col("place")).alias("shift")]
    lines = met.groupBy(*diagonal).agg(
        F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    sides = [F.size(F.array_distinct(F.col(f"pairs.{side}"))) for side in ("a", "b")]
    consistent = (sides[0] == F.size("pairs")) & (sides[1] == F.size("pairs"))
    whole = lines.where(consistent).groupBy("doc_id", "t1", "t2", "item_id", "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_matched"),
        F.min(F.forall("pairs", lambda p: p["a"] == p["b"])).alias("exact"),
    )
    whole = whole.withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    return whole.where(F.col("coverage") >= COVERAGE)
