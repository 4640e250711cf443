"""Operator 9, LM scoring: log-likelihood of whole documents by a gated recurrent model.

Words are counted over all training documents. The most frequent ones, a bounded list, are looked up
where the text is read; only the rest is joined with the counts by shuffle. The model knows the most
frequent of these words; others are one unknown word, spelled out by their share of the counts. It is
trained by truncated backpropagation on every word of every training document, in parallel on all
partitions, and the weights are averaged after each round.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulcro.llm.common import store, text_or_empty
from pulcro.llm.recurrent import Gru, Weights, score, train

#: At most so many words are sent to all executors, each of at most so many bytes.
FREQUENT_WORDS, FREQUENT_BYTES = 200_000, 64
VOCABULARY, CLASSES, HIDDEN = 1024, 32, 24
#: Training documents are learnt from in windows of so many words, in chunks that gradients span; each
#: window in one of the rounds, many side by side, so that the cost of a step is shared by them.
WINDOW, CHUNK, LANES, ROUNDS, RATE = 32, 16, 512, 3, 0.01
#: Words scored together: with many texts the lanes stay full while the longest ones are read.
SCORED_WORDS = 2_000_000
SEED = 9
#: No word holds white space, so this stands for the end of a text.
END = b"\n"


def words_of(text: str) -> list[bytes]:
    """Words of a text with A to Z in lower case, cut at ASCII white space, and its end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()

    def told() -> pd.DataFrame:
        return pd.DataFrame({"word": list(counts), "c": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})

    for batch in batches:
        for text in batch["text"]:
            counts.update(words_of(text))
            if len(counts) > 400_000:
                yield told()
                counts.clear()
    if counts:
        yield told()


def _packed(weights: Weights) -> bytes:
    return b"".join(weights[k].astype(np.float32).tobytes() for k in sorted(weights))


def _unpacked(data: bytes, like: Weights) -> Weights:
    flat, out, at = np.frombuffer(data, dtype=np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean of the weights in a partition, by the words they have learnt from."""
    n, total = 0, None
    for batch in batches:
        for data, own in zip(batch["weights"], batch["n"], strict=True):
            part = np.frombuffer(data, dtype=np.float32).astype(np.float64) * own
            total = part if total is None else total + part
            n += own
    if n:
        yield pd.DataFrame({"weights": [(total / n).astype(np.float32).tobytes()], "n": [n]})


def fit(texts: DataFrame, model: Gru, end: int) -> Gru:
    """Trains on the stored ``texts`` (``ids``, a binary of 16-bit word numbers a row), round by round."""
    for turn in range(ROUNDS):
        weights, classes = model.w, model.classes

        def learn(batches: Iterator[pd.DataFrame], turn=turn, weights=weights, classes=classes) -> Iterator[pd.DataFrame]:
            own, n = Gru(classes, {k: v.copy() for k, v in weights.items()}), 0
            for batch in batches:
                found = [_windows(np.frombuffer(x, dtype=np.uint16), end) for x in batch["ids"]]
                # A text alone decides which of its windows a round takes.
                part = np.concatenate([w[(turn + len(w)) % ROUNDS :: ROUNDS] for w in found])
                n += train(own, part, CHUNK, LANES, RATE / (1 + turn))
            if n:
                yield pd.DataFrame({"weights": [_packed(own.w)], "n": [n]})

        learnt = store(texts.mapInPandas(learn, "weights binary, n long"), "weights")
        # Averages of a few at a time, so that neither a task nor the driver reads them all.
        while learnt.count() > 16:
            learnt = store(learnt.repartition(-(-learnt.count() // 16)).mapInPandas(_mean, learnt.schema), "weights")
        last = learnt.toPandas()
        if len(last):
            model = Gru(classes, _unpacked(next(_mean(iter([last])))["weights"].iloc[0], weights))
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every input row.

    A document is held out if crc32(doc_id as text) is divisible by 10; a null id is the empty text,
    so it is held out. A null or empty text is its end alone. Repeated rows are scored each and count
    each in training. Without any training document all words are unknown. Other columns are not
    read. ``base_score`` is the unigram score, ``score`` that of the recurrent model, both log10.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    slim = docs.select("doc_id", held.alias("held_out"), text_or_empty().alias("text"))
    counts = store(
        slim.where(~F.col("held_out")).select("text").mapInPandas(_count, "word binary, c long")
        .groupBy("word").agg(F.sum("c").alias("c")),
        "counts",
    )
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Words by size class of their count: whole classes are taken as long as they fit the bound.
    level = F.floor(F.log2("c") * 8).cast("int")
    short = counts.where(F.octet_length("word") <= FREQUENT_BYTES)
    taken, floor = 0, 1 << 30
    for row in sorted(short.groupBy(level.alias("k")).count().collect(), key=lambda r: -r["k"]):
        taken += row["count"]
        if taken > FREQUENT_WORDS:
            break
        floor = row["k"]
    frequent = short.where(level >= floor).toPandas()
    frequent = frequent.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    words = frequent["word"].map(bytes).tolist()
    known = frequent["c"].to_numpy(dtype=np.int64)
    if END in words:  # the end of a text and the unknown word are always known to the model
        at = words.index(END)
        words.insert(0, words.pop(at))
        known = np.r_[known[at], np.delete(known, at)]
    else:
        words, known = [END, *words], np.r_[np.int64(0), known]
    size = min(VOCABULARY, len(words))
    outside = int(total["n"] - known[:size].sum())
    shares = np.r_[known[:size], max(outside, 1)].astype(np.float64)
    order = np.argsort(-shares, kind="stable")
    number = np.empty(size + 1, dtype=np.int64)
    number[order] = np.arange(size + 1)
    sent = spark.sparkContext.broadcast((words, known, number))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, known, number = sent.value
        place = {w: i for i, w in enumerate(words)}
        logs = np.append(np.log10(known + 0.1), 0.0)
        has = np.append(known > 0, False)
        numbers = np.full(len(words) + 1, number[size])
        numbers[:size] = number[:size]
        for batch in batches:
            out = []
            for doc_id, held_out, text in zip(batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                own = words_of(text)
                at = np.fromiter(map(place.get, own, repeat(-1)), dtype=np.int64, count=len(own))
                ids = numbers[at].astype(np.uint16)
                rare = Counter(own[i] for i in np.flatnonzero(at < 0).tolist())
                beyond = at >= size
                out.append(
                    (doc_id, held_out, len(own), int(has[at].sum()), float(logs[at].sum()), float(logs[at[beyond]].sum()),
                     int(beyond.sum()), int((at < 0).sum()), ids.tobytes(), list(rare), list(rare.values()))
                )
            names = [field.split()[0] for field in fields.split(", ")]
            yield pd.DataFrame(out, columns=names[1:]).assign(row=batch["row"].to_numpy())

    kind = dict(docs.dtypes)["doc_id"]
    fields = (
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, beyond_logs double, "
        "n_beyond long, n_rare long, ids binary, words array<binary>, times array<int>"
    )
    encoded = store(
        slim.select(F.monotonically_increasing_id().alias("row"), "*").mapInPandas(encode, fields), "encoded"
    )
    pairs = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    rare = counts.where((level < floor) | (F.octet_length("word") > FREQUENT_BYTES))
    c = F.coalesce("c", F.lit(0))
    found = (
        pairs.join(rare, pairs["words"] == rare["word"], "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(c + 0.1) * F.col("times")).alias("rare_logs"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    model = Gru.start(shares[order] + 0.1, HIDDEN, CLASSES, SEED)
    end = int(number[0])
    model = fit(encoded.where(~F.col("held_out")).select("ids"), model, end)
    classes, weights = model.classes, model.w

    def likelihood(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Gru(classes, weights)
        for batch in _gathered(batches, SCORED_WORDS):
            texts = [np.frombuffer(x, dtype=np.uint16).astype(np.int64) for x in batch["ids"]]
            yield batch.drop(columns="ids").assign(model=score(own, texts, end) / math.log(10))

    plain = fields[: fields.index(", ids binary")]
    names = [field.split()[0] for field in plain.split(", ")]
    scored = encoded.select(*names, "ids").mapInPandas(likelihood, plain + ", model double")
    scored = scored.join(found, "row", "left")
    n, v = total["n"], total["v"]
    base_mass = math.log10(n + 0.1 * (v + 1))
    known_words = int((known[:size] > 0).sum())
    other_mass = math.log10(outside + 0.1 * (v - known_words + 1))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + rare_logs - F.col("n_tokens") * base_mass).alias("base_score"),
        (F.col("model") + F.col("beyond_logs") + rare_logs - (F.col("n_beyond") + F.col("n_rare")) * other_mass).alias("score"),
    )


def _gathered(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they hold ``words`` word numbers in ``ids``."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += sum(map(len, batch["ids"])) // 2
        if size >= words:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _windows(ids: np.ndarray, end: int) -> np.ndarray:
    """Windows (n, WINDOW + 1) that predict every word of a text, the first one from ``end``.

    Windows lie side by side; the last one ends with the text, so some words are in two. A text that is
    shorter than a window is filled with ``end``.
    """
    text = np.r_[np.uint16(end), ids]
    if len(ids) <= WINDOW:
        return np.pad(text, (0, WINDOW - len(ids)), constant_values=end)[None]
    starts = np.minimum(np.arange(0, len(ids), WINDOW), len(ids) - WINDOW)
    return np.lib.stride_tricks.sliding_window_view(text, WINDOW + 1)[starts]
