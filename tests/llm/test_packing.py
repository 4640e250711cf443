import zlib
from collections import defaultdict

import numpy as np
import pytest
from pulcro.llm.packing import Packer, pack_documents, sequences
from pulcro.llm.queries import op1_best_fit_packing, tokenizer_file
from tokenizers import Tokenizer

VOCABULARY = tokenizer_file("byte_bpe_50k.json")


def check(rows, documents, length=1024):
    """Rows against whole texts encoded by the library; gives the number of sequences."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = []
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) if len(ids) <= length else (len(ids) - 1) % length + 1
        cuts = [0, *range(head, len(ids) + 1, length)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(places)


def test_whole_table(spark, sf):
    rows = op1_best_fit_packing(spark, sf).collect()
    documents = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = check(rows, documents)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


SPECIAL = [
    (1, None), (2, ""), (None, "a  b\n\n c"), (3, " leading and trailing "), (3, " leading and trailing "),
    (4, "tab\there <|endoftext|> x<|endoftext|>y"), (5, "é𝄞 中文 words don't  stop 'll"), (6, "word " * 3000),
    (7, "x" * 5000), (8, "\n"), (9, "a b  c 1234 5"), (10, "a " * 1023), (11, "ab\r\n cd"),
]


def test_special_texts(spark):
    docs = spark.createDataFrame([(*d, 1) for d in SPECIAL], "doc_id long, text string, piece int").repartition(3)
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    check(pack_documents(docs, VOCABULARY, ranks).collect(), SPECIAL)
    check(pack_documents(docs, VOCABULARY, length=16).collect(), SPECIAL, 16)
    assert pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(SPECIAL, "doc_id long, text string")
    packed = pack_documents(docs, VOCABULARY, length=64, with_ids=True).checkpoint()
    whole = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in packed.collect():
        part = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]


def test_crossover_keeps_every_item_once():
    random = np.random.default_rng(3)
    packer = Packer(random.integers(1, 100, 500), 100, 1)
    a, b = packer.start(0.0), packer.start(0.1)
    for _ in range(50):
        child = packer.cross(a, b)
        fill = packer.fills(child)
        assert (child >= 0).all() and (fill > 0).all() and fill.max() <= 100
        a, b = b, child


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_documents(spark, n):
    docs = spark.createDataFrame([(i, "some text") for i in range(n)], "doc_id long, text string")
    assert pack_documents(docs, VOCABULARY).select("sequence_id").distinct().count() == min(n, 1)
