import random

from pulcro.llm.decontaminate import Canon, contaminations, template_windows

ITEM = (
    "A train leaves Boston at 60 km per hour and another leaves Chicago at 75 km per hour while Alice "
    "waits for 3 hours before she buys 12 apples and gives Bob half of the apples that she has left"
)


def filler(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"f{rng.randrange(10**6)}x" for _ in range(n))


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contaminations(docs, bench).collect()
    return {(r["doc_id"], r["item_id"]): r for r in rows}


def test_copies_and_reparameterised_copies(spark):
    other = ITEM.replace("Boston", "Denver").replace("60", "45").replace("Alice", "Carol").replace("12", "30")
    mixed = ITEM.replace("60 km", "45 km").replace("75 km", "45 km")  # two numbers became one
    texts = [
        f"{filler(1)} {ITEM} {filler(2)}", f"{filler(3)} {other} {filler(4)}", f"{filler(5)} {mixed}",
        filler(6, 300), None, "", f"{filler(7)} {ITEM.upper()}", ITEM, f"{filler(8)} {ITEM[: len(ITEM) // 4]} {filler(9)}",
    ]
    rows = found(spark, texts, [(7, ITEM), (8, None), (None, filler(10)), (9, "short item")])
    assert {k for k, r in rows.items() if r["exact"]} >= {(0, 7), (7, 7)}
    assert not rows[1, 7]["exact"]
    assert (2, 7) not in rows or rows[2, 7]["coverage"] < 1
    assert not {k[0] for k in rows} & {3, 4, 5, 8}


def test_inconsistent_slots_are_no_copy(spark):
    item = " ".join(f"take {n} cups of flour and mix well" for n in (5, 5, 5, 5))
    wrong = " ".join(f"take {n} cups of flour and mix well" for n in (1, 2, 3, 4))
    right = " ".join(f"take {n} cups of flour and mix well" for n in (2, 2, 2, 2))
    rows = found(spark, [f"{filler(1)} {wrong}", f"{filler(2)} {right}"], [(1, item)])
    assert (1, 1) in rows
    assert (0, 1) not in rows


def test_whole_table(spark, sf):
    """Documents that hold an item word for word, by plain search, and no other ones."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")

    def plain(text):
        return " ".join("".join(c for c in w if c.isalnum()) for w in text.lower().split() if any(c.isalnum() for c in w))

    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    expected = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in plain(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in contaminations(docs, bench).collect()} == expected


def test_repeated_rows_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, 0, "h"), (1, ITEM, 0, "h"), (None, ITEM, 0, "h")], "doc_id long, text string, at int, h string")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")
    assert contaminations(docs, bench).count() == 2
    assert contaminations(docs.limit(0), bench).count() == 0
    assert contaminations(docs, bench.limit(0)).count() == 0


def test_templates():
    canon = Canon()
    a = template_windows(canon, "Then Alice walked 5 km to the old mill")[0]
    b = template_windows(canon, "Then Bob walked 12.5 miles to the old mill")[0]
    c = template_windows(canon, "Then alice walked 5 km to the old mill")[0]
    assert a.tolist() == b.tolist() != c.tolist()
