import hashlib
from collections import defaultdict

import pytest
from pulcro.llm.line_dedup import WHITE, LineRuns, dedup_lines
from pulcro.llm.queries import op8_line_dedup

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(documents):
    """(doc_id, lines, dropped, kept text) of (doc_id, text)."""
    def key(line):
        return line.strip(WHITE).translate(UPPER)

    holders = defaultdict(set)
    for i, t in documents:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    keeper = {k: max(own, key=lambda i: (i is not None, i or 0)) for k, own in holders.items() if len(own) >= 5}
    out = []
    for i, t in documents:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def same(rows, documents):
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in rows), key=str)
    assert got == sorted(brute(documents), key=str)


def test_whole_table(spark, sf):
    documents = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(documents)]
    assert sorted(map(tuple, op8_line_dedup(spark, sf).collect())) == sorted(expected)


LONG = "This Line Is Long Enough To Be Counted As One É"


@pytest.mark.parametrize("batches", [1, 2, 3, 7])
def test_special_texts(spark, batches):
    documents = [(i, f"{LONG}\nown {i}\n\t {LONG.lower()[:-1]}É \nshort") for i in range(8)]
    documents += [(None, None), (None, LONG), (9, ""), (9, ""), (10, f"{LONG}\n{LONG}"), (10, f"{LONG}\n{LONG}"), (11, LONG.lower()), (12, f"\x1c{LONG}"), (13, "\n\n")]
    documents += [(100 + i, "y" * 50 + "\n" + "x" * 39 + f"\n{i}") for i in range(6)]
    documents += [(None, "only with null ids, and long enough to be counted"), (14, "a\n" * 5000 + LONG)]
    frame = spark.createDataFrame([(*d, 5, "k") for d in documents], "doc_id long, text string, place int, h1 string")
    rows = dedup_lines(frame, batches=batches)
    assert rows.columns == ["doc_id", "text", "place", "h1", "n_lines", "n_dropped"]
    same(rows.collect(), documents)
    assert dedup_lines(frame.limit(0)).count() == 0


def test_runs_are_levelled(spark):
    runs = LineRuns(spark, fanout=2, buckets=4)
    for k in range(5):
        batch = spark.createDataFrame([(1, 1, 1, 10 - k), (k + 2, 0, 2, 10 - k)], "h1 long, h2 long, n long, top long")
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    rows = {r["h1"]: (r["n"], r["keeper"]) for r in runs.merged().collect()}
    assert rows == {1: (5, 10), 2: (2, 10), 3: (2, 9), 4: (2, 8), 5: (2, 7), 6: (2, 6)}


def test_a_run_is_one_file_a_bucket(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark)
    for k in range(3):
        runs.add(spark.range(k * 300, k * 300 + 1000).selectExpr("id AS h1", "id * 7 AS h2", "1L AS n", "id AS top").repartition(13))
    assert all(len(run.inputFiles()) <= parts for run in runs.runs())
    assert runs.merged().agg({"n": "sum"}).first()[0] == 3000
    runs.drop()


def test_stays_in_the_jvm(spark, sf):
    assert "Python" not in op8_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
