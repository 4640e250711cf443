"""Archives: exact round trips over ranges of any size, copies as revisits, broken members."""

import gzip
import hashlib
import os
import random
import zlib
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulcro.llm import warc


@contextmanager
def ranges(spark, size):
    """Files are cut every ``size`` bytes, one range a task."""
    names = {
        "spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(size),
        "spark.sql.files.minPartitionNum": "1",
    }
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def member(payload: bytes, number: int, level=6) -> bytes:
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{number}>\r\nX-Page-ID: {number}\r\n"
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", level, mtime=number)


def digests(rows):
    return sorted((int(r["page"]), r["payload_digest"], r["problem"]) for r in rows)


@pytest.fixture
def given(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdé<> ") for _ in range(5000))
    rows = [
        (1, "u", None), (2, None, ""), (3, "u\r\nx", "short"), (4, "a", "short"), (5, "b", long), (6, "c", long),
        (6, "c2", long), (7, "d", "x" * 100), (8, "e", "x" * 100), (None, "f", "x" * 100), (9, "g", "é" * 50),
        (10, "h", "é" * 50), (11, "i", "y" * 99), (12, "j", "y" * 99), (13, "k", "\r\n\r\nWARC/1.1\r\n"),
    ]
    rows += [(100 + i, "r", rng.randbytes(3000).decode("latin-1") + "\x1f\x8b\x08") for i in range(40)]
    return rows


def test_round_trip(spark, given, tmp_path):
    pages = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    path = str(tmp_path / "a")
    warc.write_warc(pages, path)
    raw = [gzip.decompress(p.read_bytes()) for p in Path(path).glob("part-*")]
    assert sum(r.count(b"WARC-Type: ") for r in raw) == len(given)
    for size in (700, 5000, 10**9):
        with ranges(spark, size):
            for payloads in (True, False):
                rows = warc.resolve_revisits(warc.read_warc(spark, path, payloads)).collect()
                assert len(rows) == len(given) and not any(r["problem"] for r in rows)
                told = {(None if r["page"] is None else int(r["page"])): r for r in rows}
                for page, uri, html in given:
                    if page == 6:
                        continue
                    body, row = (html or "").encode(), told[page]
                    assert (row["full_bytes"], row["full_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
                    if row["record_type"] == "response" and payloads:
                        assert bytes(row["payload"]) == body
                    if uri == "u\r\nx":
                        assert row["target_uri"] == "u%0D%0Ax"
                    elif uri is None:
                        assert row["target_uri"] is None
                kinds = {p: (r["record_type"], r["full_page"]) for p, r in told.items() if r["record_type"] == "revisit"}
                assert kinds == {6: ("revisit", "5"), 8: ("revisit", "7"), None: ("revisit", "7"), 10: ("revisit", "9")}
                assert sum(r["page"] == "6" for r in rows) == 2


@pytest.mark.parametrize("name", ["a.warc.gz", "a.warc"])
def test_foreign_archives(spark, tmp_path, name):
    """Stored members, so that the magic stands inside them, a record of several members, ranges of 64 bytes."""
    rng = random.Random(5)
    bodies = [(b"\x1f\x8b\x08" * 5 + rng.randbytes(rng.randrange(400))) * (i % 3) for i in range(30)]
    data = b"".join(member(b, i, level=0 if i % 2 else 9) for i, b in enumerate(bodies))
    (tmp_path / name).write_bytes(data)
    wanted = [(i, hashlib.sha256(b).hexdigest(), None) for i, b in enumerate(bodies)]
    for size in (64, 300, 10**6):
        with ranges(spark, size):
            assert digests(warc.read_warc(spark, str(tmp_path)).collect()) == wanted


def test_broken_archives(spark, tmp_path):
    good = member(b"good", 1)
    (tmp_path / "cut").write_bytes(good + member(b"lost" * 500, 2)[:-30])
    (tmp_path / "junk").write_bytes(b"junk" + good + gzip.compress(b"no record"))
    bad = bytearray(member(b"x" * 50, 3))
    bad[-6] ^= 1
    (tmp_path / "sum").write_bytes(bytes(bad) + good)
    (tmp_path / "empty").write_bytes(b"")
    lying = member(b"said", 4)
    body = zlib.decompress(lying, 31).replace(b"X-Page-ID", b"WARC-Payload-Digest: sha256:00\r\nX-Page-ID")
    (tmp_path / "lie").write_bytes(gzip.compress(body) + gzip.compress(b"") + good)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    problems = sorted((os.path.basename(r["file"]), r["problem"]) for r in rows if r["problem"])
    assert problems == [
        ("cut", "truncated member"), ("junk", "not a gzip member"), ("junk", "not a record"),
        ("lie", "digest differs"), ("sum", "unreadable member"),
    ]
    assert sorted(os.path.basename(r["file"]) for r in rows if r["page"] == "1" and not r["problem"]) == ["cut", "junk", "lie", "sum"]


def test_large_record_and_empty_table(spark, tmp_path):
    big = "z" * (1 << 24) + "end"
    pages = spark.createDataFrame([(1, "u", big), (2, "v", "after")], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "big"))
    assert len(gzip.decompress(next((tmp_path / "big").glob("part-*")).read_bytes())) > 1 << 24
    rows = {r["page"]: r for r in warc.read_warc(spark, str(tmp_path / "big")).collect()}
    assert rows["1"]["payload_bytes"] == len(big) and bytes(rows["2"]["payload"]) == b"after" and len(rows) == 2
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / "none"))).count() == 0
