"""WARC archives: one gzip member a record, written by Spark and read back by byte ranges.

Spark's text source cuts a file at the gzip magic instead of at line ends, range by range, and its
text sink puts members after one another, so archives lie wherever Spark reads and writes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulcro.llm.common import store
from pulcro.session import is_small

#: Fixed values of the formats: start of a gzip member, of a record, revisit profile.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Named field that carries the number of a page.
PAGE_FIELD = "X-Page-ID"
#: Payloads shorter than this are always written out.
MIN_REVISIT = 100
#: Copied payloads, 40 bytes each, that are sent to all tasks; more are joined by shuffle.
BROADCAST_COPIES = 500_000

RECORDS = (
    "file string, record_type string, record_id string, target_uri string, date string, refers_to string, "
    "page string, payload binary, payload_bytes long, payload_digest string, declared_digest string, problem string"
)
SCANNED = f"{RECORDS}, start long, part int, fragment binary"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _urn(page: str, digest: str) -> str:
    h = hashlib.sha256(f"{page}\n{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _record(page, uri, payload, digest: str, first, date: str) -> bytes:
    """A whole WARC record; without a payload it is a revisit of the page ``first``."""
    name = "" if page is None else page
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if payload is not None:
        head += f"Content-Length: {len(payload)}\r\n"
    block = head.encode() + b"\r\n" + (payload or b"")
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", _urn(name, digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if uri is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in uri)))
    if page is not None:
        fields.append((PAGE_FIELD, page))
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(first, digest))]
    told = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + b"\r\n" + told.encode() + b"\r\n" + block + b"\r\n\r\n"


def _written(data: bytes) -> bytes:
    """Bytes of a record for the text sink, which adds the last one (zero) itself.

    A gzip member ends with its size, least byte first: below 16 MB the last byte is zero. Behind a
    larger record stands an empty member, which readers of gzip files pass over.
    """
    packed = _member(data)
    if packed[-1]:
        packed += _member(b"")
    return packed[:-1]


def write_warc(
    pages: DataFrame, path: str, page: str = "page_id", uri: str = "url", payload: str = "html",
    date: str = "1970-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT,
) -> None:
    """Writes one record a row to the folder ``path``: its payload in UTF-8, or a revisit.

    Of rows with equal payloads of at least ``min_revisit`` bytes the one with the least ``page`` is
    a response, the others revisit it and hold no payload. A null payload is empty, a null page is
    the last in order (if all are null, all are responses), a null uri is left out. Rows that repeat
    the least page number are all responses. Other columns are not written. The same rows give the
    same records however often a task runs; files appear when Spark commits them.
    """
    rows = pages.select(
        F.col(page).alias("page"), F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= min_revisit
    copies = store(
        rows.where(long)
        .groupBy(F.unhex("digest").alias("copied"))
        .agg(F.min("page").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "copies",
    )
    if is_small(copies, BROADCAST_COPIES):
        copies = F.broadcast(copies)
    marked = rows.join(copies, (F.unhex("digest") == F.col("copied")) & long, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    told = marked.select(
        F.col("page").cast("string").alias("page"), "uri", F.when(~revisit, F.col("payload")).alias("payload"),
        "digest", F.col("first").cast("string").alias("first"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for p, u, body, digest, first in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                lines.append(_written(_record(p, u, None if body is None else bytes(body), digest, first, date)))
            yield pd.DataFrame({"value": lines})

    packed = told.mapInPandas(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


class _Member:
    """A gzip member that is being put together from the pieces between magics."""

    def __init__(self):
        self.unpacker, self.raw, self.body, self.broken = zlib.decompressobj(31), [], [], False

    def feed(self, piece: bytes) -> None:
        self.raw.append(piece)
        try:
            self.body.append(self.unpacker.decompress(piece))
        except zlib.error:
            self.broken = True

    @property
    def done(self) -> bool:
        return self.unpacker.eof or self.broken


def _begins(data: bytes) -> bool | None:
    """Whether a record begins here, by the gzip header and the first bytes; None if it takes more data."""
    if len(data) > 3 and data[3] & 0xE0:
        return False
    unpacker = zlib.decompressobj(31)
    try:
        found = unpacker.decompress(data, len(VERSION))
    except zlib.error:
        return False
    if len(found) >= 5:
        return found.startswith(VERSION[:5])
    return None if VERSION.startswith(found) and not unpacker.eof else False


def _blocks(body: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Named fields, block and fault of each record in an unpacked member."""
    at = 0
    while at < len(body):
        end = body.find(b"\r\n\r\n", at)
        if not body.startswith(b"WARC/", at) or end < 0:
            yield {}, b"", "not a record"
            return
        fields = {}
        for line in body[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        size = fields.get("content-length", "")
        if not size.isascii() or not size.isdigit():
            yield fields, b"", "no length"
            return
        block = body[end + 4 : end + 4 + int(size)]
        yield fields, block, None if len(block) == int(size) else "truncated"
        at = end + 4 + int(size)
        while body.startswith(b"\r\n", at):
            at += 2


def _rows(file: str, body: bytes, keep: bool) -> Iterator[dict]:
    for fields, block, problem in _blocks(body):
        kind, payload = fields.get("warc-type"), block
        if fields.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        declared = fields.get("warc-payload-digest")
        digest = hashlib.sha256(payload).hexdigest()
        if kind == "revisit":
            payload = digest = None
        elif not problem and declared and declared.startswith("sha256:") and declared[7:] != digest:
            problem = "digest differs"
        yield {
            "file": file, "record_type": kind, "record_id": fields.get("warc-record-id"),
            "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "refers_to": fields.get("warc-refers-to"), "page": fields.get(PAGE_FIELD.lower()),
            "payload": payload if keep else None, "payload_bytes": None if payload is None else len(payload),
            "payload_digest": digest, "declared_digest": declared, "problem": problem,
        }


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    for name in ("payload_bytes", "start", "part"):
        if name in names:
            frame[name] = frame[name].astype("Int64")
    return frame


def _finished(file: str, member: _Member, keep: bool) -> Iterator[dict]:
    """Rows of a member; an unreadable one is a row that says so, an empty one none."""
    if member.broken or not member.unpacker.eof:
        yield {"file": file, "problem": "unreadable member" if member.broken else "truncated member"}
    else:
        yield from _rows(file, b"".join(member.body), keep)


class _Range:
    """Reader of one byte range: pieces before the first record that begins here are left over."""

    def __init__(self, file: str, start: int, keep: bool):
        self.file, self.start, self.keep = file, start, keep
        self.first, self.synced, self.member = start == 0, start == 0, None
        self.left: list[bytes] = []
        self.tried = 0

    def feed(self, piece: bytes) -> Iterator[dict]:
        if self.first:  # what stands before the first magic of a file
            self.first = False
            if piece:
                yield {"file": self.file, "problem": "not a gzip member"}
            return
        piece = MAGIC + piece
        if not self.synced:
            self.left.append(piece)
            piece = self._synchronise()
            if piece is None:
                return
        if self.member is None:
            self.member = _Member()
        self.member.feed(piece)
        if self.member.done:
            member, self.member = self.member, None
            yield from _finished(self.file, member, self.keep)

    def _synchronise(self) -> bytes | None:
        """Bytes of the first record that begins in this range, once it is certain."""
        while self.tried < len(self.left):
            data = b"".join(self.left[self.tried :])
            begins = _begins(data)
            if begins is None:
                return None
            if begins:
                self.left, self.synced = self.left[: self.tried], True
                return data
            self.tried += 1
        return None

    def close(self) -> Iterator[dict]:
        """Fragments that other ranges need: what came before the first record, what the last one lacks."""
        place = {"file": self.file, "start": self.start}
        if self.left:
            yield {**place, "part": 0, "fragment": b"".join(self.left)}
        if self.member is not None:
            yield {**place, "part": 1, "fragment": b"".join(self.member.raw)}


def _scan(keep: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            rows: list[dict] = []
            for piece, file, start in batch.itertuples(index=False):
                if now is None or (now.file, now.start) != (file, start):
                    if now is not None:
                        rows += now.close()
                    now = _Range(file, start, keep)
                rows += now.feed(bytes(piece))
            yield _frame(rows, SCANNED)
        if now is not None:
            yield _frame(list(now.close()), SCANNED)

    return scan


class _Chain:
    """Fragments of one file in order of place, read as one stream: it ends members where they end."""

    def __init__(self, file: str, keep: bool):
        self.file, self.keep, self.member = file, keep, None

    def feed(self, data: bytes) -> Iterator[dict]:
        while data:
            if self.member is None and _begins(data) is False:
                unpacker = zlib.decompressobj(31)
                try:
                    empty = not unpacker.decompress(data) and unpacker.eof
                except zlib.error:
                    empty = False
                if not empty:
                    yield {"file": self.file, "problem": "left over"}
                    return
                data = unpacker.unused_data
                continue
            self.member = self.member or _Member()
            self.member.feed(data)
            if not self.member.done:
                return
            data = b"" if self.member.broken else self.member.unpacker.unused_data
            yield from self.close()

    def close(self) -> Iterator[dict]:
        """Rows of the open member, whole or not."""
        if self.member is not None:
            member, self.member = self.member, None
            yield from _finished(self.file, member, self.keep)


def _join(keep: bool):
    """Puts fragments, sorted by place, together: a record's beginning and what follows in later ranges."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = None
        for batch in batches:
            rows: list[dict] = []
            for file, part, data in batch.itertuples(index=False):
                if chain is not None and (part == 1 or file != chain.file):
                    rows += chain.close()
                if chain is None or file != chain.file:
                    chain = _Chain(file, keep)
                rows += chain.feed(bytes(data))
            yield _frame(rows, RECORDS)
        if chain is not None:
            yield _frame(list(chain.close()), RECORDS)

    return join


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives in ``path``, one row each, read by byte ranges.

    A task takes its range piece by piece, cut at the gzip magic; the first piece whose gzip header
    and first bytes are those of a record begins the records of the range, and a member that is not
    complete goes on with the next piece, so the magic inside packed data does no harm. A record
    belongs to the range in which it begins. What it lacks at the end of its range travels to it:
    both fragments go through a small shuffle and are put together in order of place.

    Columns: file, record_type, record_id, target_uri, date, refers_to, page, payload (null for
    revisits), its length and SHA-256, the digest the record declares, and ``problem``: null, or
    what is wrong (truncated or unreadable members, wrong digests, bytes that are no records); other
    records of the file are read all the same. A file with no records gives no rows. Files named
    ``.gz`` would be unpacked by the source; they are read raw, but each by one task. A payload that
    holds whole unpacked members of WARC records just where a range begins shows up as ``problem``.

    Without ``payloads`` rows are small; they are stored, so the archives are read once only.
    """
    reader = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1"))
    for prefix in ("", "org.apache.hadoop.shaded."):  # client jars of Spark rename one of the settings
        reader = reader.option(f"{prefix}io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
        reader = reader.option(f"{prefix}io.compress.passthrough.extension", ".gz")
    pieces = reader.text(path).select(
        F.col("value").cast("binary").alias("piece"), "_metadata.file_path", "_metadata.file_block_start"
    )
    scanned = pieces.mapInPandas(_scan(payloads), SCANNED)
    if not payloads:
        scanned = store(scanned, "records")
    whole = scanned.where("fragment IS NULL").drop("start", "part", "fragment")
    fragments = scanned.where("fragment IS NOT NULL").select("file", "start", "part", "fragment")
    ordered = fragments.repartition("file").sortWithinPartitions("file", "start", "part")
    return whole.unionByName(ordered.select("file", "part", "fragment").mapInPandas(_join(payloads), RECORDS))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Adds ``full_bytes``, ``full_digest`` and ``full_page``: those of the response a revisit names, else its own.

    A revisit of a record that is not there has nulls. The join has one row a record on its right
    side, so adaptive execution can split a response with very many revisits.
    """
    told = (
        records.where("record_type = 'response' AND problem IS NULL")
        .groupBy(F.col("record_id").alias("named"))
        .agg(F.max(F.struct("payload_bytes", "payload_digest", "page")).alias("full"))
    )
    target = F.when(F.col("record_type") == "revisit", F.col("refers_to")).otherwise(F.col("record_id"))
    return (
        records.join(told, target == F.col("named"), "left")
        .select(
            records["*"], F.col("full.payload_bytes").alias("full_bytes"),
            F.col("full.payload_digest").alias("full_digest"), F.col("full.page").alias("full_page"),
        )
    )
