"""WARC archives of a table of pages, and a salvage reader for damaged ones.

Writing. Every row is a WARC 1.1 record in a gzip member of its own. Of the
rows with equal payloads one is a ``response`` record (an HTTP response with the
payload), the others are ``revisit`` records of the profile
identical-payload-digest: the HTTP header alone, the digest, and the response
they refer to. Members are gathered into archives of about ``archive_bytes`` and
written through Spark's text sink, one archive a file, whose line separator is
an empty gzip member: it ends an archive, as the empty block ends a BGZF file.
Spark's committer thus makes a lost executor's files whole again.

Reading. Archives may be gzip members, plain records or a mixture. At each
place the reader expects a member or a version line, and checks what it finds:
the member's CRC, the version line, the header, the length and the end of the
record, and the digests of block and payload where they are given. If a check
fails, it searches for the next place where a whole valid record stands, goes on
from there, and logs the bytes in between as a ``gap`` row.

An archive is read into one task whole (Spark's ``binaryFile``: below 2 GB); the
writer keeps its own small.
"""

from __future__ import annotations

import re
import uuid
import zlib
from base64 import b32encode
from hashlib import sha1
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import prepare
from eventide.session import ensure_checkpoint_dir

ARCHIVE_BYTES = 16 << 20

# Fixed values of the formats (WARC 1.1, RFC 1952).
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.1", b"WARC/1.0")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003") + bytes.fromhex("03000000000000000000")

RECORD = ("archive string, offset long, length long, record_type string, record_id string, refers_to_id string, "
          "target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary, note string")


def member(data: bytes) -> bytes:
    """One gzip member, the same bytes at every try."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def base32_sha1(data: bytes) -> str:
    return b32encode(sha1(data).digest()).decode()


def record(kind: str, fields: dict, block: bytes) -> bytes:
    """A plain record; fields that are None are left out, texts are made fit for a header line."""
    head = [VERSION.decode(), f"WARC-Type: {kind}"]
    head += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    head += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, number: int, refers_to, refers_number) -> bytes:
    """Response record of a page, or its revisit record (``refers_number`` given)."""
    def name(page, n):
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{n}')}>"

    revisit = refers_number is not None
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + b"\r\n\r\n")
    fields = {
        "WARC-Record-ID": name(page_id, number),
        "WARC-Date": "1970-01-01T00:00:00Z",  # the table holds no times
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": name(refers_to, refers_number) if revisit else None,
        "WARC-Refers-To-Page-ID": refers_to if revisit else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return record("revisit" if revisit else "response", fields, http if revisit else http + payload)


# ------------------------------------------------------------------ reading

_LINE = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")


class Damaged(ValueError):
    """What stands here is no whole record; the text says which check failed."""


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the place behind it; raises Damaged."""
    if not data.startswith(VERSIONS, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without end")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        m = _LINE.fullmatch(line)
        if not m:
            raise Damaged("header line")
        fields[m[1].decode("ascii").lower()] = m[2].decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Damaged("content length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("end of record")
    block = data[start:stop]
    _digest(fields.get("warc-block-digest"), block, "block digest")
    kind = fields.get("warc-type", "")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("http header")
        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", head)
        size = int(m[1]) if m and kind == "revisit" else len(payload)
    if kind != "revisit":
        _digest(fields.get("warc-payload-digest"), payload, "payload digest")
    given = fields.get("warc-payload-digest", "")
    return {"record_type": kind, "record_id": fields.get("warc-record-id"),
            "refers_to_id": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
            "page_id": _number(fields.get("warc-page-id")), "refers_to": _number(fields.get("warc-refers-to-page-id")),
            "payload_bytes": size,
            "payload_digest": given.partition(":")[2] if given.startswith("sha1:") else base32_sha1(payload),
            "payload": None if kind == "revisit" else payload, "note": None}, stop + 4


def _digest(given: str | None, data: bytes, what: str) -> None:
    """SHA-1 digests are checked, those of other kinds cannot be."""
    if given and given.startswith("sha1:") and given[5:] != base32_sha1(data):
        raise Damaged(what)


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]+", text, re.ASCII) else None


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """Contents of the gzip member at ``at`` and the place behind it; raises Damaged."""
    z = zlib.decompressobj(31)
    parts, i = [], at
    try:
        while not z.eof:
            if i >= len(data):
                raise Damaged("member without end")
            parts.append(z.decompress(data[i:i + 65536]))
            i += 65536
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    return b"".join(parts), min(i, len(data)) - len(z.unused_data)


def _step(data: bytes, at: int) -> tuple[list[dict], int]:
    """Records of the member or the plain record at ``at``, and the place behind; raises Damaged."""
    if not data.startswith(GZIP, at):
        one, end = parse(data, at)
        return [one], end
    inner, end = _member(data, at)
    rows, i = [], 0
    while i < len(inner):
        one, i = parse(inner, i)
        rows.append(one)
    return rows, end


def salvage(data: bytes):
    """Rows (offset, length and the columns of RECORD from record_type on) of an archive.

    Offsets are places in the archive; a record inside a member has the member's.
    Records and gaps together cover every byte but those of empty members.
    """
    at, start = re.compile(re.escape(GZIP) + b"|WARC/1[.][01]"), 0
    while start < len(data):
        try:
            rows, end = _step(data, start)
        except Damaged as e:
            why, here = str(e), start
            while True:  # the next place where something valid stands
                m = at.search(data, here + 1)
                if m is None:
                    here = len(data)
                    break
                here = m.start()
                try:
                    _step(data, here)
                    break
                except Damaged:
                    continue
            yield {"offset": start, "length": here - start, "record_type": "gap", "note": why}
            start = here
            continue
        for r in rows:
            yield {"offset": start, "length": end - start, **r}
        start = end


# ------------------------------------------------------------------ Spark


def with_roles(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html",
               least: int = 0) -> DataFrame:
    """(page_id, url, payload, number, refers_to, refers_number) of every page.

    Of rows with equal payloads of at least ``least`` bytes, the one with the
    largest key (NULL smallest; of equal keys the last row) is the response and
    the others refer to it. Only keys travel to the aggregate, which Spark
    combines before the shuffle; the join's hot payloads are split by AQE.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("number", F.monotonically_increasing_id())
    last = (rows.filter(F.octet_length("payload") >= least).groupBy("digest")
            .agg(F.max(F.struct("page_id", "number")).alias("last"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1").select("digest", "last"))
    own = F.col("last").isNull() | (F.col("last.number") == F.col("number"))
    return rows.join(last, "digest", "left").select(
        "page_id", "url", "payload", "number", F.when(~own, F.col("last.page_id")).alias("refers_to"),
        F.when(~own, F.col("last.number")).alias("refers_number"))


def write_warc(spark: SparkSession, pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url",
               html: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` into archives below ``path``.

    ``pages`` must be a stored table (its rows are numbered where they are read).
    Defined results: a NULL html is empty; a NULL url gives no target field, other
    characters than those of a URI are percent-encoded; a NULL key gives no page
    field; repeated rows are records of their own; a record larger than an
    archive is an archive of its own; an empty table gives no archive; other
    columns are not read.
    """
    prepare(spark)

    def gather(it):
        import pandas as pd
        held, size = [], 0
        for pdf in it:
            cols = [[None if pd.isna(v) else int(v) for v in pdf[c].astype(object)]
                    for c in ("page_id", "number", "refers_to", "refers_number")]
            for url_, payload, page, number, to, to_number in zip(pdf["url"], pdf["payload"], *cols):
                m = member(page_record(page, url_, bytes(payload), number, to, to_number))
                if held and size + len(m) > archive_bytes:
                    yield pd.DataFrame({"archive": [b"".join(held)]})
                    held, size = [], 0
                held.append(m)
                size += len(m)
        if held:
            yield pd.DataFrame({"archive": [b"".join(held)]})

    rows = with_roles(pages, key=key, url=url, html=html, least=least)
    # The bytes of an archive pass the text sink as they are, one row and file each.
    (rows.mapInPandas(gather, "archive binary").select(F.col("archive").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path))


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Rows of RECORD from the archives below ``path``: records, and ``gap`` rows
    (offset, length, the failed check in ``note``) for quarantined bytes.

    ``payload`` is NULL for revisits, and for all rows without ``payloads``; the
    length and digest of a revisit's payload are those its header states. A
    folder without archives gives no rows.
    """
    prepare(spark)
    names = [c.split()[0] for c in RECORD.split(",")]
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(it):
        import pandas as pd
        for pdf in it:
            for archive, data in zip(pdf["path"], pdf["content"]):
                rows, size = [], 0
                for r in salvage(bytes(data)):
                    if not payloads:
                        r["payload"] = None
                    rows.append({"archive": archive, **r})
                    size += len(r.get("payload") or b"") + 400
                    if size > 8 << 20:
                        yield pd.DataFrame(rows).reindex(columns=names).astype(object)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=names).astype(object)

    return files.mapInPandas(read, RECORD)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes of ``read_warc``'s rows."""
    return records.filter("record_type = 'gap'").select("archive", "offset", "length", "note")


def page_archives(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives below the checkpoint folder, which all
    executors share, and return each page's record as it is read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(spark, pages, path)
    return read_warc(spark, path, payloads=False).filter(F.col("record_type").isin("response", "revisit")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
