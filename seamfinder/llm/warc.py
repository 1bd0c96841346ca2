"""WARC 1.1 archives: one gzip member a record, written and read sequentially.

The writer turns rows into response records, and into revisit records where an
equal payload is stored elsewhere. The reader decompresses incrementally, frames
every record by its Content-Length and verifies block and payload digests; it
holds one record at a time. Archives lie in a folder that all executors share.
A list of the archives that finished tasks have written is kept beside them, so
what a lost or repeated task has left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, filesystem

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this are always stored.
REVISIT_BYTES = 1000
#: An archive of about this many bytes is closed and the next one opened.
ARCHIVE_BYTES = 256 << 20
LEVEL = 4


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page_id), "WARC-Date": date,
        "WARC-Target-URI": _clean(url) if url else f"urn:page:{page_id}", "WARC-Payload-Digest": _digest(payload), "WARC-Block-Digest": _digest(block),
    }
    if page_id is not None:
        head["X-Page-ID"] = page_id
    if revisit:
        head |= {"WARC-Profile": PROFILE}
        if refers_to is not None:
            head |= {"WARC-Refers-To": name(refers_to), "X-Refers-To-Page-ID": refers_to}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


class Damaged(ValueError):
    """An archive that isn't a sequence of whole, matching records."""


def read(stream, chunk: int = 1 << 16) -> Iterator[tuple[dict, bytes]]:
    """(header, block) of every record of a binary stream, verified."""
    raw, z, out = b"", None, bytearray()
    while True:
        if not raw:
            raw = stream.read(chunk)
            if not raw:
                if z is not None:
                    raise Damaged("the archive ends within a record")
                return
        z = z or zlib.decompressobj(31)
        try:
            out += z.decompress(raw)
        except zlib.error as e:
            raise Damaged(str(e)) from e
        raw = z.unused_data
        if z.eof:
            yield _parse(bytes(out))
            z, out = None, bytearray()


def _parse(member: bytes) -> tuple[dict, bytes]:
    end = member.find(b"\r\n\r\n")
    lines = member[:end].decode("utf-8").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/1."):
        raise Damaged("a member without a record's header")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        n = int(head["content-length"])
    except (KeyError, ValueError) as e:
        raise Damaged("no content length") from e
    block = member[end + 4 : end + 4 + n]
    if len(block) != n or member[end + 4 + n :] != b"\r\n\r\n":
        raise Damaged("content length and member differ")
    if "warc-block-digest" in head and head["warc-block-digest"] != _digest(block):
        raise Damaged("block digest differs")
    if head.get("warc-type") == "response" and "warc-payload-digest" in head and head["warc-payload-digest"] != _digest(payload(block)):
        raise Damaged("payload digest differs")
    return head, block


def payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _revisits(keyed: DataFrame) -> DataFrame:
    """(p, d, kept) for the rows whose payload, by digest, is stored under a larger page_id."""
    narrow = keyed.where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest")
    largest = narrow.groupBy("digest").agg(F.max("page_id").alias("kept"), F.min("page_id").alias("least")).where("least < kept").select("digest", "kept")
    return narrow.distinct().join(largest, "digest").where("page_id < kept").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "kept")


def write(pages: DataFrame, scratch: Scratch, name: str = "archive") -> DataFrame:
    """Write pages(page_id, url, html); returns the list of archives (file, records).

    A null html is an empty payload, a null url is named after the page. Rows
    with the largest page_id of a payload are responses, all of them if such a
    row is repeated; a row without a page_id is always stored. Other columns
    aren't read.
    """
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html", F.sha1(data).alias("digest"), F.octet_length(data).alias("n"))
    marked = keyed.join(_revisits(keyed), (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "kept")
    folder = scratch.path(name)

    def run(batches):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        out, file, records, size = None, "", 0, 0
        done: list[tuple] = []
        for b in batches:
            for page, url, html, kept in zip(*(c for c in b.columns)):
                if out is None:
                    file, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{at}/{file}", compression=None)
                made = record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), kept.as_py(), kept.is_valid)
                out.write(made)
                records, size = records + 1, size + len(made)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((file, records))
                    out = None
        if out is not None:
            out.close()
            done.append((file, records))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in ((0, pa.string()), (1, pa.int64()))], names=["file", "records"])

    return scratch.keep(marked.transform(arrow, run, "file string, records long"), f"{name}-list")


def scan(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of listed archives: one task reads an archive from its start to its end.

    page_id, url, record_type, refers_to, payload_bytes, payload_digest (hex), and
    the payload of responses if asked for. Length and digest of a response are
    those of the payload read; a revisit has none, so its length is null and its
    digest what its header says (``resolved`` settles both).
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 6 + with_payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        fs, at = filesystem(folder)
        made: list[tuple] = []
        held = 0
        for b in batches:
            for file, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                count = 0
                with fs.open_input_stream(f"{at}/{file}", compression=None) as stream:
                    for head, block in read(stream):
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        own = payload(block) if head["warc-type"] == "response" else None
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex() if own is None else hashlib.sha1(own).hexdigest()
                        row = (number("x-page-id"), head.get("warc-target-uri"), head["warc-type"], number("x-refers-to-page-id"), None if own is None else len(own), digest)
                        if with_payload:
                            row += (own,)
                            held += len(block)
                        made.append(row)
                        count += 1
                        if len(made) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], names=names)
                            made, held = [], 0
                if count != records:
                    raise Damaged(f"{file}: {count} of {records} records")
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], names=names)

    n = max(1, archives.count())
    return archives.repartition(n).transform(arrow, run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Records with each revisit held against the response it refers to: that must be there and have the same digest; its length is the revisit's."""
    stored = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("stored"), F.col("payload_digest").alias("of")).agg(F.min("payload_bytes").alias("length"))
    found = records.where("record_type <> 'response'").join(stored, (F.col("refers_to") == F.col("stored")) & (F.col("payload_digest") == F.col("of")), "left")
    length = F.coalesce("length", F.raise_error(F.lit("a revisit refers to a record that isn't there or has another digest")).cast("long"))
    return records.where("record_type = 'response'").unionByName(found.withColumn("payload_bytes", length).select(records.columns))


def round_trip(pages: DataFrame, with_payload: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Archive pages and read the archives back; what is returned was read. Empty tables give an empty result."""
    s = scratch or Scratch(pages.sparkSession, "warc")
    found = scan(write(pages, s), s.path("archive"), with_payload)
    return resolved(found if with_payload else s.keep(found, "records"))
