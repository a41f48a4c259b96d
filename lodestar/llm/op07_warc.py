"""WARC archives: records written, read back, and assembled into captures.

Every capture becomes three records (WARC/1.1): a request, a response or revisit
with the HTTP head and, in a response, the payload, and a metadata record; the
request and the metadata name the response in WARC-Concurrent-To.  Of captures
with equal payloads of at least ``least`` bytes, the one of the smallest page_id
is the response; the others are revisits that refer to its record.  Records are
gzip members of archives of about ``ARCHIVE_BYTES`` bytes.  Archives are rows of a
Parquet table in the shared folder (executors have no other folder in common);
``archive`` is what a .warc.gz file holds.

Reading parses archives into records of one table, and transactions are put
together by joining request and metadata to responses over WARC-Concurrent-To:
one nested row per capture.  Digests are base32 SHA-1 of the whole payload; a
revisit's length stands in the Content-Length of the head that it keeps.

Nulls, ties and odd rows: a null html is an empty payload, a null URL an empty
one.  Rows of one page_id are captures of their own: the first by URL has number
0, repeats count on, and the response is the smallest (page_id, number).  Rows
without page_id come after all others.  Extra columns are not looked at.  An
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.store import kept

ARCHIVE_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"  # no wall clock: reruns agree
_NO_PAGE = (1 << 63) - 1
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(kind: str, page: int | None, url: str, print_: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}/{page}/{number}/{print_}/{url}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record: str, url: str, headers: list[tuple[str, str]], block: bytes, content: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Target-URI", url), ("WARC-Date", DATE), *headers]
    lines += [("Content-Type", content), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header value on one line, reversibly."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "%\r\n") else value


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def capture_records(page: int | None, number: int, url: str, payload: bytes, first: tuple[int | None, str] | None) -> list[bytes]:
    """The three records of a capture; ``first``: page and URL of what it revisits."""
    print_ = digest(payload)
    response = record_id("response", page, url, print_, number)
    path = url.partition("://")[2].partition("/")[2]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Payload-Digest", f"sha1:{print_}")]
    if first is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id("response", *first, print_, 0)),
        ]
    request = f"GET /{_line(path)} HTTP/1.1\r\n\r\n".encode()
    about = f"page-id: {'' if page is None else page}\r\nnumber: {number}\r\n".encode()
    concurrent = [("WARC-Concurrent-To", response)]
    return [
        _record("request", record_id("request", page, url, print_, number), url, concurrent, request, "application/http; msgtype=request"),
        _record("revisit" if first is not None else "response", response, url, headers, http + (b"" if first is not None else payload), "application/http; msgtype=response"),
        _record("metadata", record_id("metadata", page, url, print_, number), url, concurrent, about, "application/warc-fields"),
    ]


def member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a .warc.gz."""
    rest = archive
    while rest:
        expand = zlib.decompressobj(31)
        plain = expand.decompress(rest) + expand.flush()
        rest = expand.unused_data
        while plain:
            head, _, after = plain.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            for line in lines:
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = _unline(value.strip())
            size = int(headers["content-length"])
            yield headers, after[:size]
            plain = after[size + 4 :]


def _written(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        total = 0
        for batch in batches:
            for page, number, url, html, is_first, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held += [member(r) for r in capture_records(page, number, url, html.encode(), None if is_first else (first, first_url))]
                total += sum(map(len, held[-3:]))
                if total >= size:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, total = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    return run


def write_warc(pages: DataFrame, least: int = 0, size: int = ARCHIVE_BYTES) -> DataFrame:
    """A table of archives (``archive binary``) in the shared folder, of ``pages``
    (page_id, url, html)."""
    plain = pages.select(
        F.col("page_id").cast("long").alias("page"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    # rows alike in page_id, URL and payload are numbered; payloads meet their plan
    # by all three, so that copies of one payload are spread over tasks
    marked = plain.withColumn("key", F.coalesce(F.col("page"), F.lit(_NO_PAGE))).withColumn("print", F.sha1(F.col("html").cast("binary")))
    captures = kept(marked.groupBy("key", "url", "print").agg(F.max(F.octet_length("html")).alias("bytes")), "captures")
    first = captures.where(F.col("bytes") >= least).groupBy("print").agg(F.min(F.struct("key", "url")).alias("first"))
    planned = captures.join(first, "print", "left").select("key", "url", "print", "first")
    numbered = (
        marked.join(planned.hint("merge"), ["key", "url", "print"])
        .withColumn("number", F.row_number().over(Window.partitionBy("key", "url", "print").orderBy(F.lit(0))) - 1)
        .withColumn("is_first", F.col("first").isNull() | ((F.col("first.key") == F.col("key")) & (F.col("first.url") == F.col("url")) & (F.col("number") == 0)))
    )
    joined = numbered.select("page", "number", "url", "html", "is_first", F.nullif("first.key", F.lit(_NO_PAGE)).alias("first"), F.col("first.url").alias("first_url"))
    return kept(joined.mapInArrow(_written(size), "archive binary"), "warc")


_RECORD = "kind string, id string, concurrent string, refers string, url string, payload_digest string, payload_bytes long, payload binary, page long, number long"


def _parsed(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = pa.schema([
        ("kind", pa.string()), ("id", pa.string()), ("concurrent", pa.string()), ("refers", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("page", pa.int64()), ("number", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_records(archive):
                    kind = headers["warc-type"]
                    row = {
                        "kind": kind, "id": headers["warc-record-id"], "concurrent": headers.get("warc-concurrent-to"), "refers": headers.get("warc-refers-to"),
                        "url": headers.get("warc-target-uri"),
                    }
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        said = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                        row |= {"payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": int(said["Content-Length"])}
                        if kind == "response" and (digest(payload) != row["payload_digest"] or len(payload) != row["payload_bytes"]):
                            raise ValueError(f"{row['id']}: payload and digest differ")
                        row["payload"] = payload if with_payload and kind == "response" else None
                    elif kind == "metadata":
                        said = dict(line.split(": ", 1) for line in block.decode().rstrip("\r\n").split("\r\n"))
                        row |= {"page": int(said["page-id"]) if said["page-id"] else None, "number": int(said["number"])}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def read_captures(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One nested row per capture: page_id, number, ``request``, ``response`` and
    ``metadata`` structs, and refers_to (the page_id of the revisited response)."""
    records = kept(archives.mapInArrow(_parsed(with_payload), _RECORD), "warc-records")
    main = records.where("kind in ('response', 'revisit')").select(
        F.col("id").alias("response_id"), F.struct("id", "kind", "url", "payload_digest", "payload_bytes", "payload").alias("response"), "refers"
    )
    asked = records.where("kind = 'request'").select(F.col("concurrent").alias("request_to"), F.struct("id", "url").alias("request"))
    about = records.where("kind = 'metadata'").select(F.col("concurrent").alias("about"), F.struct("id", "page", "number").alias("metadata"))
    whole = main.join(asked, F.col("response_id") == F.col("request_to")).join(about, F.col("response_id") == F.col("about"))
    earlier = about.select(F.col("about").alias("earlier"), F.col("metadata.page").alias("refers_to"))
    return whole.join(earlier, F.col("refers") == F.col("earlier"), "left").select(
        F.col("metadata.page").alias("page_id"), F.col("metadata.number").alias("number"), "request", "response", "metadata", "refers_to"
    )
