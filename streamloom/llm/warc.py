"""WARC derivatives: linked metadata and plain-text conversion records from response records.

A record here is a row (warc_type, record_id, target_uri, date, content_type, refers_to, block,
block_digest); ``record_bytes`` and ``parse`` convert between rows and WARC/1.1 bytes. For each
response the builder makes a metadata record with all headers of the source, WARC's and HTTP's, as they stand, and digests
computed anew, and, if its payload is text, a conversion record with that text; both refer to the response's identifier.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, table
from .wrapper import tags

VERSION = b"WARC/1.1"
#: Header names of the format, as it defines them (fixed values).
TYPE, ID, URI, DATE, LENGTH, REFERS, BLOCK, PAYLOAD = "WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "Content-Length", "WARC-Refers-To", "WARC-Block-Digest", "WARC-Payload-Digest"

#: Elements that end a line of plain text (fixed values: names of the HTML standard).
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split()
)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    """A name-based identifier, so that a task run again makes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(names))}>"


def plain_text(page: str) -> str:
    """All text of a page, one line a block. Comments, scripts and styles have none, whether closed or not; a tag ends at
    the first ``>`` outside of quotes."""
    shown, at = [], 0
    for start, end, _, name, _ in tags(page):
        shown.append(page[at:start].replace("\n", " "))
        if name is None:
            shown.append(" ")
        elif name in BREAKS:
            shown.append("\n")
        at = end
    shown.append(page[at:].replace("\n", " "))
    lines = (" ".join(html.unescape(line).split()) for line in "".join(shown).split("\n"))
    return "\n".join(line for line in lines if line)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in headers).encode()
    return VERSION + b"\r\n" + head + f"{LENGTH}: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


class Headers(dict):
    """Values by lower-case name, the last of a repeated one; ``pairs`` has all as they stand."""

    def __init__(self, pairs: list[tuple[str, str]]):
        super().__init__((k.lower(), v) for k, v in pairs)
        self.pairs = pairs


def parse(data: bytes):
    """(Headers, block) of each record of a WARC stream, gzipped or not; ValueError where it is malformed, after the
    records before."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError(f"bad gzip: {e}") from e
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"the head at byte {at} is cut off")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = Headers([(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)])
        length = headers.get(LENGTH.lower(), "")
        if not re.fullmatch("[0-9]{1,18}", length):
            raise ValueError(f"the record at byte {at} has no length")
        stop = end + 4 + int(length)
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[end + 4 : stop]
        at = stop + 4


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def decoded(http: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content codings; one that is unknown or broken is left as it is."""
    named: dict[str, str] = {}
    for k, v in http:
        named[k.lower()] = f"{named[k.lower()]},{v.lower()}" if k.lower() in named else v.lower()
    try:
        if "chunked" in named.get("transfer-encoding", ""):
            at, out = 0, []
            while (n := int(payload[at : (end := payload.index(b"\r\n", at))].split(b";")[0], 16)) > 0:
                if end + 2 + n > len(payload):
                    raise ValueError("a chunk is cut off")
                out.append(payload[end + 2 : end + 2 + n])
                at = end + 4 + n
            payload = b"".join(out)
        for coding in reversed([c.strip() for c in named.get("content-encoding", "").split(",")]):
            if coding in ("gzip", "x-gzip", "deflate"):
                raw = coding == "deflate" and payload[:1] not in (b"\x78", b"\x58", b"\x38", b"\x18", b"\x08")
                payload = zlib.decompress(payload, -15 if raw else 47)
            elif coding not in ("", "identity"):
                break
    except (ValueError, zlib.error):
        pass
    return payload


def response(uri: str, page: str, date: str, name: str) -> bytes:
    payload = page.encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [(TYPE, "response"), (ID, record_id("response", uri, name)), (URI, uri), (DATE, date), ("Content-Type", "application/http; msgtype=response"), (BLOCK, sha1(block)), (PAYLOAD, sha1(payload))]
    return record_bytes(headers, block)


def text_of(http: list[tuple[str, str]], payload: bytes) -> str | None:
    """The text of a payload by its content type (none counts as HTML): of markup what a reader sees, of plain text all,
    of types that aren't text None."""
    kind = next((v for k, v in http if k.lower() == "content-type"), "text/html")
    name = kind.partition(";")[0].strip().lower()
    if not (name.startswith("text/") or name in ("application/xhtml+xml", "application/xml", "")):
        return None
    charset = re.search(r"charset=[\"']?([\w-]+)", kind)
    raw = decoded(http, payload)
    try:
        text = raw.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = raw.decode("utf-8", "replace")
    return text if name == "text/plain" else plain_text(text)


def derivatives(headers: Headers, block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of the metadata and, if there is text, the conversion record of one response."""
    status, http, payload = http_parts(block)
    source, uri, date = headers.get(ID.lower(), ""), headers.get(URI.lower(), ""), headers.get(DATE.lower(), "")
    fields = [("source-status", status), ("computed-block-digest", sha1(block)), ("computed-payload-digest", sha1(payload))]
    fields += [(f"source-{k.lower()}", v) for k, v in headers.pairs] + [(f"source-http-{k.lower()}", v) for k, v in http]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    made, text = [("metadata", "application/warc-fields", meta)], text_of(http, payload)
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    return [([(TYPE, kind), (ID, record_id(kind, source)), (URI, uri), (DATE, date), (REFERS, source), ("Content-Type", content_type), (BLOCK, sha1(own))], own) for kind, content_type, own in made]


SCHEMA = "key long, warc_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, record binary, error string"


def _builder(make):
    """make: bytes of the WARC stream of a row."""

    def build(batches):
        for batch in pieces(batches):
            rows = []
            for key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                data = make(*rest)
                try:
                    for headers, block in parse(data) if data else ():
                        if headers.get(TYPE.lower()) == "response":
                            source = sha1(block)
                            for own, body in derivatives(headers, block):
                                h = dict(own)
                                rows.append((key, h[TYPE], h[ID], h[REFERS], h[URI], source, h[BLOCK], len(body), record_bytes(own, body), None))
                except ValueError as e:
                    rows.append((key, "malformed", *[None] * 7, str(e)))
            kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return build


def derive(warcs: DataFrame, key_col: str, data_col: str) -> DataFrame:
    """Derivatives of every response record in the WARC streams (gzipped or not) of data_col.

    For each response a metadata row and, if its payload is text, a conversion row. ``record`` holds WARC/1.1 bytes;
    those of any rows may be concatenated to a file. Other record types and null or empty streams give no row. A stream
    that is cut off or malformed gives the rows of the records before, and one of type malformed with the error and
    nothing else. Text is read without transfer and content codings (chunked, gzip, deflate); digests are of the
    payload as it stands. Equal responses give equal records; a null key stays null. Other columns aren't read.
    """
    return arrow_map(warcs.select(F.col(key_col).cast("long"), F.col(data_col)), _builder(lambda data: data), SCHEMA)


def _whole(data: bytes) -> bool:
    """Whether the bytes from a record's start hold all of it, or show no length to tell by."""
    end = data.find(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\nContent-Length:\s*([0-9]{1,18})\s*\r\n", data[: end + 2])
    return end >= 0 and (length is None or len(data) >= end + 4 + int(length[1]))


def _records(batches):
    path, held = None, b""

    def out(data):
        return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([data], pa.binary())], ["path", "content"])

    for batch in pieces(batches):
        for own, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if held and own != path:
                yield out(held)
                held = b""
            path = own
            # what splits the file may also stand within a block
            held = held + _SPLIT.encode() + piece if held else piece if piece.startswith(b"WARC/") else b"WARC/" + piece
            if _whole(held):
                yield out(held)
                held = b""
    if held:
        yield out(held)


_SPLIT = "\r\n\r\nWARC/"


def read_warc(spark, path: str) -> DataFrame:
    """(path, content) of WARC files, a record a row, for ``derive``; through Spark, so from any store that it reads.

    Files are read as a stream of records, so one record has to fit into memory and not a file. Files that aren't
    compressed are split; of a record with the start of another within its block, at the end of a split, the parts are
    given as two rows."""
    pieces_ = spark.read.text(path, lineSep=_SPLIT).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content"))
    return arrow_map(pieces_, _records, "path string, content binary")


def page_derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Derivatives, as ``derive`` gives them, of a response record made of each page; null url or html
    counts as empty. The record is written and parsed as WARC bytes within one task."""
    key = F.col(id_col).cast("long")
    rows = pages.select(key.alias("key"), key.cast("string").alias("name"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return arrow_map(rows, _builder(lambda name, url, page: response(url or "", page or "", date, name or "")), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    made = page_derivatives(table(spark, sf_dir, "pages"))
    return made.select(F.col("key").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))
