"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A response row gives two records. Both refer to the response by WARC-Refers-To and keep its target address, date,
status line, header fields and payload digest; each has an identifier derived from the response's and a digest of its
own block. A record is the exact bytes of a WARC file's entry, so that records written one after the other are one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices
from .store import small_batches

VERSION = "WARC/1.1"
#: The date of responses that have none.
DATE = "1970-01-01T00:00:00Z"

# what never shows as text, whole. Every mark that opens is taken to its end or to the page's: the scan never goes back
_HIDDEN = r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)"
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul|body|option"
_MARK = re.compile(rf"(?is){_HIDDEN}|(</?(?:{_BLOCKS})\b[^>]*(?:>|\Z))|<[a-z/!?][^>]*(?:>|\Z)")
_TITLE, _TITLE_END = re.compile(r"(?i)<title\b"), re.compile(r"(?i)</title")
_ANCHOR, _HREF, _BARE = re.compile(r"(?i)<a\b"), re.compile(r"(?i)\shref\s*=\s*"), re.compile(r"[^\s>]+")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def page_text(html: str) -> str:
    """The text of a page: hidden elements go, block elements end lines, white space is single, entities are read.

    A comment, hidden element or tag that does not end goes on to the end of the page.
    """
    text = _MARK.sub(lambda m: "\n" if m[2] else "" if m[1] is None and not m[0].startswith("<!--") else " ", html)
    return _LINES.sub("\n", _BLANK.sub(" ", unescape(text))).strip()


def _addresses(html: str) -> Iterator[str]:
    """The href of each link, as it stands. A quoted one ends with its quote, another at a blank or the tag's end.

    Positions only go on, and a quote that is not found is not looked for again, so the time is linear.
    """
    at, quotes = 0, {'"': True, "'": True}
    while (found := _ANCHOR.search(html, at)) is not None:
        end = html.find(">", found.end())
        end = len(html) if end < 0 else end
        at = found.end()
        while (name := _HREF.search(html, at, end)) is not None:
            at = name.end()
            quote = html[at : at + 1]
            if quotes.get(quote):
                close = html.find(quote, at + 1)
                if close >= 0:
                    yield html[at + 1 : close]
                    at = close + 1
                    break
                quotes[quote] = False
            if (bare := _BARE.match(html, at)) is not None:
                yield bare[0]
                at = bare.end()
                break
        at = max(at, end)


def page_links(html: str, base: str) -> list[str]:
    """Addresses of a page's links in order, made absolute; ones that cannot be are left as they stand."""
    out = []
    for raw in _addresses(html):
        raw = unescape(raw).strip()
        try:
            out.append(urljoin(base, raw))
        except ValueError:
            out.append(raw)
    return out


def page_title(html: str) -> str:
    """The text of the first title, white space single; empty if there is none or it does not end."""
    opens = _TITLE.search(html)
    start = html.find(">", opens.end()) if opens else -1
    close = _TITLE_END.search(html, start) if start >= 0 else None
    return " ".join(unescape(html[start + 1 : close.start()]).split()) if close else ""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(name: str) -> str:
    """A name-based identifier: written again, a record keeps it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _line(value: str) -> str:
    """A value that cannot break out of its header line."""
    return re.sub(r"[\r\n]+", " ", value)


def record(kind: str, fields: list[tuple[str, str]], content_type: str, block: bytes, block_digest: str) -> bytes:
    """A whole WARC record."""
    head = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {_line(v)}" for k, v in fields), f"WARC-Block-Digest: {block_digest}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def derivatives_of(target: str, date: str, http: str, body: str, source_id: str, payload: str) -> list[tuple[str, str, str, bytes, bytes]]:
    """(type, record id, digest of the block, block, record) of a response's two derivatives; payload is its digest."""
    status, *headers = http.splitlines() or [""]
    shared = [("WARC-Refers-To", source_id), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", target), ("WARC-Date", date)]
    about = [f"source-status: {_line(status)}", *(f"source-header: {_line(h)}" for h in headers if h.strip())]
    about += [f"source-payload-digest: {payload}", f"title: {page_title(body)}"]
    about += [f"outlink: {_line(x)} L a/@href" for x in page_links(body, target)]
    blocks = [("metadata", "application/warc-fields", ("\r\n".join(about) + "\r\n").encode()), ("conversion", "text/plain; charset=utf-8", page_text(body).encode())]
    out = []
    for kind, content_type, block in blocks:
        own = record_uuid(f"{source_id} {kind}")
        fields = [("WARC-Record-ID", own), *shared, ("WARC-Source-Payload-Digest", payload)]
        block_digest = digest(block)
        out.append((kind, own, block_digest, block, record(kind, fields, content_type, block, block_digest)))
    return out


_SCHEMA = "page_id long, type string, record_id string, refers_to string, target_uri string, date string, source_digest string, block_digest string, block binary, record binary"
_KINDS = [pa.int64(), *[pa.string()] * 7, pa.binary(), pa.binary()]


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for whole in batches:
        for batch in slices(whole, "body"):
            rows = []
            for page, target, date, http, body, source_id in zip(*(batch.column(x).to_pylist() for x in ("page_id", "target", "date", "http", "body", "source_id")), strict=True):
                source = digest(body.encode())
                for kind, own, block_digest, block, whole_record in derivatives_of(target, date, http, body, source_id, source):
                    rows.append((page, kind, own, source_id, target, date, source, block_digest, block, whole_record))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows, metadata and conversion, for each row of responses(page_id, target, date, http, body, source_id).

    http is the status line and header fields, body the payload as text, source_id the response's WARC-Record-ID.
    Null strings are empty, a null date is DATE; a null source_id is derived from the address and the page id. An
    empty or null body gives a metadata record without links and an empty conversion. Rows that repeat give records
    that repeat. An empty table gives no records. Other columns are ignored, whatever their names.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = responses.select(
        F.col("page_id").cast("long").alias("page_id"), text("target").alias("target"), F.coalesce(F.col("date").cast("string"), F.lit(DATE)).alias("date"),
        text("http").alias("http"), text("body").alias("body"), F.col("source_id").cast("string").alias("source_id"),
    )
    h = F.sha1(F.concat_ws(" ", "target", F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    part = lambda a, n: F.substring(h, a, n)
    own = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))
    small_batches(responses.sparkSession)
    return rows.withColumn("source_id", F.coalesce("source_id", own)).mapInArrow(_derive, _SCHEMA)


def responses_of(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The table pages(page_id, url, html) as response rows with the header fields of an HTML page."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size)
    return pages.select("page_id", F.col("url").alias("target"), F.lit(date).alias("date"), http.alias("http"), F.col("html").alias("body"), F.lit(None).cast("string").alias("source_id"))
