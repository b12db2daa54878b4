"""WARC derivatives: metadata and plain-text conversion records of responses.

A WARC record is a version line, named fields, an empty line and a block of
Content-Length bytes.  For every response record the builder makes

* a ``metadata`` record (application/warc-fields) with the page's title, its
  links, the HTTP status and content type and the source's headers;
* a ``conversion`` record (text/plain) with the text of the page.

Both name the response in WARC-Refers-To, keep its WARC-Target-URI and
WARC-Date and carry its payload digest as WARC-Source-Payload-Digest beside a
WARC-Block-Digest of their own; the metadata record also names the response's
block digest and repeats its HTTP headers.  Ids are name-based UUIDs of the
response's id and the record's type, so a rebuilt derivative has the same ids.
Each response is derived alone in its task: no shuffle, no growth with groups.

Text of a page: script, style, template and head parts and comments go, block
tags and line breaks become line feeds, other tags go, character references are
decoded, white space is folded within lines, empty lines go.

Defined results: a null page is a response with an empty body; a null URL is
an empty one; repeated rows give repeated records; records that are no
responses are passed over; a malformed record raises; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("page_id long, record_id string, record_type string, refers_to string, target_uri string, date string, "
          "block_digest string, payload_digest string, source_payload_digest string, title string, n_links long, "
          "content string, record string")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name-based ids of URLs
_DATE = "2024-01-01T00:00:00Z"
_GONE = re.compile(r"<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>|<head\b.*?</head\s*>", re.S | re.I)
_BREAK = re.compile(r"<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|table|tr|td|th|article|section|header|footer|nav|main|aside|"
                    r"blockquote|pre|form|title))\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def digest(block: bytes) -> str:
    """SHA-1 in base 32, as WARC files label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, ' '.join(names))}>"


def make_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("not a WARC record")
    fields = parse_fields(head)
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError("the block is shorter than Content-Length")
    return fields, rest[:length]


def parse_fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's head (names in lower case)."""
    lines, fields = head.decode().split("\r\n"), {}
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed field {line!r}")
        fields[name.strip().lower()] = value.strip()
    return fields


def one_line(value: str) -> str:
    return " ".join(value.split())


def page_text(page: str) -> str:
    """Plain text of an HTML page."""
    text = _TAG.sub("", _BREAK.sub("\n", _GONE.sub(" ", page)))
    lines = (one_line(x) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def response_record(page_id: int | None, url: str | None, page: str | None) -> bytes:
    """Response record of a crawled page."""
    payload = (page or "").encode()
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
             + str(len(payload)).encode() + b"\r\n\r\n" + payload)
    url = one_line(url or "")
    return make_record({
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", str(page_id), url, digest(payload)),
        "WARC-Target-URI": url,
        "WARC-Date": _DATE, "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload),
        "Content-Type": "application/http; msgtype=response"}, block)


def derive(record: bytes) -> list[dict]:
    """The metadata and the conversion record of a response; of another record none."""
    fields, block = parse_record(record)
    if fields.get("warc-type") != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("latin-1").split("\r\n")
    kind = next((h.partition(":")[2].strip() for h in headers if h.lower().startswith("content-type:")), "")
    charset = re.search(r"charset=[\"']?([\w-]+)", kind)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", errors="replace")
    except LookupError:  # a charset that nobody knows
        page = payload.decode("utf-8", errors="replace")
    title = _TITLE.search(page)
    title = one_line(html.unescape(title[1])) if title else ""
    links = [html.unescape("".join(quoted)) for quoted in _LINK.findall(page)]
    source, url = fields["warc-record-id"], fields.get("warc-target-uri", "")
    payload_digest = fields.get("warc-payload-digest") or digest(payload)
    lines = [("source-block-digest", fields.get("warc-block-digest") or digest(block)), ("http-status", status),
             *(("http-header", h) for h in headers), ("title", title), *(("outlink", one_line(x)) for x in links)]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in lines)),
              "conversion": ("text/plain", page_text(page))}
    out = []
    for kind, (content_type, content) in blocks.items():
        data = content.encode("utf-8", errors="replace")
        own = {"WARC-Type": kind, "WARC-Record-ID": record_id(source, kind), "WARC-Refers-To": source,
               "WARC-Target-URI": url, "WARC-Date": fields.get("warc-date", _DATE), "WARC-Block-Digest": digest(data),
               "WARC-Source-Payload-Digest": payload_digest, "Content-Type": content_type}
        out.append({"record_id": own["WARC-Record-ID"], "record_type": kind, "refers_to": source, "target_uri": url,
                    "date": own["WARC-Date"], "block_digest": own["WARC-Block-Digest"],
                    "payload_digest": own["WARC-Block-Digest"], "source_payload_digest": payload_digest, "title": title,
                    "n_links": len(links), "content": data.decode(), "record": make_record(own, data).decode()})
    return out


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, record): response records of a table of pages."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [None if pd.isna(i) else int(i) for i in b["page_id"]]
            yield pd.DataFrame({"page_id": pd.array(ids, dtype="Int64"), "record": [
                response_record(*x) for x in zip(ids, b["url"], b["page"])]})

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.col(page).alias("page")).mapInPandas(build, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses in (page_id, record)."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page_id": None if pd.isna(i) else int(i), **d} for i, r in zip(b["page_id"], b["record"])
                    for d in derive(bytes(r))]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_id": "Int64", "n_links": "int64"})

    return records.select("page_id", "record").mapInPandas(build, RECORD)


def write_warc(derived: DataFrame, path: str, codec: str = "gzip") -> None:
    """WARC files of derived records (two line breaks end a record)."""
    derived.select(F.col("record").alias("value")).write.option("compression", codec).option(
        "lineSep", "\r\n\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, record) of WARC files, one file a task; lengths come from Content-Length."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                at, n, out = 0, 0, []
                while at < len(data):
                    head = data.index(b"\r\n\r\n", at) + 4
                    end = head + int(parse_fields(data[at:head - 4])["content-length"])
                    out.append((name, n, data[at:end]))
                    at, n = end + 4, n + 1
                yield pd.DataFrame(out, columns=["path", "nth", "record"])

    return (spark.read.format("binaryFile").load(path).select("path", "content")
            .mapInPandas(split, "path string, nth long, record binary"))
