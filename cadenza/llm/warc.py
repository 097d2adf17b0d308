"""WARC derivatives: every response record becomes a metadata record and a plain-text conversion record that refer to it.

A derivative keeps the response's target URI, date, IP address and warc-info id, names its record id in WARC-Refers-To, and repeats
its block and payload digests (they are computed where the response has none) in two headers of its own, `SOURCE_DIGESTS`, and the
metadata record in its block too. Chunked bodies are put together, and those in gzip (all members) or
deflate unpacked; broken ones, those that unpack to more than `MOST_UNPACKED` bytes, and those in Brotli are taken as they are. Record ids are name-based, so that a rerun gives the
same. The metadata block is JSON: status, HTTP headers, title, language and links of the page; the conversion block is its text,
one block element a line.

Edge cases: a record that isn't a well-formed response gives no rows; null and empty bodies give records with empty blocks; null
URIs leave the header out; repeated responses give repeated rows; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table

DATE = "2024-01-01T00:00:00Z"
#: Headers of the response that its derivatives keep.
KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID")
SOURCE_DIGESTS = {"source-block-digest": "WARC-Source-Block-Digest", "source-payload-digest": "WARC-Source-Payload-Digest"}
#: Bytes that a packed body may unpack to.
MOST_UNPACKED = 1 << 28
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:cadenza:warc")
_SILENT = re.compile(r"(?is)<(script|style|template|noscript|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<![^>]*>")
_BREAK = re.compile(r"(?i)</?(?:p|br|div|h[1-6]|li|ul|ol|table|tr|section|article|header|footer|nav|aside|form|blockquote|pre|hr|dl|dt|dd|main|body|html|head)\b[^>]*>")
_CELL = re.compile(r"(?i)</?(?:td|th|caption|option)\b[^>]*>")
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_LINK = re.compile(r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)</title")
_LANG = re.compile(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '/'.join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {re.sub('[\r\n]+', ' ', v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, start: bytes = b"WARC/") -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, headers and block of a WARC record or an HTTP message."""
    head, found, block = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(start):
        raise ValueError("not a record")
    first, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    return first, headers, block[: int(length)] if length.isdigit() else block


def response(key: str, url: str | None, body: bytes, date: str = DATE) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "", digest(block))), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body))]
    return record(headers, block)


def plain_text(page: str) -> str:
    lines = html.unescape(_TAG.sub("", _CELL.sub(" ", _BREAK.sub("\n", _SILENT.sub(" ", page))))).split("\n")
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def unchunked(body: bytes) -> bytes:
    """The parts of a chunked body; ValueError where their sizes don't say where they end."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if end + 2 + size > len(body):
            raise ValueError("a part is cut")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def gunzipped(body: bytes) -> bytes:
    """All members of a gzip body; what follows the last one and is none is left out. More than `MOST_UNPACKED` bytes is an error."""
    out, size = [], 0
    while body:
        one = zlib.decompressobj(31)
        try:
            part = one.decompress(body, MOST_UNPACKED - size + 1)
        except zlib.error:
            if not out:
                raise
            break
        size += len(part)
        if size > MOST_UNPACKED:
            raise ValueError("a body unpacks to too much")
        if not one.eof and not out:
            raise ValueError("a member is cut")
        out.append(part)
        body = one.unused_data
    return b"".join(out)


def unpacked(http: list[tuple[str, str]], body: bytes) -> bytes:
    """A body without its transfer and content codings."""
    named = {k.lower(): v.lower() for k, v in http}
    try:
        if "chunked" in named.get("transfer-encoding", ""):
            body = unchunked(body)
        coding = named.get("content-encoding", "")
        if "gzip" in coding:
            return gunzipped(body)
        if "deflate" in coding:
            one = zlib.decompressobj(15 if body[:1] == b"x" else -15)
            out = one.decompress(body, MOST_UNPACKED)
            return out if one.eof else body
    except (ValueError, zlib.error):
        pass
    return body


def page_metadata(status: str, http: list[tuple[str, str]], page: str, url: str) -> dict:
    title, lang = _TITLE.search(page), _LANG.search(page)
    links = [html.unescape(a or b or c) for a, b, c in _LINK.findall(page)]
    return {"status": status, "http-headers": http, "title": " ".join(html.unescape(title[1]).split()) if title else None, "language": lang[1] if lang else None, "links": [_joined(url, x) for x in links]}


def _joined(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def derivatives(data: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """(type, headers, block) of the two records made from a response record."""
    _, headers, block = parse(data)
    named = {k.lower(): v for k, v in headers}
    if named.get("warc-type") != "response":
        return []
    status, http, body = parse(block, b"HTTP/")
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w-]+)", kind, re.I)
    try:
        page = unpacked(http, body).decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = unpacked(http, body).decode("utf-8", "replace")
    source = named.get("warc-record-id", "")
    kept = [(k, named[k.lower()]) for k in KEPT if k.lower() in named]
    kept += [("WARC-Refers-To", source)] if source else []
    sums = {"source-block-digest": named.get("warc-block-digest") or digest(block), "source-payload-digest": named.get("warc-payload-digest") or digest(body)}
    meta = json.dumps(page_metadata(status, http, page, named.get("warc-target-uri", "")) | sums, ensure_ascii=False).encode()
    out = []
    for kind, mime, content in (("metadata", "application/json", meta), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace"))):
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source, sums["source-block-digest"])), *kept, *((name, sums[k]) for k, name in SOURCE_DIGESTS.items()), ("Content-Type", mime), ("WARC-Block-Digest", digest(content))]
        out.append((kind, own, content))
    return out


_FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "source_block_digest", "source_payload_digest", "block_digest", "block", "record"]


def derive(records: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Two rows per response record: the id, the main headers, the block as text and the whole record as bytes."""
    chosen = records.select(F.col(id_col), F.col(content_col).cast("binary").alias("content"))

    def convert(batches):
        for batch in batches:
            keys, rows = [], []
            for key, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py() or b""
                try:
                    made = derivatives(data)
                except ValueError:
                    continue
                for name, own, block in made:
                    h = dict(own)
                    meta = json.loads(made[0][2])
                    keys.append(key.as_py())
                    rows.append((name, h["WARC-Record-ID"], h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Date"), meta["source-block-digest"], meta["source-payload-digest"], h["WARC-Block-Digest"], block.decode("utf-8", "replace"), record(own, block)))
            kinds = [pa.string()] * 9 + [pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema[0].type), *cols], [id_col, *_FIELDS])

    fields = ", ".join(f"{n} {'binary' if n == 'record' else 'string'}" for n in _FIELDS)
    return chosen.mapInArrow(convert, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, {fields}")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records: id and content."""
    chosen = pages.select(F.col(id_col), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("body"))

    def wrap(batches):
        for batch in batches:
            made = [response(str(key), url, body) for key, url, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], [id_col, "content"])

    return chosen.mapInArrow(wrap, f"`{id_col}` {chosen.schema[0].dataType.simpleString()}, content binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")), "page_id", "content").drop("record")
