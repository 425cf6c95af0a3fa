"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Every derivative keeps the source's identifier (WARC-Refers-To), target, date, HTTP headers and payload digest, and has a
block digest of its own. Identifiers are derived from the source's, so a task run twice writes the same record.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"""(?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+>""")  # > inside a quoted value does not end a tag
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_BLANKS = re.compile(r"[ \t\x0b\f\r\xa0]+")
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "textarea", "title")}
_BLOCK = set("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td th thead tr ul".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_html(html: str) -> dict:
    """title, lang, links and plain text (one line per block) in one pass; unclosed constructs reach to the end."""
    out: list[str] = []
    links: list[str] = []
    title, lang = None, None
    at, n = 0, len(html)
    while at < n:
        i = html.find("<", at)
        if i < 0:
            out.append(html[at:])
            break
        out.append(html[at:i])
        if html.startswith("<!--", i):
            j = html.find("-->", i + 4)
            at = n if j < 0 else j + 3
            continue
        m = _TAG.match(html, i)
        if not m:
            if html[i + 1 : i + 2] in ("!", "?", "/"):
                j = html.find(">", i)
                at = n if j < 0 else j + 1
            else:
                out.append("<")
                at = i + 1
            continue
        end = _TAG_END.match(html, m.end())
        if not end:
            break
        j = end.end() - 1
        name, closing = m[1].lower(), html[i + 1] == "/"
        at = j + 1
        if name in _BLOCK:
            out.append("\n")
        if closing:
            continue
        if name in _RAW:
            end = _RAW[name].search(html, at)
            inner = html[at : end.start() if end else n]
            at = end.end() if end else n
            if name == "title" and title is None:
                title = " ".join(entities.unescape(inner).split())
            elif name == "textarea":
                out.append(inner)
        elif name == "a" and (href := _HREF.search(html, m.end(), j)):
            links.append(entities.unescape(next(g for g in href.groups() if g is not None)))
        elif name == "html" and (found := _LANG.search(html, m.end(), j)):
            lang = found[1]
    lines = (_BLANKS.sub(" ", x).strip() for x in entities.unescape("".join(out)).split("\n"))
    return {"title": title or "", "lang": lang or "", "links": links, "text": "\n".join(x for x in lines if x)}


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, payload. A block without a header end is all payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if k.strip()], payload


def _decode(payload: bytes, content_type: str) -> str:
    """Text by the charset of the header, else by one declared in the first 2,048 bytes (as HTML asks), else UTF-8.

    Names that are unknown, or no character encoding, count as UTF-8; undecodable bytes become replacement characters.
    """
    name = _CHARSET.search(content_type) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        return payload.decode(name[1] if name else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def _unchunk(payload: bytes) -> bytes:
    """Body of a chunked transfer; bytes that are not chunks are left as they are."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        try:
            size = int(payload[at:end].split(b";")[0].strip() or b"?", 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return payload if not out else b"".join([*out, payload[at:]])
        if size == 0:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + size])
        at = end + 4 + size
        if at > len(payload):
            return b"".join(out)


def _inflate(payload: bytes, coding: str) -> bytes:
    """Body of a gzip or deflate coding, as far as it can be read; other codings and damaged bodies are left as they are."""
    for window in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        reader = zlib.decompressobj(window)
        try:
            return reader.decompress(payload) + reader.flush()
        except zlib.error:
            continue
    return payload


def plain_payload(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content codings."""
    named = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = _unchunk(payload)
    for coding in reversed([x.strip() for x in named.get("content-encoding", "").split(",")]):
        payload = _inflate(payload, coding)
    return payload


def derive(record_id: str, target: str, date: str, block: bytes, payload_digest: str | None = None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = split_http(block)
    content_type = next((v for k, v in headers if k.lower() == "content-type"), "")
    payload_digest = payload_digest or digest(payload)
    page = read_html(_decode(plain_payload(payload, headers), content_type))
    fields = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in headers), ("title", page["title"]), ("language", page["lang"]), *(("outlink", " ".join(x.split())) for x in page["links"]), ("source-payload-digest", payload_digest), ("source-block-length", str(len(block)))]
    bodies = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), "conversion": ("text/plain; charset=utf-8", page["text"])}
    out = []
    names = {kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id + '#' + kind)}>" for kind in bodies}
    for kind, (media, body) in bodies.items():
        raw = body.encode("utf-8", "surrogatepass")
        other = names["conversion" if kind == "metadata" else "metadata"]
        out.append({
            "warc_type": kind, "record_id": names[kind], "refers_to": record_id, "concurrent_to": other, "target_uri": target, "warc_date": date,
            "content_type": media, "content_length": len(raw), "block_digest": digest(raw), "source_payload_digest": payload_digest, "source_headers": headers, "body": body,
        })
    return out


_FIELDS = [
    ("warc_type", "string", pa.string()), ("record_id", "string", pa.string()), ("refers_to", "string", pa.string()), ("concurrent_to", "string", pa.string()), ("target_uri", "string", pa.string()), ("warc_date", "string", pa.string()),
    ("content_type", "string", pa.string()), ("content_length", "long", pa.int64()), ("block_digest", "string", pa.string()), ("source_payload_digest", "string", pa.string()),
    ("source_headers", "array<struct<name:string,value:string>>", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("body", "string", pa.string()),
]


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response.

    responses: key long, record_id, target_uri, warc_date string, block binary (HTTP header and payload), payload_digest
    string. A null block is empty (no headers, empty text), other nulls are empty strings; a null payload_digest is
    computed over the payload as stored, codings included. Repeated responses give repeated records, with the same
    identifiers. Malformed HTML is read to its end, never refused. The two records name each other (WARC-Concurrent-To).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 128):
            keys, made = [], []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "record_id", "target_uri", "warc_date", "block", "payload_digest")), strict=True):
                for r in derive(row[0] or "", row[1] or "", row[2] or "", row[3] or b"", row[4]):
                    r["source_headers"] = [{"name": k, "value": v} for k, v in r["source_headers"]]
                    keys.append(key), made.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([r[c] for r in made], t) for c, _, t in _FIELDS)], names=["key", *(c for c, _, _ in _FIELDS)])

    wanted = responses.select(F.col("key").cast("long").alias("key"), *(F.col(c).cast("string").alias(c) for c in ("record_id", "target_uri", "warc_date")), F.col("block").cast("binary").alias("block"), F.col("payload_digest").cast("string").alias("payload_digest"))
    return wanted.mapInArrow(run, "key long, " + ", ".join(f"{c} {t}" for c, t, _ in _FIELDS))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records for (page_id, url, html) rows, as a crawler would have stored them."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    name = F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url").cast("string")).cast("binary"))
    dashed = F.concat_ws("-", *(F.substring(name, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return pages.select(
        F.col("page_id").cast("long").alias("key"), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("warc_date"), F.concat(head, html).alias("block"), F.lit(None).cast("string").alias("payload_digest"),
    )


def serialise(row: dict) -> bytes:
    """A WARC/1.1 record."""
    body = row["body"].encode("utf-8", "surrogatepass")
    head = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Concurrent-To", row["concurrent_to"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Source-Payload-Digest", row["source_payload_digest"])]
    head += [("WARC-Source-Header", f"{h['name']}: {h['value']}") for h in row["source_headers"]]
    head += [("Content-Type", row["content_type"]), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a WARC file, gzipped by record or not; reading ends at the first damaged record."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            reader = zlib.decompressobj(31)
            try:
                parts.append(reader.decompress(data) + reader.flush())
            except zlib.error:
                break
            data = reader.unused_data
        data = b"".join(parts)
    at = 0
    while (start := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in data[start:end].decode("utf-8", "replace").split("\r\n")[1:])]
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        if end < 0 or not size.isdecimal():
            return
        at = end + 4 + int(size)
        yield headers, data[end + 4 : at]


def responses_from_warc(files: DataFrame) -> DataFrame:
    """Response records of WARC files, as build_derivatives() takes them; key: place among the file's responses.

    files: path string, content binary, as spark.read.format("binaryFile") gives them, plain or gzipped by record. Null and
    damaged files give the records before the damage.
    """
    schema = "path string, key long, record_id string, target_uri string, warc_date string, block binary, payload_digest string"
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for headers, block in parse_records(content or b""):
                    named = {k.lower(): v for k, v in headers}
                    if named.get("warc-type") == "response":
                        rows.append((path, len(rows), *(named.get(k) for k in ("warc-record-id", "warc-target-uri", "warc-date")), block, named.get("warc-payload-digest")))
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "key", "record_id", "target_uri", "warc_date", "block", "payload_digest"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)
