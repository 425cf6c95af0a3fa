import gzip
import random
import re
import zlib

from tidecast.llm.warc import build_derivatives, digest, parse_records, plain_payload, read_html, responses_from_pages, responses_from_warc, serialise, split_http

PAGE = "<!DOCTYPE html><html lang=\"fr\"><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href='/x?a=1&amp;b=2'>x</a></nav><!-- c <p> --><p>One  <b>two</b><br>three &lt;4 &eacute;</p><p>5 < 6"


def test_html():
    page = read_html(PAGE)
    assert page == {"title": "A & B", "lang": "fr", "links": ["/x?a=1&b=2"], "text": "x\nOne two\nthree <4 é\n5 < 6"}
    assert read_html("<!--" * 50000)["text"] == "" and read_html("a<script>" * 20000)["text"] == "a"
    assert read_html("")["text"] == "" and read_html("<p")["text"] == ""


def test_links_headers_digests_round_trip(spark):
    rows = [(1, "http://a/é", PAGE), (2, None, None), (3, "http://b", ""), (3, "http://b", ""), (4, "http://c", "<p>" + "long text " * 50000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, body string")
    responses = {r["record_id"]: r for r in responses_from_pages(pages).collect()}
    got = build_derivatives(responses_from_pages(pages)).collect()
    assert len(got) == 2 * len(rows)
    data = b"".join(serialise(r.asDict(recursive=True)) for r in got)
    parsed = list(parse_records(data))
    assert len(parsed) == len(got)
    for r, (headers, block) in zip(got, parsed, strict=True):
        source = responses[r["refers_to"]]
        h = dict(headers)
        assert h["WARC-Refers-To"] == r["refers_to"] and h["WARC-Target-URI"] == (source["target_uri"] or "")
        assert h["WARC-Block-Digest"] == digest(block) and int(h["Content-Length"]) == len(block) == r["content_length"]
        status, source_headers, payload = split_http(bytes(source["block"]))
        assert r["source_payload_digest"] == digest(payload) and status == "HTTP/1.1 200 OK"
        assert [tuple(x) for x in r["source_headers"]] == source_headers
        assert [v for k, v in headers if k == "WARC-Source-Header"] == [f"{k}: {v}" for k, v in source_headers]
    assert {r["body"] for r in got if r["key"] == 1 and r["warc_type"] == "conversion"} == {read_html(PAGE)["text"]}
    assert len({r["record_id"] for r in got}) == 2 * 4
    assert build_derivatives(responses_from_pages(pages.limit(0))).count() == 0


def test_other_charset_and_bare_payload(spark):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>\xe9"
    df = spark.createDataFrame([(1, "<r>", "u", "d", bytearray(block), "sha1:GIVEN"), (2, None, None, None, bytearray(b"just <b>text"), None)], "key long, record_id string, target_uri string, warc_date string, block binary, payload_digest string")
    got = {(r["key"], r["warc_type"]): r for r in build_derivatives(df).collect()}
    assert got[1, "conversion"]["body"] == "é" and got[1, "metadata"]["source_payload_digest"] == "sha1:GIVEN"
    assert got[2, "conversion"]["body"] == "just text" and got[2, "conversion"]["source_headers"] == []


def test_odd_charsets_do_not_crash(spark):
    rows = [(i, f"<r{i}>", "u", "d", bytearray(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={c}\r\n\r\n<p>é".encode()), None) for i, c in enumerate(["undefined", "idna", "hex", "punycode", "unicode_escape", "rot13", "x" * 80, "utf-8", "mbcs"])]
    df = spark.createDataFrame(rows, "key long, record_id string, target_uri string, warc_date string, block binary, payload_digest string")
    got = {r["key"]: r["body"] for r in build_derivatives(df).filter("warc_type = 'conversion'").collect()}
    assert len(got) == len(rows) and got[0] == got[1] == got[2] == got[5] == got[7] == "é"


def test_quoted_brackets_and_codings():
    assert read_html('<a title="x > y" href=\'/q\'>link</a> <p data-x="a>b">t')["text"] == "link\nt"
    assert read_html('<a title="x > y" href="/q">l</a>')["links"] == ["/q"]
    assert read_html('<p title="never closed>text')["text"] == "text"  # a quote without its end is no quote
    body = "<p>héllo".encode()
    chunked = b"3\r\n" + body[:3] + b"\r\n" + b"%x;ext=1\r\n" % len(body[3:]) + body[3:] + b"\r\n0\r\n\r\n"
    assert plain_payload(chunked, [("Transfer-Encoding", "chunked")]) == body
    assert plain_payload(gzip.compress(body), [("content-encoding", "gzip")]) == body
    raw = zlib.compressobj(wbits=-15)
    assert plain_payload(raw.compress(body) + raw.flush(), [("Content-Encoding", "deflate")]) == body
    assert plain_payload(body, [("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")]) == body


def test_text_equals_a_plain_reading():
    """Brute force over well-formed pages: tags out, blocks as lines, blanks folded."""
    rnd = random.Random(3)
    for _ in range(200):
        blocks = [" ".join(rnd.choices(["word", "x", "é", "<b>bold</b>", "<i title='a>b'>it</i>", "&amp;", "<a href=/u>u</a>"], k=rnd.randint(0, 8))) for _ in range(6)]
        html = "".join(f"<{t}>{b}</{t}>" for b in blocks for t in [rnd.choice(["p", "div", "li", "h2"])])
        want = [" ".join(re.sub(r"<[^<>]*'[^']*'[^<>]*>|<[^>]*>", "", b).replace("&amp;", "&").split()) for b in blocks]
        page = read_html(html)
        assert page["text"] == "\n".join(x for x in want if x)
        assert len(page["links"]) == html.count("<a ")


def test_warc_files_are_read_and_records_linked(spark):
    def record(kind, i, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <r{i}>\r\nWARC-Target-URI: http://x/{i}\r\nWARC-Date: d\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi WARC/1.0 there"
    records = [record("warcinfo", 0, b"x"), record("response", 1, block), record("request", 2, b"GET"), record("response", 3, block)]
    files = [("a", bytearray(b"".join(records))), ("b", bytearray(b"".join(map(gzip.compress, records)))), ("c", None), ("d", bytearray(b"".join(records)[:-200])), ("e", bytearray(b"not a file"))]
    df = spark.createDataFrame(files, "path string, content binary")
    found = responses_from_warc(df)
    got = sorted((r["path"], r["key"], r["record_id"]) for r in found.collect())
    assert got[:4] == [("a", 0, "<r1>"), ("a", 1, "<r3>"), ("b", 0, "<r1>"), ("b", 1, "<r3>")] and not any(p in "ce" for p, _, _ in got)
    made = build_derivatives(found.filter("path = 'a'")).collect()
    ids = {r["record_id"]: r for r in made}
    assert len(made) == 4 and all(ids[r["concurrent_to"]]["concurrent_to"] == r["record_id"] for r in made)
    assert {r["body"] for r in made if r["warc_type"] == "conversion"} == {"hi WARC/1.0 there"}
