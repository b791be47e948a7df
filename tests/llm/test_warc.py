import base64
import hashlib
import time
from html.parser import HTMLParser

import pytest

from fieldstone.llm import warc
from fieldstone.shared import shared_path


class Slow(HTMLParser):
    """Text of well-formed pages by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in warc.BLOCK:
            self.out.append("\n")
        self.hidden += tag in warc.HIDDEN

    def handle_endtag(self, tag):
        if tag in warc.BLOCK:
            self.out.append("\n")
        self.hidden -= tag in warc.HIDDEN

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def slow(page):
    p = Slow()
    p.feed(page)
    p.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.out).split("\n")) if x)


def test_text_is_the_standard_parser_s_on_the_given_pages():
    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        assert warc.text_of(r["html"]) == slow(r["html"])


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""), ("a<b", "a<b"), ("a <b>x</b>y", "a xy"), ("<p>a<br>b&amp;&eacute;", "a\nb&é"), ("<!-- x --!><p>y", ""), ("a<!-- <p> -->b", "ab"),
        ("<script>var a='</p>';</script >z", "z"), ("<SCRIPT>x", ""), ("x<style", "x<style"), ("1 < 2 <i>3</i>", "1 < 2 3"), ("<head><title>t</title></head>b", "b"), ("</>q<?php ?>r", "qr"),
        ('<a title="x > y">hi', "hi"), ("<p title='a>b' x=\"c>'d\">e", "e"), ('<p title="oops>x</p>y', "x\ny"), ("<head><title>t</title><body><p>text", "text"), ("<head><meta x><div>d</div>", "d"),
        ("a<svg/>b<iframe src='x'/>c", "abc"), ("<svg>hidden</svg>seen", "seen"), ("<iframe>open text", "open text"), ("<header>x</header>", "x"), ("<script src='a'/>code</script>t", "t"),
    ],
)
def test_text_of(page, text):
    assert warc.text_of(page) == text


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<a '" * 100001 + ">", "<a \">'" * 100001 + ">", "<" * 300000, "<a" * 200000 + ">", "<!--" * 100000, "<script>" * 50000, "<p>" * 200000):
        warc.text_of(page)
    assert time.time() - began < 20


def test_files_round_trip(spark):
    rows = [(1, "http://a/é", "<p>Héllo<p>w"), (2, None, None), (3, "http://b\r\nX: y", "\r\n\r\nWARC/1.0\r\n<p>x"), (None, "u", "<b>n"), (1, "http://a/é", "<p>Héllo<p>w"), (5, "", "x" * 50000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, type string").repartition(2)
    path = shared_path(spark, "w")
    warc.write_warc(warc.derivatives(warc.responses(pages)), path, rows_per_file=2)
    records = warc.read_warc(spark, path).collect()
    assert len(records) == 2 * len(rows) and all(r.digest_ok for r in records)
    got = warc.linked(warc.read_warc(spark, path)).collect()
    assert sorted((r.page_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    source = {r.page_id: r for r in warc.responses(pages).collect()}
    for r in got:
        html = {k: h for k, _, h in rows}[r.page_id] or ""
        assert r.response_id == r.conversion_refers_to == source[r.page_id].record_id
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        text = warc.text_of(html)
        assert (r.text_chars, r.text_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest()) and r.http_status == "HTTP/1.1 200 OK" and r.text_ok and r.metadata_ok
    empty = shared_path(spark, "w")
    warc.write_warc(warc.derivatives(warc.responses(pages.limit(0))), empty)
    assert warc.linked(warc.read_warc(spark, empty)).count() == 0


def test_pages_that_share_id_and_url_keep_their_own_text(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>one"), (1, "http://a", "<p>two"), (1, "http://a", "<p>two")], "page_id long, url string, html string")
    path = shared_path(spark, "w")
    warc.write_warc(warc.derivatives(warc.responses(pages)), path)
    got = warc.linked(warc.read_warc(spark, path)).collect()
    assert sorted(r.text_sha256 for r in got) == sorted(hashlib.sha256(t).hexdigest() for t in (b"one", b"two", b"two"))
    assert len({r.response_id for r in got}) == 2
