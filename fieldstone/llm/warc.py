"""WARC derivatives: plain-text conversion records and metadata records from response records.

A response becomes a conversion record, whose block is the page's text, and a metadata record, whose block lists the
source's headers and digests. Both refer to the response by WARC-Refers-To; the metadata record also names the
conversion. Record ids are derived from the response's id, which is derived from page id, url and payload, so a task
that runs again writes the same records and pages that share an id keep records of their own.

Files are written by Spark's text writer with the record separator as its line end, so they are committed like any
other output and can go to any file system; a row is the pair of records of one response. They are gzipped whole, hold
at most `rows_per_file` pairs, and are read back as binary files that are unpacked as a stream, record by record by
Content-Length.

A hidden element that is closed in its own tag is empty; a head without an end tag ends where the body begins, an
unclosed script or style element at the end of the page, and of other unclosed hidden elements only the tag is left out.

Defined cases: a null url is an empty target URI and a null page an empty page, which has an empty conversion; a null
id gives an empty page-id field and is read back as null; rows that repeat give records with the same ids; line ends
inside header values are folded to spaces; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.arrow import map_batches

#: Elements whose content is not text, and elements that end a line.
HIDDEN = frozenset("script style noscript template svg iframe object head".split())
BLOCK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split()
)
TAG = re.compile(r"""</?([a-zA-Z][a-zA-Z0-9:-]*)(?:[^>"']++|"[^"]*"|'[^']*')*+>""")
LOOSE = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>")  # a tag with a quote that never ends
CLOSE = {name: re.compile(rf"</{name}\b" + (r"|<body\b|<(?:article|div|h[1-6]|main|p|section|table|ul)[\s>]" if name == "head" else ""), re.IGNORECASE) for name in HIDDEN}
#: Hidden elements that run to the end of the page if they are not closed; of others only the tag is left out then.
RAW = frozenset(("script", "style"))
END = "\r\n\r\n"


def text_of(page: str) -> str:
    """The text of an HTML page, in one pass over its tags: lines of block elements, white space folded, entities decoded."""
    out, at, last = [], 0, page.rfind(">")
    while (tag := page.find("<", at)) >= 0 and tag < last:
        out.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = len(page) if end < 0 else end + 3
        elif m := TAG.match(page, tag) or LOOSE.match(page, tag):
            name, at = m[1].lower(), m.end()
            if name in BLOCK:
                out.append("\n")
            if name in HIDDEN and page[tag + 1] != "/" and (name in RAW or page[at - 2] != "/"):
                closing = CLOSE[name].search(page, at)
                if closing is None:
                    at = len(page) if name in RAW else at
                elif page[closing.start() + 1] != "/":  # the body begins, so the head has ended
                    at = closing.start()
                else:
                    at = page.find(">", closing.end()) + 1 or len(page)
        elif page.startswith(("<!", "<?", "</"), tag):
            at = page.find(">", tag) + 1
        else:
            out.append("<")
            at = tag + 1
    out.append(page[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def record(kind: str, headers: list[tuple[str, str]], block: bytes, content_type: str) -> str:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", sha1(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block.decode()


def responses(pages: DataFrame, date: str = "2020-01-01T00:00:00Z", id_col: str = "page_id") -> DataFrame:
    """Response records of raw pages: page_id, record_id, target_uri, date, http_headers, payload."""
    uri, ident = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    payload = F.coalesce(F.col("html"), F.lit(""))
    key = F.md5(F.concat(ident, F.lit(" "), uri, F.lit(" "), F.md5(payload)))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    return pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        uri.alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"),
    )


def derivatives(found: DataFrame) -> DataFrame:
    """One row per response: `records`, its conversion and its metadata record."""

    def make():
        def pair(page_id, record_id, target_uri, date, http_headers, payload) -> str:
            body, head = (payload or "").encode(), http_headers or ""
            status, *fields = [one_line(x) for x in head.split("\r\n") if x.strip()] or [""]
            text = text_of(payload or "").encode()
            ids = urn(record_id, "conversion"), urn(record_id, "metadata")
            shared = [("WARC-Target-URI", one_line(target_uri)), ("WARC-Date", one_line(date)), ("WARC-Refers-To", record_id)]
            about = [
                ("page-id", "" if page_id is None else str(page_id)), ("conversion-record", ids[0]), ("source-payload-digest", sha1(body)), ("source-block-digest", sha1(head.encode() + b"\r\n" + body)),
                ("source-payload-length", str(len(body))), ("source-http-status", status), *(("source-http-header", x) for x in fields), ("text-digest", sha1(text)),
            ]
            meta = "".join(f"{k}: {v}\r\n" for k, v in about).encode()
            return record("conversion", [("WARC-Record-ID", ids[0]), *shared], text, "text/plain; charset=utf-8") + END + record("metadata", [("WARC-Record-ID", ids[1]), *shared], meta, "application/warc-fields")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pair(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.string())], ["records"])

        return run

    columns = ["page_id", "record_id", "target_uri", "date", "http_headers", "payload"]
    return map_batches(found.select(*columns), make, "records string", "payload")


def write_warc(records: DataFrame, path: str, rows_per_file: int = 4000) -> None:
    """Write rows of records as gzipped WARC files in the folder `path`."""
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped file, one record at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while line := f.readline():
            if line != b"WARC/1.0\r\n":
                raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
            headers = {}
            while line := f.readline().decode().rstrip("\r\n"):
                name, value = line.split(": ", 1)
                headers[name] = value
            yield headers, f.read(int(headers["Content-Length"]))
            f.read(len(END))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files: type, record_id, refers_to, target_uri, date, content_type, block_digest, digest_ok, block."""
    names = ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Block-Digest"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse(content.as_py()):
                    rows.append((*(headers.get(k) for k in names), headers.get("WARC-Block-Digest") == sha1(block), block.decode()))
                    if len(rows) == 1000:
                        yield table(rows)
                        rows = []
                yield table(rows)

    def table(rows: list) -> pa.RecordBatch:
        kinds = [pa.string()] * 7 + [pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(9)], ["type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "digest_ok", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, digest_ok boolean, block string")


def field_of(block, name: str):
    """A field of a warc-fields block; empty if it is missing."""
    return F.regexp_extract(block, rf"(?:^|\n){name}: ([^\r\n]*)", 1)


def linked(records: DataFrame) -> DataFrame:
    """One row per metadata record: page_id, response_id, conversion_id, metadata_id, digests and figures of the conversion.

    A metadata record names its conversion; the two are joined by that id, without the texts.
    """
    block = F.col("block")
    about = records.filter("type = 'metadata'").select(
        F.col("record_id").alias("metadata_id"), F.col("refers_to").alias("response_id"), field_of(block, "page-id").alias("page"), field_of(block, "conversion-record").alias("conversion_id"),
        field_of(block, "source-payload-digest").alias("payload_digest"), field_of(block, "source-payload-length").cast("bigint").alias("payload_bytes"),
        field_of(block, "source-http-status").alias("http_status"), F.col("digest_ok").alias("metadata_ok"),
    )
    texts = records.filter("type = 'conversion'").select(
        F.col("record_id").alias("conversion_id"), F.col("refers_to").alias("conversion_refers_to"), "target_uri", F.col("block_digest").alias("text_digest"), F.col("digest_ok").alias("text_ok"),
        F.length("block").cast("bigint").alias("text_chars"), F.sha2(block.cast("binary"), 256).alias("text_sha256"),
    )
    out = about.join(texts.dropDuplicates(["conversion_id"]), "conversion_id", "left")
    return out.withColumn("page_id", F.when(F.col("page") != "", F.col("page")).cast("bigint")).drop("page")
