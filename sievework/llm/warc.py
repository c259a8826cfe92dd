"""WARC derivatives: metadata and plain-text conversion records of responses."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievework.llm.work import column

#: Fixed values of the format.
VERSION, WET_TYPE, FIELDS_TYPE = "WARC/1.0", "text/plain", "application/warc-fields"
CRLF = b"\r\n"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType(), False),
        T.StructField("record_type", T.StringType(), False),
        T.StructField("refers_to", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("headers", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("block_digest", T.StringType(), False),
        T.StructField("content_length", T.LongType(), False),
        T.StructField("block", T.BinaryType(), False),
    ]
)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    """The same record gets the same identifier again, as when a lost task is done anew."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join((kind, *parts)))}>"


def split_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and payload of an HTTP message. Without an empty line all is payload."""
    m = re.search(rb"\r?\n\r?\n", block)
    if not block.startswith(b"HTTP/") or m is None:
        return "", [], block
    status, *lines = re.split(rb"\r?\n", block[: m.start()])
    fields: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and fields:  # a folded line goes on with the one before
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip().decode('latin-1')}")
        elif b":" in line:
            name, value = line.split(b":", 1)
            fields.append((name.strip().decode("latin-1"), value.strip().decode("latin-1")))
    return status.decode("latin-1"), fields, block[m.end() :]


# The text encodings that pages may have, by Python's names; any other, and what is no text encoding, is read as UTF-8.
ENCODINGS = frozenset(
    (
        "ascii utf-8 utf-8-sig utf-16 utf-16-le utf-16-be cp866 cp874 mac-roman mac-cyrillic koi8-r koi8-u tis-620 hz gbk gb2312 gb18030 big5 big5hkscs euc_jp shift_jis cp932 iso2022_jp euc_kr cp949 "
        "iso8859-1 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-9 iso8859-10 iso8859-11 iso8859-13 iso8859-14 iso8859-15 iso8859-16 "
        "cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258"
    ).split()
)


def charset(fields: list[tuple[str, str]], payload: bytes) -> str:
    """The payload's encoding: as its header says, else its first meta element that names one, else UTF-8."""
    said = next((v for n, v in fields if n.lower() == "content-type"), "")
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", said, re.I)
    if not found:
        metas = re.finditer(rb"<meta\b((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>", payload[: payload.rfind(b">") + 1], re.I)
        found = next((x for m in metas if (x := re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", m[1].decode("latin-1"), re.I))), None)
    try:
        known = codecs.lookup(found[1]).name in ENCODINGS if found else False
    except (LookupError, ValueError):
        known = False
    return found[1] if known else "utf-8"


#: Elements whose content is no text of the page. RAW ones without an end tag go on to the end of the page; the others are
#: dropped only if they end. Nothing else in a head is text of it: any other text or element ends the head, with or without
#: its end tag.
RAW = frozenset(("script", "style", "title"))
_REST = r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+"  # of a tag: a quoted value may hold its end's sign
_HIDDEN = re.compile(rf"<!--|<(script|style|title|noscript|template|svg)\b({_REST})>", re.I)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "title", "noscript", "template", "svg")}
_BREAK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|section|article|main|header|footer|nav|aside|blockquote|pre|form|td|th)\b" + _REST + ">", re.I)
_TAG = re.compile(rf"</?[A-Za-z!?]{_REST}>")


def visible(page: str) -> str:
    """A page without comments and hidden elements; each place is looked at once, however many of them never end."""
    parts, at, endless = [], 0, set()
    tags = page.rfind(">") + 1  # nothing after it is a tag
    while m := _HIDDEN.search(page, at, tags):
        parts.append(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            parts.append(" ")
            continue
        tag = m[1].lower()
        end = None if tag in endless or (tag == "svg" and m[2].endswith("/")) else _ENDS[tag].search(page, at)
        if end:
            at = end.end()
        elif tag in RAW:
            at = len(page)
        elif not m[2].endswith("/"):
            endless.add(tag)
        parts.append(" ")
    comment = page.find("<!--", max(at, tags))
    parts.append(page[at:] if comment < 0 else page[at:comment])
    return "".join(parts)


def plain_text(page: str) -> str:
    """All visible text of a page, a line per block."""
    text = visible(page)
    tags = text.rfind(">") + 1
    lines = (" ".join(html.unescape(x).split()) for x in (_TAG.sub("", _BREAK.sub("\n", text[:tags])) + text[tags:]).split("\n"))
    return "\n".join(x for x in lines if x)


def links(page: str) -> list[str]:
    found = (re.search(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", m[1], re.I) for m in re.finditer(rf"<a\b({_REST})>", page[: page.rfind(">") + 1], re.I))
    return [html.unescape(m[1] or m[2] or m[3] or "") for m in found if m]


def title(page: str) -> str:
    m = re.search(rf"<title\b{_REST}>", page[: page.rfind(">") + 1], re.I)
    end = re.compile("</title", re.I).search(page, m.end()) if m else None
    return " ".join(html.unescape(page[m.end() : end.start()]).split()) if m and end else ""


def derived(source_id: str, uri: str | None, date: str | None, block: bytes) -> list[dict]:
    """The metadata record and the conversion record of one response."""
    status, fields, payload = split_response(block)
    page = re.sub("[\ud800-\udfff]", "\ufffd", payload.decode(charset(fields, payload), "replace"))
    payload_digest = sha1(payload)
    headers = [{"name": n, "value": v} for n, v in fields]
    text = plain_text(page).encode()
    meta = record_id("metadata", source_id, payload_digest)
    conversion = record_id("conversion", source_id, payload_digest)
    said = [("status", status), ("source-block-digest", sha1(block)), ("source-payload-digest", payload_digest), ("source-length", str(len(block)))]
    said += [(f"source-header-{n.lower()}", v) for n, v in fields]
    said += [("charset", charset(fields, payload)), ("title", title(page)), *[("outlink", x) for x in links(page)], ("text-digest", sha1(text))]
    lines = b"".join(f"{n}: {' '.join(v.split())}".encode() + CRLF for n, v in said if v)
    common = {"refers_to": source_id, "target_uri": uri, "date": date, "headers": headers}
    return [
        common | {"record_id": meta, "record_type": "metadata", "concurrent_to": conversion, "content_type": FIELDS_TYPE, "payload_digest": payload_digest, "block_digest": sha1(lines), "content_length": len(lines), "block": lines},
        common | {"record_id": conversion, "record_type": "conversion", "concurrent_to": meta, "content_type": WET_TYPE, "payload_digest": payload_digest, "block_digest": sha1(text), "content_length": len(text), "block": text},
    ]


def response_block(page: str) -> bytes:
    """An HTTP response that carries a page, for tables that hold pages without their headers."""
    body = page.encode()
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def derivatives(responses: DataFrame, source_id: str = "record_id", uri: str = "target_uri", date: str = "date", block: str = "block", keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response: metadata and plain-text conversion, which refer to it and name each other.

    `responses` has an identifier, an address, a date and the block of an HTTP
    response (bytes, or text as UTF-8). The records keep the source's header
    fields and digests. A payload is decoded as its header or meta element says,
    if that is one of ENCODINGS, else as UTF-8; what isn't decodable becomes
    U+FFFD. Columns `keep` are carried along, but for those with a name of the records'
    own. Each response is done
    by itself, so nothing is shuffled. A null block is empty, its records have
    empty blocks but for digests; a null identifier gives records that refer to
    an identifier made from the address. Repeated rows give repeated records.
    """
    kept = [responses.schema[c] for c in keep if c not in RECORD.fieldNames()]
    schema = T.StructType([*kept, *RECORD.fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uris, dates, blocks = (column(batch, c).to_pylist() for c in (source_id, uri, date, block))
            carried = [column(batch, c).to_pylist() for c in names]
            for i in range(0, len(ids), 200):
                rows, at = [], []
                for k in range(i, min(i + 200, len(ids))):
                    body = blocks[k] or b""
                    found = derived(ids[k] or record_id("response", uris[k] or ""), uris[k], dates[k], body.encode() if isinstance(body, str) else bytes(body))
                    rows += found
                    at += [k] * len(found)
                made = pa.Table.from_pylist(rows, schema=ARROW)
                yield pa.RecordBatch.from_arrays([*[pa.array([c[k] for k in at], batch.schema.field(n).type) for c, n in zip(carried, names, strict=True)], *[x.combine_chunks() for x in made.columns]], names=[*names, *ARROW.names])

    return responses.select(*dict.fromkeys([*names, source_id, uri, date, block])).mapInArrow(run, schema)


ARROW = pa.schema(
    [
        *[(n, pa.string()) for n in ("record_id", "record_type", "refers_to", "concurrent_to", "target_uri", "date", "content_type")],
        ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        *[(n, pa.string()) for n in ("payload_digest", "block_digest")],
        ("content_length", pa.int64()),
        ("block", pa.binary()),
    ]
)


def serialised(record: dict) -> bytes:
    """One record in the file format, uncompressed."""
    head = [("WARC-Type", record["record_type"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["date"]), ("WARC-Record-ID", record["record_id"])]
    head += [("WARC-Refers-To", record["refers_to"]), ("WARC-Concurrent-To", record["concurrent_to"]), ("WARC-Payload-Digest", record["payload_digest"]), ("WARC-Block-Digest", record["block_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", str(record["content_length"]))]
    fields = b"".join(f"{n}: {v}".encode() + CRLF for n, v in head if v)
    return VERSION.encode() + CRLF + fields + CRLF + record["block"] + CRLF + CRLF


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed or gzipped (per record) file."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.strip():
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, value = line.decode().split(":", 1)
            fields[name] = value.strip()
        yield fields, stream.read(int(fields["Content-Length"]))
