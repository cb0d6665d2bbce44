"""WARC derivatives: from response records to metadata and conversion records.

A WARC record is kept as a row with its bytes as text: header lines, a blank
line and the block.  ``derive`` parses response records, checks their digests,
and makes of each

* a ``metadata`` record, JSON: the source's WARC headers, its HTTP status and
  headers, payload length and digest, and what the page says of itself (title,
  meta entries, links),
* a ``conversion`` record, plain text: what a reader of the page sees.

Both name the response in WARC-Refers-To, share its target and date, and carry
digests of their own block and of the source's payload.  Record ids are
name-based UUIDs of what they identify, so a rerun gives the same records.
Each response is worked on alone in one narrow pass; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausefold.llm.common import binary

#: The date of records made from pages, which say nothing of their capture.
CAPTURED = "2020-01-01T00:00:00Z"
#: What ends a record in a file.
RECORD_END = "\r\n\r\n"

# Elements without readable content, and those that break lines.
_SILENT = ("script", "style", "title", "noscript", "template", "svg", "iframe", "object", "textarea", "select")
# of the silent ones, those that hold no markup: unclosed, they run to the end
_RAW = ("script", "style", "title", "textarea")
_BREAKING = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section table tbody td tfoot th thead tr ul".split())

# the alternatives begin differently, so no text is tried twice; an attribute
# value may hold a closing bracket
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|</([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>|<[!?][^<>]*>""", re.S)
_END = {name: re.compile(rf"</{name}\b[^<>]*>", re.I) for name in _SILENT}
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][a-zA-Z0-9_:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_BLANK = re.compile(r"[ \t\r\f\v ]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _line(value: str) -> str:
    """A header value: no control characters, which could end the line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), value)


def build(headers: list[tuple[str, str]], block: bytes) -> str:
    """A record without its end; Content-Length is put last."""
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block.decode("utf-8", "surrogatepass")


def _headers(text: str) -> list[tuple[str, str]]:
    pairs = (line.partition(":") for line in text.split("\r\n") if ":" in line)
    return [(k.strip(), v.strip()) for k, _, v in pairs]


def parse(record: str) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a record; the block as long as it says."""
    head, _, block = record.partition("\r\n\r\n")
    headers = _headers(head.partition("\r\n")[2])
    raw = block.encode("utf-8", "surrogatepass")
    length = dict((k.lower(), v) for k, v in headers).get("content-length", "")
    return headers, raw[: int(length)] if length.isdigit() else raw


def response_record(key: str, url: str | None, page: str | None) -> str:
    """The response record of a stored page; a null page has an empty payload,
    a null address gives no target."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = [("WARC-Target-URI", url)] if url is not None else []
    return build([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "", digest(payload))), ("WARC-Date", CAPTURED), *target,
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http + payload))], http + payload)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), entities.unescape(next((v for v in values if v), "")))
    return out


def read_page(page: str, base: str) -> tuple[str, dict]:
    """The readable text of a page, and what it says of itself."""
    out: list[str] = []
    links: list[dict] = []
    meta: list[dict] = []
    unclosed: set[str] = set()
    title, language, at = None, "", 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:  # inside an element that is passed over
            continue
        out.append(page[at : m.start()])
        at = m.end()
        opened, closed = (m[1] or "").lower(), (m[3] or "").lower()
        if opened in _BREAKING or closed in _BREAKING:
            out.append("\n")
        if not opened:
            continue
        # an element's own links are read before it is passed over
        own = _attributes(m[2]) if m[2].strip(" /\t\r\n") else {}
        for name in ("href", "src"):
            if own.get(name):
                try:
                    address = urljoin(base, own[name])
                except ValueError:
                    address = own[name]
                links.append({"path": f"{opened}@/{name}", "url": address})
        if opened in _SILENT and not m[2].endswith("/"):
            end = _END[opened].search(page, at) if opened in _RAW or opened not in unclosed else None
            if opened == "title" and title is None:
                title = page[at : end.start() if end else len(page)]
            if end or opened in _RAW:
                at = end.end() if end else len(page)
            else:
                # nothing closes it, nor any other of its kind that follows
                unclosed.add(opened)
            continue
        if opened == "html":
            language = own.get("lang", "")
        elif opened == "meta" and own:
            meta.append(own)
    out.append(page[at:])
    lines = (_BLANK.sub(" ", line).strip() for line in entities.unescape("".join(out)).split("\n"))
    about = {"title": " ".join(entities.unescape(title or "").split()), "language": language, "metas": meta, "links": links}
    return "\n".join(line for line in lines if line), about


def derivatives(record: str) -> list[dict]:
    """The metadata and the conversion record of a response record, as rows;
    none if the record is no response."""
    headers, block = parse(record)
    named = {k.lower(): v for k, v in headers}
    if named.get("warc-type", "").lower() != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, lines = head.decode("utf-8", "replace").partition("\r\n")
    http = _headers(lines)
    source, target = named.get("warc-record-id", ""), named.get("warc-target-uri")
    found = digest(payload)
    kind = dict((k.lower(), v) for k, v in http).get("content-type", "")
    text, about = read_page(payload.decode("utf-8", "replace"), target or "") if "html" in kind or not kind else (payload.decode("utf-8", "replace"), {})
    envelope = {
        # in their order, repeated ones too
        "source_headers": headers,
        "http": {"status": status, "headers": http},
        "payload": {"length": len(payload), "digest": found, "digest_matches": named.get("warc-payload-digest", found) == found},
        "page": about,
    }
    out = []
    for name, content, data in (
        ("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")),
        ("conversion", "text/plain", text.encode("utf-8", "replace")),
    ):
        own = record_id(name, source, found)
        uri = [("WARC-Target-URI", target)] if target is not None else []
        made = build([
            ("WARC-Type", name), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Date", named.get("warc-date", CAPTURED)), *uri,
            ("Content-Type", content), ("WARC-Source-Payload-Digest", found), ("WARC-Block-Digest", digest(data))], data)
        out.append({"warc_type": name, "record_id": own, "refers_to": source, "target_uri": target, "source_digest": found,
                    "block_digest": digest(data), "block_length": len(data), "record": made})
    return out


_ROW = [
    T.StructField("warc_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("source_digest", T.StringType()), T.StructField("block_digest", T.StringType()),
    T.StructField("block_length", T.LongType()), T.StructField("record", T.StringType()),
]


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record) for every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("page_id")
            text = [response_record(str(k), u, h) for k, u, h in zip(keys.to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(text, pa.string())], names=["page_id", "record"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, record string")


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response record of (page_id, record): page_id, then
    warc_type, record_id, refers_to, target_uri, source_digest, block_digest,
    block_length and the record itself.

    Records of another type and null records give no rows; equal responses
    give equal derivatives; a page of any length is one record, and broken
    markup is read as far as it can be.  An empty table gives no rows.
    """
    kind = records.schema["page_id"].dataType
    schema = T.StructType([T.StructField("page_id", kind), *_ROW])
    names = [f.name for f in _ROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("page_id")
            owner: list[int] = []
            rows: list[dict] = []
            for i, raw in enumerate(binary(batch.column("record"))):
                if raw is not None:
                    made = derivatives(raw.decode())
                    rows.extend(made)
                    owner.extend([i] * len(made))
            columns = [pa.array([r[n] for r in rows], pa.int64() if n == "block_length" else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), *columns], names=["page_id", *names])

    return records.select("page_id", "record").mapInArrow(run, schema)


def write_files(records: DataFrame, path: str) -> None:
    """Write the ``record`` column as gzipped WARC files: Spark's text writer
    puts the record end where others have a line end."""
    records.select("record").write.option("lineSep", RECORD_END).option("compression", "gzip").mode("overwrite").text(path)


def derivative_digest(pages: DataFrame) -> DataFrame:
    """The derivatives of all pages, by way of their response records: two rows
    for each row of ``pages``, repeated ones too.  A null page is an empty one,
    a null address gives no target; an empty table gives no rows, and other
    columns play no part."""
    return derive(responses(pages))
