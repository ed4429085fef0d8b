"""Derived WARC records: linked metadata and plain-text conversions of responses.

Every response gives a ``metadata`` record (title, language, outlinks and the source's HTTP headers and
digests as warc-fields) and a ``conversion`` record with its text. Both refer to the response by its record
id, URI and date. Identifiers are made from the source's identifier, so a task that runs twice makes the same
records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.llm.common import batches_of

VERSION = "WARC/1.1"
_END = "\r\n"

_HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S
)
_BREAKS = re.compile(
    r"</?(?:p|br|div|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|section|article|header|footer|nav|main|aside|blockquote"
    r"|pre|form|hr|figure|figcaption|title|body|html|option)\b[^<>]*>",
    re.I,
)
_CELLS = re.compile(r"</?(?:td|th)\b[^<>]*>", re.I)
_TAGS = re.compile(r"<[a-z/!?][^<>]*>", re.I)
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LANGUAGE = re.compile(r"<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINKS = re.compile(r"<a\s[^<>]*?href\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)


def plain_text(page: str) -> str:
    """The visible text of a page: a line for every block, single spaces, no empty lines."""
    shown = _HIDDEN.sub(" ", page)
    shown = _CELLS.sub(" ", _BREAKS.sub("\n", shown.replace("\r", "\n").replace("\n", " ")))
    shown = html.unescape(_TAGS.sub("", shown))
    lines = (" ".join(line.split()) for line in shown.split("\n"))
    return "\n".join(line for line in lines if line)


def outlinks(page: str, base: str) -> list[str]:
    """Absolute targets of the page's links, each once, in order. A target that is no URI is left as it is."""
    found: dict[str, None] = {}
    for match in _LINKS.finditer(_HIDDEN.sub(" ", page)):
        target = html.unescape(next(filter(None, match.groups()), "")).strip()
        try:
            found[urljoin(base, target)] = None
        except ValueError:
            found[target] = None
    return list(found)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(source_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source_id}')}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _fields(pairs: list[tuple[str, str | None]]) -> str:
    return "".join(f"{name}: {_one_line(value)}{_END}" for name, value in pairs if value)


def _derived(record_id: str, uri: str, date: str, headers: str, body: str) -> Iterator[dict]:
    payload = body.encode("utf-8", "replace")
    payload_digest = digest(payload)
    block_digest = digest(f"{headers}{_END}{_END}".encode("utf-8", "replace") + payload)
    status, *lines = headers.split(_END)
    title = _TITLE.search(body)
    language = _LANGUAGE.search(body)
    source = [tuple(line.partition(":")[::2]) for line in lines if ":" in line]
    about = [("title", html.unescape(title.group(1)) if title else None), ("language", language and language.group(1))]
    about += [("source-status", status), ("source-payload-digest", payload_digest), ("source-block-digest", block_digest)]
    about += [(f"source-header-{name.strip().lower()}", value) for name, value in source]
    about += [("outlink", target) for target in outlinks(body, uri)]
    blocks = {
        "metadata": ("application/warc-fields", _fields(about)),
        "conversion": ("text/plain; charset=utf-8", plain_text(body)),
    }
    for kind, (content_type, block) in blocks.items():
        # a lone surrogate, as numeric references can make, is no UTF-8
        data = block.encode("utf-8", "replace")
        own = derived_id(record_id, kind)
        head = _fields(
            [
                ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri),
                ("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
                ("WARC-Block-Digest", digest(data)), ("WARC-Source-Payload-Digest", payload_digest),
                ("Content-Type", content_type), ("Content-Length", str(len(data))),
            ]
        )
        yield {
            "record_type": kind, "record_id": own, "refers_to": record_id, "target_uri": uri, "date": date,
            "content_type": content_type, "block_digest": digest(data), "source_payload_digest": payload_digest,
            "header": f"{VERSION}{_END}{head}", "block": data.decode(), "content_length": len(data),
        }


_RECORD = pa.schema(
    [
        ("key", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
        ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("block_digest", pa.string()),
        ("source_payload_digest", pa.string()), ("header", pa.string()), ("block", pa.string()),
        ("content_length", pa.int64()),
    ]
)
_RECORD_TYPE = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in _RECORD)
#: Derived records are handed on as soon as they hold so many characters.
_HELD = 1 << 25


def derive(responses: DataFrame) -> DataFrame:
    """Two records for every row of ``responses`` (key, record_id, target_uri, date, headers, body).

    ``headers`` is the HTTP status line and headers, lines ended by CR LF. Null texts count as empty; without a
    target URI the fields that would hold it are left out. Repeated rows give repeated records with equal
    identifiers. The result has the parts of each record: its ``header`` (every line ended), its ``block``,
    and the fields that link it. Other columns are not looked at.
    """

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(frame):
            rows: list[dict] = []
            held = 0
            for row in batch.to_pylist():
                texts = [row[name] or "" for name in ("record_id", "target_uri", "date", "headers", "body")]
                rows += [{"key": row["key"], **record} for record in _derived(*texts)]
                held += sum(len(record["block"]) for record in rows[-2:])
                if held > _HELD:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _RECORD)

    names = ["record_id", "target_uri", "date", "headers", "body"]
    kept = responses.select(F.col("key").cast("bigint").alias("key"), *[F.col(n).cast("string").alias(n) for n in names])
    return kept.mapInArrow(run, _RECORD_TYPE)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records for rows (page_id, url, html), as a crawl of ``date`` would have stored them."""
    name = F.md5(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), "url").cast("binary"))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    length = F.octet_length(F.coalesce("html", F.lit("")))
    return pages.select(
        F.col("page_id").alias("key"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.concat_ws(
            _END, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
            F.concat(F.lit("Content-Length: "), length.cast("string")),
        ).alias("headers"),
        F.col("html").alias("body"),
    )


def write_records(records: DataFrame, path: str) -> None:
    """Write derived records as gzipped WARC files, one or more for each task.

    A record is its header, an empty line and its block; two line ends close it, which is what the text
    writer puts after every row.
    """
    record = F.concat("header", F.lit(_END), "block").alias("value")
    records.select(record).write.option("lineSep", _END * 2).option("compression", "gzip").text(path)
