"""WARC derivatives: metadata and plain-text conversion records of HTTP responses.

Every response record gives one ``metadata`` and one ``conversion`` record. Both name the response
in WARC-Refers-To, keep its target URI and date, and carry the digests of the source's block and
payload next to their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.runtime import ready, table, tidy

VERSION = "WARC/1.1"
#: Date of responses made from pages, which have none of their own.
PAGE_DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
# Elements whose content is raw text, elements that are not shown, and elements that begin a new line.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style noscript template svg title iframe noembed noframes".split())
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav main body html blockquote pre hr td th".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
#: HTTP and WARC fields of the source that the metadata record repeats under these prefixes.
HTTP_PREFIX, WARC_PREFIX = "http-", "source-"

_SCHEMA = "id {kind}, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, header string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A stable URN for a record, from what it stands for."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join(parts))}>"


def _tag(page: str, at: int) -> tuple[str, dict[str, str], int]:
    """Name, attributes and end of the tag whose name starts at ``at``; an end of -1 means it is never closed."""
    name = _NAME.match(page, at)
    at, found = name.end(), {}
    while True:
        part = _ATTRIBUTE.match(page, at)
        at = part.end()
        if at >= len(page):
            return name[0].lower(), found, -1
        if page[at] == ">":
            if part[1]:
                found.setdefault(part[1].lower(), "")
            return name[0].lower(), found, at + 1
        value, sign = "", _EQUALS.match(page, at)
        if sign:
            at = sign.end()
            if page[at : at + 1] in ('"', "'") and at < len(page):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return name[0].lower(), found, -1
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        if part[1]:
            found.setdefault(part[1].lower(), value)


def pieces(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """The page in order as (kind, what, attributes): ``text``, ``raw`` (undecoded text), ``open`` and ``close``.

    One pass from left to right; every character is looked at a bounded number of times. Tags and
    comments that never end take the rest of the page with them.
    """
    at = 0
    while at < len(page):
        sign = page.find("<", at)
        if sign < 0:
            yield "text", page[at:], {}
            return
        after = page[sign + 1 : sign + 2]
        closing = after == "/" and page[sign + 2 : sign + 3].isascii() and page[sign + 2 : sign + 3].isalpha()
        if not closing and after not in ("!", "?", "/") and not (after.isascii() and after.isalpha()):
            yield "text", page[at : sign + 1], {}
            at = sign + 1
            continue
        if sign > at:
            yield "text", page[at:sign], {}
        if page.startswith("<!--", sign):
            end = page.find("-->", sign + 4)
            at = end + 3 if end >= 0 else len(page)
        elif not closing and after in ("!", "?", "/"):
            end = page.find(">", sign + 2)
            at = end + 1 if end >= 0 else len(page)
        else:
            name, attributes, at = _tag(page, sign + 1 + closing)
            if at < 0:
                return
            yield "close" if closing else "open", name, attributes
            if not closing and name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                yield "raw", page[at : end.start() if end else len(page)], {}
                at = end.start() if end else len(page)


def read_page(page: str) -> tuple[str, list[tuple[str, str]]]:
    """Visible text and the metadata fields of a page: title, language, links out, in page order.

    Elements that are not shown are left out, blocks stand on lines of their own, entities are
    decoded, blanks squeezed and empty lines dropped.
    """
    one_line = lambda s: " ".join(html.unescape(s).split())
    shown: list[str] = []
    title = language = None
    links, hidden = [], []
    for kind, what, attributes in pieces(page):
        if kind == "open":
            if what == "html" and language is None and attributes.get("lang"):
                language = attributes["lang"].strip().lower()
            if what == "a" and "href" in attributes and not hidden:
                links.append(("outlink", one_line(attributes["href"])))
            if what in BLOCKS and not hidden:
                shown.append("\n")
            if what == "body":
                hidden.clear()
            elif what in HIDDEN and what not in _VOID:
                hidden.append(what)
            last = what
        elif kind == "close":
            if what in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(what) :]
            if what in BLOCKS and not hidden:
                shown.append("\n")
        elif kind == "raw" and last == "title" and title is None and "svg" not in hidden:
            title = one_line(what)
        elif not hidden:
            shown.append(html.unescape(what) if kind == "text" or last == "textarea" else what)
    lines = (_BLANKS.sub(" ", line).strip() for line in "".join(shown).split("\n"))
    fields = [("title", title)] * (title is not None) + [("language", language)] * (language is not None)
    return "\n".join(line for line in lines if line), fields + links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def fields_of(page: str) -> list[tuple[str, str]]:
    return read_page(page)[1]


def header_fields(header: str) -> list[tuple[str, str]]:
    """Names and values of a header block; continued lines are joined, the start line is named ``status``."""
    out: list[tuple[str, str]] = []
    for k, line in enumerate(header.replace("\r\n", "\n").split("\n")):
        if not line.strip():
            continue
        if line[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif k == 0 and line.startswith(("HTTP/", "WARC/")):
            out.append(("status", line.strip()))
        else:
            name, sign, value = line.partition(":")
            if sign and name.strip():
                out.append((name.strip(), value.strip()))
    return out


def header_of(pairs: list[tuple[str, str | None]]) -> str:
    """The record's header; line breaks inside a value become blanks, absent values no line."""
    return "\r\n".join([VERSION, *(f"{k}: {' '.join(str(v).split())}" for k, v in pairs if v is not None)]) + "\r\n\r\n"


def serialise(header: str, block: bytes) -> bytes:
    """One gzip member, as WARC files concatenate them."""
    return gzip.compress(header.encode() + block + b"\r\n\r\n", mtime=0)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of concatenated members."""
    raw = gzip.decompress(data)
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        begin = end + 4
        size = int(head["Content-Length"])
        yield head, raw[begin : begin + size]
        at = begin + size + 4


def derivatives(source_id: str | None, uri: str | None, date: str | None, http: str, payload: str, warc: str = "") -> Iterator[tuple[str, str, str, dict, str]]:
    """(type, record id, header, header values, block) of both records.

    Digests that the source's WARC header gives are taken as they are, others computed. The
    metadata record repeats the source's HTTP and WARC fields after those of the page.
    """
    body = payload.encode("utf-8", "replace")
    given = header_fields(warc)
    named = {k.lower(): v for k, v in given}
    source = {
        "block": named.get("warc-block-digest") or digest(http.encode("utf-8", "replace") + body),
        "payload": named.get("warc-payload-digest") or digest(body),
    }
    text, fields = read_page(payload)
    fields += [(HTTP_PREFIX + k.lower(), v) for k, v in header_fields(http)] + [(WARC_PREFIX + k.lower(), v) for k, v in given if k != "status"]
    made = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)),
        "conversion": ("text/plain; charset=utf-8", text),
    }
    for kind, (content_type, block) in made.items():
        data = block.encode("utf-8", "replace")
        own = record_id(kind, "|".join((source_id or "", uri or "", date or "", source["payload"], source["block"])))
        values = {"content_type": content_type, "content_length": len(data), "block_digest": digest(data), **source}
        yield kind, own, header_of(
            [
                ("WARC-Type", kind),
                ("WARC-Record-ID", own),
                ("WARC-Refers-To", source_id),
                ("WARC-Refers-To-Target-URI", uri),
                ("WARC-Refers-To-Date", date),
                ("WARC-Target-URI", uri),
                ("WARC-Date", date),
                ("WARC-Warcinfo-ID", named.get("warc-warcinfo-id")),
                ("WARC-IP-Address", named.get("warc-ip-address") if kind == "metadata" else None),
                ("WARC-Block-Digest", values["block_digest"]),
                ("X-Source-Block-Digest", source["block"]),
                ("X-Source-Payload-Digest", source["payload"]),
                ("Content-Type", content_type),
                ("Content-Length", str(len(data))),
            ]
        ), values, data.decode()


def _derived(schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0)
                rows: list[tuple] = []
                take: list[int] = []
                for i, (source, uri, date, http, payload, warc) in enumerate(zip(*(part.column(k).to_pylist() for k in range(1, 7)), strict=True)):
                    for kind, own, header, v, block in derivatives(source, uri, date, http or "", payload or "", warc or ""):
                        take.append(i)
                        rows.append((kind, own, source, uri, date, v["content_type"], v["content_length"], v["block_digest"], v["block"], v["payload"], header, block))
                if rows:
                    columns = [pa.array(c, type=pa.int64() if k == 6 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(take)), *columns], names=names)

    return tidy(run)


def derive(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records.

    ``responses`` has ``id``, ``record_id``, ``target_uri``, ``warc_date``, ``http_header`` (null:
    none), ``payload`` (null: empty) and may have ``warc_header``, the source record's own header lines:
    its digests are preserved and its fields, like the HTTP header's, become fields of the metadata
    record. Two rows per row come back, repeats included; null values leave their header lines out.
    A record's id is made from the kind, the source's id, URI and date and its digests, so responses
    without an id, or two of one id, have records of their own; rows that are equal in all of these
    are the same response twice and give the same records twice.
    Other columns are not read. Nothing is shuffled and an empty table gives an empty result.
    """
    ready(responses.sparkSession)
    schema = _SCHEMA.format(kind=dict(responses.dtypes)["id"])
    warc = F.col("warc_header") if "warc_header" in responses.columns else F.lit(None).cast("string").alias("warc_header")
    return responses.select("id", "record_id", "target_uri", "warc_date", "http_header", "payload", warc).mapInArrow(_derived(schema), schema)


def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = PAGE_DATE) -> DataFrame:
    """Response records of raw pages: stable record ids from page id and URL."""
    hexed = F.sha1(F.concat_ws("|", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))).cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), F.substring(hexed, 1, 8), F.lit("-"), F.substring(hexed, 9, 4), F.lit("-5"), F.substring(hexed, 14, 3), F.lit("-a"), F.substring(hexed, 18, 3), F.lit("-"), F.substring(hexed, 21, 12), F.lit(">"))
    size = F.octet_length(F.coalesce(F.col(html_col), F.lit(""))).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).alias("id"), urn.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), http.alias("http_header"), F.col(html_col).alias("payload"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every row of ``pages``."""
    return derive(responses_of(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


QUERIES = {"op9_warc": op9}
SQL: dict[str, str] = {}
