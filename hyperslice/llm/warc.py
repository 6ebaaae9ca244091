"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response's block is parsed to status line, source headers and body. Its metadata
record states them with the payload's digest, title and links; its conversion record
holds the body's plain text. Both refer to the response by WARC-Refers-To, keep its
target and date, and carry digests of their own blocks. Records can be read from and
written to WARC files (gzip members or plain).
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, distinct_names, read

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:hyperslice:warc")

#: Elements that begin a line of their own.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul body html".split())
#: Elements whose content isn't markup and never shows, those whose markup doesn't show, and those that a head can hold.
RAW = frozenset("script style iframe noembed noframes".split())
HIDDEN = frozenset("noscript template svg".split())
IN_HEAD = frozenset("head title meta link base style script noscript template basefont bgsound noframes".split())

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]{0,63}))")
_END = re.compile(r"[>\"']")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in (*RAW, "title")}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACES = re.compile(r"\s+")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_BEYOND = re.compile(r"&#[0-9]{8,};?")


def unescaped(text: str) -> str:
    """``text`` with its character references read; numbers beyond Unicode, however long, become U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_BEYOND.sub("\ufffd", _ZEROS.sub("&#", text)))


def digest(block: bytes) -> str:
    """``sha1:`` and base32, as WARC files have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


class Page:
    """One pass over a page: its visible lines, its title (or None) and the targets of its links.

    The pass never goes back: what a search has shown to be absent further on isn't looked
    for again, so any page takes time in proportion to its length. As browsers have it, an
    unclosed comment, script or style hides all that follows; a head ends at the latest
    with the first element or text that a head can't hold; a tag without an end is text;
    of other hidden elements that are never closed only the tag is left out.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.title: str | None = None
        self.links: list[str] = []
        self.absent: set[object] = set()
        self.quotes = True
        self.parts: list[str | None] = []  # None: a new line
        self.scan()

    def lines(self) -> list[str]:
        found, line = [], []
        for part in (*self.parts, None):
            if part is not None:
                line.append(part)
            elif line:
                text = " ".join(unescaped("".join(line)).split())
                found += [text] * (text != "")
                line = []
        return found

    def find(self, mark: str, at: int) -> int:
        if mark in self.absent:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.absent.add(mark)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag's > stands: outside quotes, as long as quotes are closed at all; -1 without one."""
        plain = self.find(">", at)
        if plain < 0 or not self.quotes:
            return plain
        while (m := _END.search(self.page, at)) is not None:
            if m[0] == ">":
                return m.start()
            shut = self.find(m[0], m.end())
            at = m.end() if shut < 0 else shut + 1
        self.quotes = False  # from here on quotes hide no end
        return plain

    def closing(self, name: str, at: int) -> re.Match | None:
        if name in self.absent:
            return None
        found = _CLOSE[name].search(self.page, at)
        if found is None:
            self.absent.add(name)
        return found

    def scan(self) -> None:
        page, parts, at = self.page, self.parts, 0
        head, hidden, depth, since = False, "", 0, 0
        while True:
            m = _OPEN.search(page, at)
            text = page[at : m.start() if m else len(page)]
            if text:
                if head and text.strip():
                    head = False
                if not head:
                    parts.append(_SPACES.sub(" ", text))
            if m is None:
                return
            at = m.end()
            if m[1]:
                shut = self.find("-->", m.start() + 2)
                if shut < 0:
                    return
                at = shut + 3
                continue
            if m[2]:
                shut = self.find("]]>", at)
                if shut >= 0:
                    parts.append(_SPACES.sub(" ", page[at:shut]))
                    at = shut + 3
                continue
            end = self.tag_end(at)
            if end < 0:
                parts.append(m[0])
                continue
            if m[4] is None:
                at = end + 1
                continue
            name, opens = m[4].lower(), not m[3]
            inside = page[at:end]
            at = end + 1
            if opens and name == "head":
                head = True
            elif name == "head" or (head and opens and name not in IN_HEAD):
                head = False
            if name in BLOCKS:
                parts.append(None)
            if opens and name == "a":
                for k, *v in _ATTRIBUTE.findall(inside):
                    if k.lower() == "href":
                        self.links.append(" ".join(unescaped(v[0] or v[1] or v[2]).split()))
                        break
            elif opens and (name in RAW or name == "title"):
                shut = self.closing(name, at)
                if shut is not None:
                    if name == "title" and self.title is None and hidden != "svg":
                        self.title = " ".join(unescaped(page[at : shut.start()]).split())
                    end = self.find(">", shut.end())
                    at = len(page) if end < 0 else end + 1
                elif name in RAW:
                    return
            elif name in HIDDEN:
                if opens and not hidden and not inside.endswith("/"):
                    hidden, depth, since = name, 1, len(parts)
                elif name == hidden and not (opens and inside.endswith("/")):
                    depth += 1 if opens else -1
                    if not depth:
                        del parts[since:]
                        hidden = ""


def plain_text(body: str) -> str:
    """Visible text: a line for each block element, white space within lines collapsed, empty lines left out."""
    return "\n".join(Page(body).lines())


def http_message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and body of a response block; without a status line all is body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return first, headers, body


def decoded(body: bytes, headers: list[tuple[str, str]]) -> str:
    """The body's text by the charset of its headers, else by UTF-8; what the charset lacks becomes U+FFFD."""
    kinds = [v for k, v in headers if k.lower() == "content-type"]
    named = re.search(r"charset=\"?([\w-]{1,40})", kinds[-1] if kinds else "", re.IGNORECASE)
    try:
        text = body.decode(named[1] if named else "utf-8", errors="replace")
    except (LookupError, ValueError):
        text = body.decode("utf-8", errors="replace")
    return text.encode("utf-8", "replace").decode()


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {record_id}')}>"


def derivatives(record_id: str, target: str, date: str, block: bytes) -> list[tuple[str, str, str, bytes]]:
    """(type, id, content type, block) of the metadata and the conversion record of a response."""
    status, headers, body = http_message(block)
    page = Page(decoded(body, headers))
    facts = [("http-status-line", status), ("payload-digest", digest(body)), ("payload-length", str(len(body)))]
    facts += [(f"http-header-{k.lower()}", v) for k, v in headers]
    facts += [("title", page.title)] if page.title is not None else []
    facts += [("outlink", link) for link in page.links]
    fields = "".join(f"{k}: {v}\r\n" for k, v in facts).encode()
    text = "\n".join(page.lines()).encode()
    return [
        ("metadata", derived_id(record_id, "metadata"), "application/warc-fields", fields),
        ("conversion", derived_id(record_id, "conversion"), "text/plain; charset=UTF-8", text),
    ]


def headers_of(kind: str, record_id: str, refers_to: str, target: str, date: str, content_type: str, block: bytes) -> dict[str, str]:
    named = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Refers-To": refers_to, "WARC-Target-URI": target, "WARC-Date": date}
    return {k: v for k, v in named.items() if v} | {"WARC-Block-Digest": digest(block), "Content-Type": content_type, "Content-Length": str(len(block))}


def serialised(headers: dict[str, str], block: bytes) -> bytes:
    """A record as WARC files hold it."""
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


GZIP = b"\x1f\x8b\x08"
CHUNK = 1 << 20


def unpacked(data: bytes) -> tuple[bytes, int]:
    """What the gzip members of ``data`` hold, in one pass, and how many of them are broken; after a broken one the next is looked for."""
    view, at, parts, broken = memoryview(data), 0, [], 0
    while at < len(data):
        start, member, made = at, zlib.decompressobj(31), []
        try:
            while not member.eof and at < len(data):
                chunk = view[at : at + CHUNK]
                made.append(member.decompress(chunk))
                at += len(chunk) - len(member.unused_data)
            good = member.eof
        except zlib.error:
            good = False
        parts += made
        if not good:
            broken += 1
            found = data.find(GZIP, start + 1)
            at = len(data) if found < 0 else found
    return b"".join(parts), broken


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, error) of each record of a WARC file, whose records may be gzip members.

    ``error`` says what is wrong with a record: no end of its headers, a length that is
    absent or no number, a block cut short. Reading goes on with the next record that
    begins behind it. Broken gzip members are told by a last row without headers.
    """
    broken = 0
    if data[:2] == GZIP[:2]:
        data, broken = unpacked(data)
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            yield {}, data[at:], "headers cut short"
            break
        lines = data[at:end].decode(errors="replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = headers.get("Content-Length", "")
        start = end + 4
        if not (length.isascii() and length.isdigit() and len(length) < 19):
            found = data.find(b"\r\n\r\nWARC/", end)
            at = found + 4 if found >= 0 else -1
            yield headers, data[start : found if found >= start else len(data) if found < 0 else start], "bad length"
            continue
        size = int(length)
        block = data[start : start + size]
        if len(block) < size:
            found = data.find(b"\r\n\r\nWARC/", end)
            at = found + 4 if found >= 0 else -1
            yield headers, block if found < 0 else data[start : max(start, found)], "cut short"
            continue
        yield headers, block, None
        at = data.find(b"WARC/", start + size)
    if broken:
        yield {}, b"", f"{broken} broken gzip members"


FIELDS = [("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_headers", pa.string()), ("source_digest", pa.string()), ("block", pa.string())]


def build_derivatives(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Two rows (a metadata and a conversion record) for each response row (record_id, target_uri, warc_date, block BINARY), with ``keys``.

    Null blocks are empty ones; null ids, targets and dates are empty strings. A block
    without a status line is all body. Bytes that the charset lacks are replaced.
    Repeated responses give repeated, equal records; an empty table none. Other columns are
    ignored; a key with the name of a result is refused.
    """
    distinct_names(keys, [n for n, _ in FIELDS])
    bounded_batches(responses.sparkSession)
    chosen = responses.select(*keys, "record_id", "target_uri", "warc_date", "block")
    head = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[: len(keys)])
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rows = [], []
            for i, (rid, target, date, block) in enumerate(zip(*(b.column(k + j).to_pylist() for j in range(4)), strict=True)):
                rid, target, date, block = rid or "", target or "", date or "", block or b""
                status, headers, body = http_message(block)
                source = "\n".join([status, *(f"{n}: {v}" for n, v in headers)])
                for kind, own, content_type, made in derivatives(rid, target, date, block):
                    rows.append(i)
                    out.append((kind, own, rid, target, date, content_type, len(made), digest(made), source, digest(body), made.decode(errors="replace")))
            columns = [pa.array([r[j] for r in out], t) for j, (_, t) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in b.columns[:k]), *columns], [*keys, *(n for n, _ in FIELDS)])

    types = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in FIELDS)
    return chosen.mapInArrow(run, f"{head}, {types}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``: (file, record_id, warc_type, target_uri, warc_date, refers_to, block, error).

    A file is read by one task as one value, of 2 GB at most. ``error`` is null for sound
    records; broken ones are rows too, as ``records`` says. An empty file has no rows.
    """
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "record_id", "warc_type", "target_uri", "warc_date", "refers_to"]
        wanted = ["WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Date", "WARC-Refers-To"]
        for b in batches:
            for file, data in zip(b.column(0), b.column(1), strict=True):
                for headers, block, error in records(data.as_buffer().to_pybytes()):
                    texts = [pa.array([v], pa.string()) for v in (file.as_py(), *map(headers.get, wanted))]
                    yield pa.RecordBatch.from_arrays([*texts, pa.array([block], pa.binary()), pa.array([error], pa.string())], [*names, "block", "error"])

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(run, "file string, record_id string, warc_type string, target_uri string, warc_date string, refers_to string, block binary, error string")


def to_warc(derived: DataFrame) -> DataFrame:
    """``derived`` with a column ``record`` (BINARY): each row serialised as a WARC record.

    Null fields are left out of the headers, a null block is an empty one. Repeated rows
    give repeated records, an empty table none; a column ``record`` of the input is refused.
    """
    distinct_names(derived.columns, ["record"])
    bounded_batches(derived.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            made = [serialised(headers_of(r["warc_type"], r["record_id"], r["refers_to"], r["target_uri"], r["warc_date"], r["content_type"], (r["block"] or "").encode()), (r["block"] or "").encode()) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, "record"])

    head = ", ".join(f"`{c}` {t}" for c, t in derived.dtypes)
    return derived.mapInArrow(run, f"{head}, record binary")


def responses_of_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response records of raw pages: the record's id follows from key and url, the block is an HTTP message around the page."""

    def urn(*parts: Column) -> Column:
        h = F.md5(F.concat_ws(" ", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
        pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))

    body = F.coalesce(F.col(page), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(key),
        urn(F.col(key), F.col(url)).alias("record_id"),
        F.col(url).alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        F.encode(F.concat(head, body), "UTF-8").alias("block"),
    )


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and the conversion record of every page; a null page is an empty one."""
    return build_derivatives(responses_of_pages(read(spark, sf_dir, "pages")), ["page_id"])
