"""WARC derivatives: every response record becomes a metadata record and a plain-text conversion
record that refer to it.

Both derived records carry WARC-Refers-To with the response's id, its target URI and date, and the
sha1 digest of its payload; the conversion record's own digest covers its text. The metadata block
is JSON: title, links (as written, in order), the response's HTTP status line and headers, payload
digest and length, and the id of the conversion record, so the three records are linked both ways.
Record ids are derived from the response's id, so reruns agree.

Text of a page: comments, scripts, styles, templates and the head are taken out, tags of block
elements become line breaks, other tags vanish, character references are resolved, white space
inside a line becomes one space, and empty lines go. A ``<`` that starts no tag stays. A head ends
at its end tag or, as in HTML, before the first text or tag that cannot stand in a head. Of a
noscript, template or title in the head without an end tag only the tag goes; an unclosed comment,
script or style reaches to the end of the page, as in HTML. Cost grows linearly with the page.

Files: ``write_warc`` writes one gzip member per record, a file per task under a random name; only
files that a successful task returns enter the manifest. ``read_warc`` streams files back into
records of any type, with text blocks and the columns ``FIELDS``, or with ``raw=True`` with the bytes
of every block and all headers (``RAW_FIELDS``), which ``write_warc`` writes back as they were.
``split_responses`` cuts raw response blocks into HTTP head and payload bytes for ``derive``. Digest and
length are those of the payload bytes; for the text they are decoded by byte order mark, HTTP or
meta charset, else as UTF-8, else as windows-1252. Transfer and content codings are not undone.

Edge cases. Null html: an empty payload, empty text. Null url: no target URI. Null page_id: the id
comes from url and payload alone. Repeated rows give repeated records with the same ids. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_batches, written
from .record_files import _filesystem, _uri

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
DATE = "1970-01-01T00:00:00Z"
FIELDS = ("warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
          "content_type string, payload_digest string, block_digest string, content_length long, block string")

#: what a tag holds: a quoted value may hold any sign; a quote that is never closed is a sign like others
_INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
#: what a page is cut at: a comment, a script or style with its text, a tag, other markup. A tag without
#: an end runs to the end of the page and is text; taken whole, so that no sign is looked at again.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?![^\s/>])" + _INSIDE + r">.*?(?:</\1\s*>|\Z)"
                    r"|<(/?)([A-Za-z][^\s/>]*+)" + _INSIDE + r"(>?)|<[/!?][^>]*+(?:>|\Z)", re.I | re.S)
#: elements that are skipped up to their own end tag; title counts inside a head only
_PAIRED = {"noscript", "template", "title"}
_VOID_IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta"}
#: ``FIELDS`` of records as they are: block bytes, and all headers in order
RAW_FIELDS = FIELDS.removesuffix("block string") + "block binary, headers array<struct<name:string,value:string>>"

_HEAD_END = re.compile(rb"\r?\n\r?\n")
_CHARSET = re.compile(r"""charset\s*=\s*["']?\s*([^\s"';,/>]+)""", re.I)
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_TITLE_END = re.compile(r"</title\s*>", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?""")
#: elements that stand on lines of their own
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure",
          "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section",
          "select", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(m: re.Match) -> str:
    """A tag's name in lower case; empty for other tokens and for a tag without an end."""
    return m[3].lower() if m[3] and m[4] else ""


def _skipped(page: str) -> list[tuple[int, int]]:
    """Spans of a page that are not text, by start; they may overlap."""
    spans, tags, ends = [], [], {}
    open_at: dict[str, list[int]] = {name: [] for name in _PAIRED}
    for m in _TOKEN.finditer(page):
        name = _name(m)
        if m[3] and not name:
            continue
        tags.append((m.start(), m.end(), "/" if m[2] else "", name))
        if not name and (m[1] or page.startswith("<!--", m.start())):
            spans.append(m.span())
        elif name in _PAIRED and not m[2]:
            open_at[name].append(m.start())
        elif name in _PAIRED and open_at[name]:
            ends[open_at[name].pop()] = m.end()
    head = at = None  # start of the open head, end of what is known to belong to it
    for start, end, slash, name in tags:
        if head is not None and start >= at:
            if page[at:start].strip() or (name in ("body", "br", "html") if slash else name and name not in _PAIRED | _VOID_IN_HEAD):
                spans.append((head, at))
                head = None
            elif slash and name == "head":
                spans.append((head, end))
                head = None
            else:
                at = end if slash else ends.get(start, end)
        elif head is None and name == "head" and not slash:
            head, at = start, end
        if name in ("noscript", "template") and start in ends:
            spans.append((start, ends[start]))
    if head is not None:
        spans.append((head, at))
    return sorted(spans)


def _shown(page: str) -> str:
    parts, at = [], 0
    for start, end in _skipped(page):
        if start >= at:
            parts.append(page[at:start])
        at = max(at, end)
    return " ".join([*parts, page[at:]])


def page_text(page: str) -> str:
    def cut(m: re.Match) -> str:
        if m[3] and not m[4] or m[0][-1] != ">":
            return m[0]
        return "\n" if _name(m) in _BLOCK else ""

    body = _TOKEN.sub(cut, _shown(page))
    lines = (" ".join(x.split()) for x in html.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


def page_facts(page: str) -> tuple[str | None, list[str]]:
    """(title or None, links as written). A title inside svg is that of the drawing."""
    title, links, drawing = None, [], 0
    for m in _TOKEN.finditer(page):
        name = _name(m)
        if name == "svg" and not m[0].endswith("/>"):
            drawing = max(0, drawing + (-1 if m[2] else 1))
        elif name == "title" and not m[2] and title is None and not drawing:
            end = _TITLE_END.search(page, m.end())
            title = " ".join(html.unescape(page[m.end():end.start()]).split()) if end else None
        elif name == "a" and not m[2]:
            for key, *values in _ATTRIBUTE.findall(m[0], m.end(3) - m.start(), len(m[0]) - 1):
                if key.lower() == "href":
                    links.append(html.unescape(values[0] or values[1] or values[2]))
                    break
    return title, links


def _header_text(data: bytes) -> str:
    """Header bytes as text: UTF-8 where they are, else one character per byte."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def payload_text(payload: bytes, head: str | None) -> str:
    """A payload's text, by byte order mark, declared charset, UTF-8 or windows-1252."""
    content_type = re.search(r"^content-type\s*:(.*)$", head or "", re.I | re.M)
    named = [n for b, n in _BOMS if payload.startswith(b)]
    for place in (content_type[1] if content_type else "", payload[:1024].decode("latin-1")):
        named += _CHARSET.findall(place)[:1]
    for name in named:
        try:
            name = codecs.lookup(name).name
            if name in ("iso8859-1", "ascii"):  # as browsers read these labels
                name = "cp1252"
            return payload.decode(name, "replace").encode("utf-8", "replace").decode()
        except (LookupError, ValueError):
            pass
    try:
        return payload.decode()
    except UnicodeDecodeError:
        return payload.decode("cp1252", "replace")


def split_block(block: bytes) -> tuple[str | None, bytes]:
    """HTTP head (None if the block has none) and payload bytes of a response block."""
    if not block.startswith(b"HTTP/"):
        return None, block
    end = _HEAD_END.search(block)
    return (_header_text(block[:end.start()]), block[end.end():]) if end else (_header_text(block), b"")


def split_responses(records: DataFrame) -> DataFrame:
    """Source of ``derive`` from raw records: record_id, target_uri, date, http_head, payload bytes of
    every response record."""
    base = records.where(F.lower("warc_type") == "response").select("record_id", "target_uri", "date", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in clean_batches(batches, 8 << 20):
            parts = [split_block(x or b"") for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([h for h, _ in parts], pa.string()), pa.array([x for _, x in parts], pa.binary())],
                names=["record_id", "target_uri", "date", "http_head", "payload"])

    return base.mapInArrow(run, "record_id string, target_uri string, date string, http_head string, payload binary")


def _derived_id(response: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{kind} {response}'.encode()).digest()[:16], version=5)}>"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html): page_id, record_id, target_uri, date,
    http_head, payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    h = F.sha1(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), F.col("url").cast("string"), F.sha1(payload)))
    part = lambda a, n: F.substring(h, a, n)
    rid = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3),
                   F.lit("-"), part(21, 12), F.lit(">"))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").cast("string").alias("target_uri"),
                        F.lit(date).alias("date"), F.lit(HTTP_HEAD).alias("http_head"), payload.alias("payload"))


def derive(source: DataFrame, keep: list[str]) -> DataFrame:
    """Metadata and conversion records, two rows per response: the columns ``keep`` and ``FIELDS``.
    ``source`` has record_id, target_uri, date, http_head, payload (text or bytes)."""
    base = source.select(*keep, "record_id", "target_uri", "date", "http_head", "payload")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, *[f.split()[0] for f in FIELDS.split(", ")]]
        for b in clean_batches(batches, 8 << 20):
            rows: list[tuple] = []
            for rid, uri, date, head, payload in zip(*(b.column(n + k).to_pylist() for k in range(5))):
                raw = payload.encode() if isinstance(payload, str) else payload or b""
                payload = payload if isinstance(payload, str) else payload_text(raw, head)
                status, *fields = re.sub(r"\r?\n[ \t]+", " ", head or "").replace("\r\n", "\n").split("\n")
                meta, conv = _derived_id(rid, "metadata"), _derived_id(rid, "conversion")
                title, links = page_facts(payload)
                text, source_digest = page_text(payload), digest(raw)
                facts = json.dumps({
                    "title": title, "links": links, "status": status,
                    "headers": [[k, v.strip()] for k, _, v in (f.partition(":") for f in fields if f)],
                    "payload_digest": source_digest, "payload_length": len(raw), "conversion": conv}, ensure_ascii=False)
                for kind, own, with_, ctype, block in (("metadata", meta, conv, "application/json", facts),
                                                       ("conversion", conv, meta, "text/plain", text)):
                    data = block.encode()
                    rows.append((kind, own, rid, with_, uri, date, ctype, source_digest, digest(data), len(data), block))
            twice = pa.array([i for i in range(b.num_rows) for _ in (0, 1)], pa.int64())
            columns = [pa.array(c, pa.int64() if k == 9 else pa.string()) for k, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([b.column(k).take(twice) for k in range(n)] + columns, names=names)

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:n]] + [FIELDS])
    return base.mapInArrow(run, ddl)


# ------------------------------------------------------------------ files

_HEADERS = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
            ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
            ("Content-Type", "content_type"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest")]


def record_bytes(row: dict) -> bytes:
    block = row["block"] or b""
    block = block.encode() if isinstance(block, str) else block
    column = {h.lower(): c for h, c in _HEADERS} | {"content-length": "content_length"}
    # headers without a column, and further ones of a repeated name
    more = [(h["name"], h["value"]) for h in row.get("headers") or []
            if h["name"].lower() not in column or h["name"].lower() == "warc-concurrent-to" and h["value"] != row["concurrent_to"]]
    head = ["WARC/1.1", *[f"{h}: {v}" for h, v in more], *[f"{h}: {row[c]}" for h, c in _HEADERS if row[c] is not None],
            f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(stream, raw: bool = False) -> Iterator[dict]:
    """Records of an uncompressed WARC byte stream, any version and type; blocks as text, or with
    ``raw`` as bytes with all headers."""
    by_name = {h.lower(): c for h, c in _HEADERS}
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        row: dict = {c: None for _, c in _HEADERS}
        size, headers = 0, []
        while (line := stream.readline()).strip():
            if line[:1] in (b" ", b"\t") and headers:  # a folded header goes on
                headers[-1]["value"] += " " + _header_text(line).strip()
                continue
            name, _, value = _header_text(line).partition(":")
            headers.append({"name": name.strip(), "value": value.strip()})
        for h in headers:
            name, value = h["name"].lower(), h["value"]
            if name == "content-length":
                size = int(value)
            elif name in by_name:
                row[by_name[name]] = value
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        row["content_length"], row["block"] = size, block if raw else block.decode("utf-8", "replace")
        if raw:
            row["headers"] = headers
        yield row


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write records (columns ``FIELDS``, or ``RAW_FIELDS``) as ``*.warc.gz``; returns the manifest (file, records)."""
    folder = _uri(folder)
    names = [f.split()[0] for f in FIELDS.split(", ")] + [c for c in ("headers",) if c in records.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        out, name, n = None, "", 0
        for b in clean_batches(batches, 8 << 20):
            for row in b.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(gzip.compress(record_bytes(row), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "records"])

    return written(records.select(*names).mapInArrow(run, "file string, records long"), "warc-manifest")


def read_warc(spark: SparkSession, files: DataFrame, rows: int = 256, raw: bool = False) -> DataFrame:
    """Records (columns ``FIELDS``, or ``RAW_FIELDS`` with ``raw``) of the files named in column
    ``file``, ``rows`` at a time. Text blocks suit derived records; responses need ``raw``."""
    names = [f.split()[0] for f in (RAW_FIELDS if raw else FIELDS).split(", ")]
    types = {"content_length": pa.int64(), "headers": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))}
    if raw:
        types["block"] = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(part: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], types.get(c, pa.string())) for c in names],
                                              names=names)
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, path = _filesystem(_uri(file))
                with fs.open_input_file(path) as packed, gzip.GzipFile(fileobj=packed) as f:
                    part: list[dict] = []
                    for row in parse_records(f, raw):
                        part.append(row)
                        if len(part) == rows:
                            yield cut(part)
                            part = []
                    if part:
                        yield cut(part)

    # as many tasks as files: their rows are few bytes, by which partitions would be merged
    dealt = files.select("file").repartition(max(1, files.count()), F.xxhash64("file"))
    return dealt.mapInArrow(run, RAW_FIELDS if raw else FIELDS)
