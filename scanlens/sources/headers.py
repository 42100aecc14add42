"""Image size from header bytes (P2) and TIFF page directories.

PNG, GIF and the three WebP variants are fixed-offset fields: read natively from ``hex`` of the
first bytes. JPEG needs a marker walk and TIFF a linked list of page directories, so those two
walk in Python. ``file_dimensions`` probes files on disk before anything else of them is read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_

HEAD_BYTES = 64


def _hex_head(content: Column) -> Column:
    return F.hex(F.substring(content, 1, HEAD_BYTES))


def _byte_hex(h: Column, offset: int, n: int) -> Column:
    """Hex digits of ``n`` bytes at 0-based byte ``offset``."""
    return F.substring(h, 2 * offset + 1, 2 * n)


def _be(h: Column, offset: int, n: int) -> Column:
    return F.conv(_byte_hex(h, offset, n), 16, 10).cast("long")


def _le(h: Column, offset: int, n: int) -> Column:
    parts = [_byte_hex(h, offset + i, 1) for i in reversed(range(n))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def image_format(content: Column | str) -> Column:
    h = _hex_head(col_(content))
    return (
        F.when(F.startswith(h, F.lit("89504E470D0A1A0A")), F.lit("png"))
        .when(F.startswith(h, F.lit("474946383761")) | F.startswith(h, F.lit("474946383961")), F.lit("gif"))
        .when(F.startswith(h, F.lit("52494646")) & (_byte_hex(h, 8, 4) == F.lit("57454250")), F.lit("webp"))
        .when(F.startswith(h, F.lit("FFD8")), F.lit("jpeg"))
        .when(F.startswith(h, F.lit("49492A00")) | F.startswith(h, F.lit("4D4D002A"))
              | F.startswith(h, F.lit("49492B00")) | F.startswith(h, F.lit("4D4D002B")), F.lit("tiff"))
    )


def native_dimensions(content: Column | str) -> Column:
    """``struct<width long, height long>`` for PNG, GIF and WebP (VP8X, VP8, VP8L); null otherwise."""
    h = _hex_head(col_(content))
    fmt = image_format(content)
    chunk = _byte_hex(h, 12, 4)
    vp8l = _le(h, 21, 4)
    width = (
        F.when(fmt == "png", _be(h, 16, 4))
        .when(fmt == "gif", _le(h, 6, 2))
        .when((fmt == "webp") & (chunk == F.lit("56503858")), _le(h, 24, 3) + 1)  # VP8X
        .when((fmt == "webp") & (chunk == F.lit("56503820")), _le(h, 26, 2).bitwiseAND(0x3FFF))  # VP8
        .when((fmt == "webp") & (chunk == F.lit("5650384C")), vp8l.bitwiseAND(0x3FFF) + 1)  # VP8L
    )
    height = (
        F.when(fmt == "png", _be(h, 20, 4))
        .when(fmt == "gif", _le(h, 8, 2))
        .when((fmt == "webp") & (chunk == F.lit("56503858")), _le(h, 27, 3) + 1)
        .when((fmt == "webp") & (chunk == F.lit("56503820")), _le(h, 28, 2).bitwiseAND(0x3FFF))
        .when((fmt == "webp") & (chunk == F.lit("5650384C")), F.shiftright(vp8l, 14).bitwiseAND(0x3FFF) + 1)
    )
    return F.struct(width.alias("width"), height.alias("height"))


def jpeg_size(read: Callable[[int, int], bytes]) -> tuple[int, int] | None:
    """(width, height) from the first start-of-frame segment, or None.

    ``read(offset, n)`` gives bytes of the file; segments are skipped by their stored length, so only
    a few bytes of each are read, however long the ones before the frame header are.
    """
    if read(0, 2) != b"\xff\xd8":
        return None
    at = 2
    while True:
        head = read(at, 4)
        if len(head) < 2:
            return None
        if head[0] != 0xFF or head[1] == 0xFF:  # fill bytes
            at += 1
            continue
        marker = head[1]
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # no payload
            at += 2
            continue
        if marker in (0xD9, 0xDA) or len(head) < 4:  # picture data or the end came first
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            frame = read(at + 5, 4)
            return (int.from_bytes(frame[2:4], "big"), int.from_bytes(frame[0:2], "big")) if len(frame) == 4 else None
        at += 2 + int.from_bytes(head[2:4], "big")


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def jpeg_dimensions(content: pd.Series) -> pd.DataFrame:
    sizes = [None if b is None else jpeg_size(lambda o, n, b=b: bytes(b[o:o + n])) for b in content]
    return pd.DataFrame({"width": [s[0] if s else None for s in sizes],
                         "height": [s[1] if s else None for s in sizes]}, dtype="Int64")


def dimensions(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds ``width`` and ``height`` (null when the header cannot be read). The pandas path runs
    only for JPEG rows."""
    c = F.col(content_col)
    nat = native_dimensions(c)
    is_jpeg = image_format(c) == "jpeg"
    jp = F.when(is_jpeg, jpeg_dimensions(F.when(is_jpeg, c)))
    return df.withColumn("width", F.coalesce(nat["width"], jp["width"])).withColumn(
        "height", F.coalesce(nat["height"], jp["height"]))


def file_dimensions(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds ``width`` and ``height`` to a table of paths from a few header bytes of each file: the
    first 64 for fixed-offset formats, a seek from segment to segment for JPEG. The rest of a file
    is not read; an unreadable file has null sizes."""
    from .listing import filesystem

    names = [*files.columns, "_head", "_w", "_h"]
    at = files.columns.index(path_col)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields] + ["_head binary, _w long, _h long"])

    def probe(path: str) -> tuple[bytes | None, int | None, int | None]:
        try:
            fs, inner = filesystem(path)
            with fs.open_input_file(inner) as f:
                size = f.size()
                read = lambda o, n: f.read_at(min(n, size - o), o) if o < size else b""
                w, h = jpeg_size(read) or (None, None)
                return read(0, HEAD_BYTES), w, h
        except OSError:
            return None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [probe(p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64()),
                 pa.array([g[2] for g in got], pa.int64())], names=names)

    native = native_dimensions("_head")
    return (files.mapInArrow(run, ddl).withColumn("width", F.coalesce(native["width"], "_w"))
            .withColumn("height", F.coalesce(native["height"], "_h")).drop("_head", "_w", "_h"))


# ---------------------------------------------------------------- TIFF pages

TIFF_PAGE_SCHEMA = "page int, width long, height long"
# Tags of a page's width and height.
_SIZE_TAGS = (256, 257)
#: directory entries read at once, pages of a batch
_ENTRIES, _PAGES = 512, 4096


def tiff_directories(read: Callable[[int, int], bytes]) -> Iterator[tuple[int, int | None, int | None]]:
    """(page, width, height) for each page directory, classic or 64-bit; a broken chain ends the walk.
    ``read(offset, n)`` gives up to n bytes; nothing but the directories is read."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        return
    # sizes of an offset, of a directory's entry count and of an entry
    wide, counted, entry = (8, 8, 20) if head[2:4] == struct.pack(order + "H", 43) else (4, 2, 12)
    number = {2: "H", 4: "I", 8: "Q"}

    def value(b: bytes, n: int) -> int | None:
        return struct.unpack(order + number[n], b[:n])[0] if len(b) >= n else None

    at, seen, page = value(head[8:16] if wide == 8 else head[4:8], wide), set(), 0
    while at and at not in seen:
        seen.add(at)
        n = value(read(at, counted), counted)
        if n is None:
            return
        sizes: dict[int, int | None] = {}
        for first in range(0, n, _ENTRIES):
            block = read(at + counted + entry * first, entry * min(_ENTRIES, n - first))
            for e in range(0, len(block) - entry + 1, entry):
                tag, kind = struct.unpack(order + "HH", block[e:e + 4])
                if tag in _SIZE_TAGS:
                    sizes[tag] = value(block[e + 4 + wide:e + entry], {3: 2, 16: wide}.get(kind, 4))
            if len(sizes) == 2 or len(block) < entry * min(_ENTRIES, n - first):
                break
        yield page, sizes.get(_SIZE_TAGS[0]), sizes.get(_SIZE_TAGS[1])
        page += 1
        at = value(read(at + counted + entry * n, wide), wide)


def tiff_pages_of(b: bytes | None) -> list[tuple[int, int | None, int | None]]:
    """The page directories of a file held as bytes."""
    return list(tiff_directories(lambda o, n: bytes(b[o:o + n]))) if b else []


def tiff_file_pages(files: DataFrame, path_col: str = "path") -> DataFrame:
    """The columns of ``files`` and ``(page, width, height)``, one row per page of each file, by seeking in
    the opened file from directory to directory: picture data is never read, so files of any size
    do. Other files and unreadable ones have no rows."""
    from .listing import filesystem

    at = files.columns.index(path_col)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields] + [TIFF_PAGE_SCHEMA])
    names = [*files.columns, "page", "width", "height"]

    def walk(path: str | None) -> Iterator[tuple[int, int | None, int | None]]:
        if path is None:
            return
        try:
            fs, inner = filesystem(path)
            with fs.open_input_file(inner) as f:
                size = f.size()
                yield from tiff_directories(lambda o, n: f.read_at(min(n, size - o), o) if o < size else b"")
        except OSError:
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column(at).to_pylist()):
                pages = walk(path)
                while some := list(islice(pages, _PAGES)):
                    own = batch.take(pa.array([k] * len(some)))
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array([s[0] for s in some], pa.int32()), pa.array([s[1] for s in some], pa.int64()),
                         pa.array([s[2] for s in some], pa.int64())], names=names)

    return files.mapInArrow(run, ddl)


def tiff_pages(df: DataFrame, key_cols: list[str], content_col: str = "content") -> DataFrame:
    """One row per page of each multi-page TIFF: ``(<keys>, page, width, height)``; asking past the
    last page simply finds no row."""
    keys = list(key_cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                d = rec._asdict()
                for page, w, h in tiff_pages_of(d[content_col]):
                    rows.append({**{k: d[k] for k in keys}, "page": page, "width": w, "height": h})
            yield pd.DataFrame(rows, columns=keys + ["page", "width", "height"])

    return df.select(*keys, content_col).mapInPandas(run, f"{schema}, {TIFF_PAGE_SCHEMA}")
