"""Sizes from header bytes: every format, long leading segments, and no query on made-up headers."""

import struct

import __spark_entry__ as E
from header_bytes import header_bytes

from scanlens.sources import fixtures as fx
from scanlens.sources import headers as H

SF = "/root/testdata/sf0.001"


def test_no_query_reads_made_up_headers():
    assert "png_dims" not in E.queries() and "dim_filter" in E.queries() and not hasattr(fx, "header_bytes")


def test_sizes_of_every_format(spark):
    images = fx.images(spark, SF)
    want = {r.id: (r.width, r.height) for r in images.collect()}
    rows = H.dimensions(header_bytes(images)).collect()
    assert len(rows) > 50 and {r.id: (r.width, r.height) for r in rows} == {r.id: want[r.id] for r in rows}


def test_jpeg_files_with_many_long_leading_segments(spark, tmp_path):
    want = {}
    for n in range(6):
        jpeg = b"\xff\xd8"
        for k in range(n):  # a frame marker inside a segment is none
            jpeg += b"\xff" * k + b"\xff" + bytes([0xE0 + k]) + struct.pack(">H", 65535) + b"\xff\xc0\x00\x11\x08\x00\x01\x00\x01" + b"\0" * 65524
        jpeg += b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", 100 + n, 200 + n) + b"\x03" + b"\0" * 20
        (tmp_path / f"{n}.jpg").write_bytes(jpeg)
        want[str(tmp_path / f"{n}.jpg")] = (200 + n, 100 + n)
    files = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: (r.width, r.height) for r in H.file_dimensions(files).collect()} == want
    blobs = spark.createDataFrame([(p, open(p, "rb").read()) for p in want], "path string, content binary")
    assert {r.path: (r.width, r.height) for r in H.dimensions(blobs).collect()} == want


def tiff_file(pages, order="<", big=False, gap=0):
    """A file of page directories with ``gap`` bytes of picture data before each (as a hole on disk)."""
    wide, counted, entry = ("Q", "Q", "HHQ") if big else ("I", "H", "HHI")
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16 + gap) if big else struct.pack(order + "HI", 42, 8 + gap))
    parts, at = [(0, head)], len(head) + gap
    for k, (w, h) in enumerate(pages):
        tags = [(254, 4, 0), (256, 3, w), (257, 16 if big else 4, h)]
        body = struct.pack(order + counted, len(tags))
        for tag, kind, v in tags:
            size = {3: "H", 4: "I", 16: "Q"}[kind]
            body += struct.pack(order + entry, tag, kind, 1) + struct.pack(order + size, v).ljust(struct.calcsize("=" + wide), b"\0")
        end = at + len(body) + struct.calcsize("=" + wide)
        body += struct.pack(order + wide, end + gap if k + 1 < len(pages) else 0)
        parts.append((at, body))
        at = end + gap
    return parts


def test_tiff_pages_by_ranged_reads(spark, tmp_path):
    sizes = [(165, 67), (3000, 70000), (1, 2)]
    want = {}
    for order in "<>":
        for big in (False, True):
            for gap in (0, 700_000_000):
                path = tmp_path / f"{'l' if order == '<' else 'b'}{big}{gap}.tif"
                with open(path, "wb") as f:
                    for at, body in tiff_file(sizes, order, big, gap):
                        f.seek(at)
                        f.write(body)
                want[str(path)] = [(k, w, h) for k, (w, h) in enumerate(sizes)]
                if not gap:
                    assert H.tiff_pages_of(path.read_bytes()) == want[str(path)]
    loop = bytearray(b"".join(body for _, body in tiff_file(sizes[:1])))
    loop[-4:] = struct.pack("<I", 8)
    cut = b"".join(body for _, body in tiff_file(sizes))[:60]
    odd = {"loop.tif": (bytes(loop), [(0, 165, 67)]), "cut.tif": (cut, [(0, 165, 67), (1, None, None)]), "not.tif": (b"nothing", []), "none.tif": (b"", [])}
    for name, (data, pages) in odd.items():
        (tmp_path / name).write_bytes(data)
        want[str(tmp_path / name)] = pages
    want[str(tmp_path / "missing.tif")] = []
    files = spark.createDataFrame([(7, p) for p in want] + [(7, None)], "k int, path string")
    got = {p: [] for p in want}
    for r in H.tiff_file_pages(files).orderBy("path", "page").collect():
        assert r.k == 7
        got[r.path].append((r.page, r.width, r.height))
    assert got == want
