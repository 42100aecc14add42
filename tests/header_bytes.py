"""Image headers that carry the sizes of the F1 view."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hex_be(v: Column, nbytes: int) -> Column:
    return F.lpad(F.hex(v.cast("long")), 2 * nbytes, "0")


def _hex_le(v: Column, nbytes: int) -> Column:
    be = _hex_be(v, nbytes)
    return F.concat(*[F.substring(be, 2 * i + 1, 2) for i in reversed(range(nbytes))])


def header_bytes(images_df: DataFrame) -> DataFrame:
    """``(id, path, fmt, content binary)``: a real header for each allowed-extension row, carrying
    its width and height — PNG, GIF, JPEG (JFIF + SOF0) and WebP (VP8X / VP8 / VP8L by id % 3)."""
    w, h, i = F.col("width"), F.col("height"), F.col("id")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex_be(w, 4), _hex_be(h, 4), F.lit("0802000000"), F.lit("00000000"))
    gif = F.concat(F.lit("474946383961"), _hex_le(w, 2), _hex_le(h, 2), F.lit("F70000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), F.lit("FFC0001108"), _hex_be(h, 2), _hex_be(w, 2),
                    F.lit("03012200021101031101"), F.lit("FFD9"))
    vp8x = F.concat(F.lit("52494646"), _hex_le(F.lit(22), 4), F.lit("57454250"), F.lit("56503858"), _hex_le(F.lit(10), 4),
                    F.lit("00000000"), _hex_le(w - 1, 3), _hex_le(h - 1, 3))
    vp8 = F.concat(F.lit("52494646"), _hex_le(F.lit(22), 4), F.lit("57454250"), F.lit("56503820"), _hex_le(F.lit(10), 4),
                   F.lit("9D0100"), F.lit("9D012A"), _hex_le(w, 2), _hex_le(h, 2))
    vp8l = F.concat(F.lit("52494646"), _hex_le(F.lit(22), 4), F.lit("57454250"), F.lit("5650384C"), _hex_le(F.lit(5), 4),
                    F.lit("2F"), _hex_le((w - 1) + F.shiftleft((h - 1).cast("long"), 14), 4))
    webp = F.when(i % 3 == 0, vp8x).when(i % 3 == 1, vp8).otherwise(vp8l)
    hexs = (F.when(ext == "png", png).when(ext == "gif", gif).when(ext.isin("jpg", "jpeg"), jpeg)
            .when(ext == "webp", webp))
    fmt = F.when(ext.isin("jpg", "jpeg"), F.lit("jpeg")).otherwise(ext)
    return images_df.where(hexs.isNotNull()).select("id", "path", fmt.alias("fmt"), F.unhex(hexs).alias("content"))
