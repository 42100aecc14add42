"""Data-quality columns carried over from the recognition bindings: raw-buffer check (P19),
resolution fallback (P20), box validity (P21), language-code check (P7), size spec (P1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# The accepted source resolution range and the outcome labels of the buffer check.
MIN_DPI = 70
MAX_DPI = 2400
BUF_OK = "ok"
BUF_MEMORY = "exceeds memory"
BUF_IMAGE = "exceeds image size"
BUF_LINE = "exceeds line"


def buffer_check(length, width, height, bytes_per_pixel, bytes_per_line) -> Column:
    """Raw image buffer of ``length`` bytes for a ``width`` x ``height`` image.

    Refused when ``height * bytes_per_line`` exceeds the buffer; for 1-bit images
    (``bytes_per_pixel = 0``) when ``width > bytes_per_line * 8``; otherwise when
    ``width * bytes_per_pixel > bytes_per_line``. The claimed size is a 32-bit product; when it is
    negative (after 32-bit wrap-around) it cannot be a size: "exceeds memory".
    """
    n, w, h, bpp, bpl = (col_(c).cast("long") for c in (length, width, height, bytes_per_pixel, bytes_per_line))
    need = F.pmod(h * bpl + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return (
        F.when(need.isNull() | (need < 0), F.lit(BUF_MEMORY))
        .when(need > n, F.lit(BUF_IMAGE))
        .when((bpp == 0) & (w > bpl * 8), F.lit(BUF_LINE))
        .when((bpp != 0) & (w * bpp > bpl), F.lit(BUF_LINE))
        .otherwise(F.lit(BUF_OK))
    )


def dpi_or_fallback(dpi, fallback: int) -> Column:
    d = col_(dpi)
    return F.when(d.between(MIN_DPI, MAX_DPI), d).otherwise(F.lit(fallback))


def box_is_valid(w, h) -> Column:
    """A box is refused when a size is negative (zero sizes are kept)."""
    return (col_(w) >= 0) & (col_(h) >= 0)


def lang_ok(code) -> Column:
    """Exactly three bytes, all ASCII, no ``.``, ``/`` or ``\\``."""
    c = col_(code)
    return (
        c.isNotNull()
        & (F.octet_length(c) == 3)
        & c.rlike("^[\\x00-\\x7F]*$")
        & ~c.rlike("[./\\\\]")
    )


def lang_normalised(code) -> Column:
    return F.when(lang_ok(code), F.lower(col_(code)))


def parse_size_spec(spec: str) -> tuple[int, int]:
    """``"WxH"`` -> (W, H); anything else is an error."""
    parts = spec.split("x")
    if len(parts) != 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"a size is given as WIDTHxHEIGHT in pixels, not {spec!r}")
    return int(parts[0]), int(parts[1])


def within_size(width, height, spec: str) -> Column:
    """Keep when ``width <= W`` and ``height <= H`` (equal is kept); unknown size is dropped."""
    w, h = parse_size_spec(spec)
    return col_(width).isNotNull() & col_(height).isNotNull() & (col_(width) <= w) & (col_(height) <= h)
