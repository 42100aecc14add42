"""Path predicates: scope, extension allow-list, exclude patterns with subtree pruning, depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .globs import path_glob_to_regex
from .text import col_

# The indexed file extensions (case-sensitive) and the built-in exclude patterns.
IMAGE_EXTENSIONS = ("png", "jpeg", "jpg", "gif", "webp")
BUILTIN_EXCLUDES = ("*/.cache", "*/.thumb*")


def like_escape(root: str) -> str:
    """The reference's LIKE pattern for a root: ``#`` escapes itself, ``%`` and ``_``; then ``%``."""
    return root.replace("#", "##").replace("%", "#%").replace("_", "#_") + "%"


def in_scope(path: Column | str, root: str | None, prefix_like: bool = False) -> Column:
    """Rows under ``root``.

    Default: the real subtree (``path = root`` or starts with ``root/``), which Spark pushes to the
    Parquet scan as a string-prefix filter. ``prefix_like=True`` gives the reference's rule: a plain
    case-insensitive (ASCII) prefix without separator, so ``/a/b`` also covers ``/a/bc``.
    """
    p = col_(path)
    if root is None:
        return F.lit(True)
    if prefix_like:
        return F.ilike(p, F.lit(like_escape(root)), F.lit("#"))
    r = root.rstrip("/") or "/"
    if r == "/":
        return F.startswith(p, F.lit("/"))
    return (p == F.lit(r)) | F.startswith(p, F.lit(r + "/"))


def extension(path: Column | str) -> Column:
    """Text after the last dot of the file name ('' when none)."""
    return F.regexp_extract(col_(path), r"\.([^./]+)$", 1)


def has_allowed_extension(path: Column | str, extensions=IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def exclude_patterns(user: list[str] | tuple[str, ...] = (), builtin: bool = True) -> list[str]:
    """Index-time excludes: built-ins plus each user pattern ``x`` as ``*/x``."""
    return (list(BUILTIN_EXCLUDES) if builtin else []) + [f"*/{x}" for x in user]


def ancestors_or_self(path: Column | str, root: str) -> Column:
    """``root``, every folder between it and the file, and the file itself (folders above the root
    are not part of the walk and are not returned)."""
    p = col_(path)
    r = root.rstrip("/")
    depth_root = len([s for s in r.split("/") if s]) + 1 if r else 1
    parts = F.split(p, "/")
    return F.transform(
        F.sequence(F.lit(depth_root), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"),
    )


def excluded(path: Column | str, root: str, patterns: list[str]) -> Column:
    """True when the path or any folder on the walk from ``root`` matches a pattern (subtree pruning)."""
    if not patterns:
        return F.lit(False)
    rx = "|".join(f"(?:{path_glob_to_regex(p)})" for p in patterns)
    return F.exists(ancestors_or_self(path, root), lambda a: a.rlike(rx))


def glob_match(path: Column | str, pattern: str) -> Column:
    return col_(path).rlike(path_glob_to_regex(pattern))


def search_excluded(path: Column | str, pattern: str) -> Column:
    """Search-time exclude: ``pattern + '/**'`` as given (no ``*/`` prefix), as the reference does."""
    return glob_match(path, pattern + "/**")


def parent(path: Column | str) -> Column:
    return F.regexp_extract(col_(path), r"^(.*)/[^/]*$", 1)


def at_depth_one(path: Column | str, root: str) -> Column:
    """Files directly in ``root`` (single-level listing)."""
    r = root.rstrip("/")
    return parent(path) == F.lit(r)


def strip_scheme(path: Column | str) -> Column:
    """``file:/x`` / ``file:///x`` -> ``/x``; other schemes stay as they are."""
    return F.regexp_replace(col_(path), r"^file:(//)?(?=/)", "")
