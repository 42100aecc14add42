"""Folder listing (S1-S6, P3) and reading of listed files, both inside tasks.

The walk goes level by level: the folders of a level are spread over tasks, each task streams the
names of its folders, the names are dealt over tasks again, whatever folder they came from, and those
read times and sizes. So one huge folder is read by one task a name at a time, and its files are looked
at by all. A level is written to the shared folder. The driver only learns whether there is a next
level, so neither file names nor statuses gather there. Every entry is seen, also names that start
with ``.`` or ``_`` and empty files.

With ``memory``, a folder in which walks keep what they saw, a later walk of the same root opens only
folders that changed: it compares the marks (inode, time of change) of all folders it knows in one
pass, takes the names of unchanged ones from the last walk, and goes level by level only through
changed and new ones. Files are looked at in any case, since an edit in place leaves the folder as it is.
Other than local file systems give no mark for folders; there everything is listed each time.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import IMAGE_EXTENSIONS, exclude_patterns, excluded, has_allowed_extension
from ..session import checkpoint_dir

ENTRY_SCHEMA = "path string, modtime long, length long, is_dir boolean, error string"
#: with the resolved folders above a folder, from the root on, by which link loops are seen; the folder an
#: entry was found in; and, in rows about a listed folder itself, its mark
_WALK_SCHEMA = ENTRY_SCHEMA + ", above array<string>, folder string, mark string"
_WALK_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
_WALK_NAMES = [f.split()[0] for f in _WALK_SCHEMA.split(", ")]
_CHECKED_SCHEMA = "path string, above array<string>, here string, mark string, same boolean"
_CHECKED_TYPES = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_())
_CHECKED_NAMES = [f.split()[0] for f in _CHECKED_SCHEMA.split(", ")]
_ROWS = 10_000  # rows of a batch


def filesystem(path: str):
    """(file system, path inside it) for a plain path or a URI."""
    from pyarrow import fs as pafs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    # plain paths stay as they are (spaces and % are legal in names); URIs are parsed
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _is_local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def _batches(rows: Iterable[tuple], names: list[str], types: tuple) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(types)], names=names)

    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def _mark(inner: str) -> tuple[str, int]:
    """(mark of a local folder, its time of change in ns); the mark changes with every name added, removed or renamed."""
    at = os.stat(inner)
    return f"{at.st_ino}:{at.st_mtime_ns}:{at.st_ctime_ns}", at.st_ctime_ns


def _names(folder: str, above: list[str], settled: float) -> Iterator[tuple]:
    """Rows of ``_WALK_SCHEMA`` for one folder: its entries one by one, without times and sizes if it is local,
    then its mark. A folder changed less than ``settled`` seconds ago gets none: a change that
    follows within one tick of the clock would not show."""
    from pyarrow import fs as pafs

    prefix = folder[:folder.index("://") + 3] if "://" in folder else ""
    try:
        fs, inner = filesystem(folder)
        here = os.path.realpath(inner) if _is_local(folder) else folder  # only local folders have links
        if here in above:
            raise OSError(f"link loop: {here} is a folder above")
        inside = [*above, here]
        if not _is_local(folder):
            for f in fs.get_file_info(pafs.FileSelector(inner, recursive=False)):
                is_dir = f.type == pafs.FileType.Directory
                if f.type != pafs.FileType.NotFound:
                    modtime = f.mtime_ns // 1_000_000_000 if f.mtime_ns is not None else None
                    yield prefix + f.path, modtime, f.size, is_dir, None, inside if is_dir else None, folder, None
            return
        now = time.time_ns()
        mark, changed = _mark(inner)
        with os.scandir(inner) as entries:
            for e in entries:
                path = prefix + os.path.join(inner, e.name)
                try:
                    path.encode()
                    is_dir = e.is_dir()
                except (UnicodeEncodeError, OSError) as x:
                    shown = os.fsencode(path).decode("utf-8", "backslashreplace")
                    yield shown, None, None, None, f"{type(x).__name__}: unreadable name or link", None, None, None
                    continue
                yield path, None, None, is_dir, None, inside if is_dir else None, folder, None
        if now - changed > settled * 1e9:
            yield folder, None, None, None, None, None, None, mark
    except OSError as e:  # an unreadable folder or a loop is reported and left out
        yield folder, None, None, None, f"{type(e).__name__}: {e}", None, None, None


def _listing(settled: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for b in batches for folder, above in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                         for row in _names(folder, above, settled)), _WALK_NAMES, _WALK_TYPES)

    return run


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times and sizes of local entries; names that vanished, and links that lead nowhere, go."""
    import stat

    def rows() -> Iterator[tuple]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                path, is_dir = row[0], row[3]
                if is_dir is None or not _is_local(path):
                    yield row
                    continue
                try:
                    at = os.stat(filesystem(path)[1])
                except FileNotFoundError:
                    continue
                except OSError as e:
                    yield path, None, None, None, f"{type(e).__name__}: {e}", None, None, None
                    continue
                yield path, at.st_mtime_ns // 1_000_000_000, at.st_size if stat.S_ISREG(at.st_mode) else None, *row[3:]

    return _batches(rows(), _WALK_NAMES, _WALK_TYPES)


def _checking(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Known folders (path, mark) -> ``_CHECKED_SCHEMA``: whether each is as it was; folders that are gone go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            top = filesystem(root)[1]
            for b in batches:
                for path, mark in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    inner = filesystem(path)[1]
                    steps = [p for p in inner[len(top):].split("/") if p]
                    above = [os.path.realpath(os.path.join(top, *steps[:k])) for k in range(len(steps))]
                    here = os.path.realpath(inner)
                    if not os.path.isdir(inner):
                        continue
                    try:
                        same = here not in above and _mark(inner)[0] == mark
                    except OSError:
                        same = False  # listing it will tell why
                    yield path, above, here, mark, same

        return _batches(rows(), _CHECKED_NAMES, _CHECKED_TYPES)

    return run


def _snapshots(spark: SparkSession, place: str) -> list[str]:
    """The finished walks under ``place``, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/*/done")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def walk(spark: SparkSession, root: str, recursive: bool = True, patterns: list[str] | None = None,
         memory: str | None = None, settled: float = 60.0) -> DataFrame:
    """All entries under ``root`` as ``ENTRY_SCHEMA``; excluded folders are not entered. Links are followed;
    one that leads to a folder above it is an error row, and the walk ends there. A name that is not UTF-8
    is an error row.

    ``memory`` (a folder that driver and executors share): folders that did not change since the last
    recursive walk of the same root with the same ``memory`` are not opened again; patterns may differ. Walks of one root run
    one after another; the last two stay in ``memory``, so a result can be read until the second
    walk after it. Folders changed within ``settled`` seconds before they were listed are opened next time too
    (the clocks of file server and executors may differ by less than that)."""
    place = f"{memory.rstrip('/')}/{hashlib.sha256(root.encode()).hexdigest()[:16]}" if memory and recursive else None
    base = f"{place}/{time.time_ns():020d}" if place else f"{checkpoint_dir(spark)}/scanlens-walk-{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = ~excluded("path", root, patterns) if patterns else F.lit(True)
    folders, level, paths = spark.createDataFrame([(root, [])], "path string, above array<string>"), 0, []
    kept = known = None
    earlier = _snapshots(spark, place) if place else []
    if earlier:
        seen = spark.read.schema(_WALK_SCHEMA).parquet(f"{earlier[-1]}/level=*")
        marks = seen.where(F.col("mark").isNotNull() & ((F.col("path") == root) | keep)).select("path", "mark")
        marks.repartition(tasks).mapInArrow(_checking(root), _CHECKED_SCHEMA).write.parquet(f"{base}/checked")
        checked = spark.read.schema(_CHECKED_SCHEMA).parquet(f"{base}/checked")
        known, same = checked.select("path"), checked.where("same")
        inside = same.select(F.col("path").alias("folder"), F.concat("above", F.array("here")).alias("inside"))
        kept = seen.where("mark is null and error is null").select("path", "is_dir", "folder").join(inside, "folder").selectExpr(
            "path", "cast(null as long) modtime", "cast(null as long) length", "is_dir", "cast(null as string) error",
            "if(is_dir, inside, null) above", "folder", "cast(null as string) mark")
        kept = kept.unionByName(same.select("path", "mark"), allowMissingColumns=True).select(*_WALK_NAMES)
        folders = checked.where("not same").select("path", "above").unionByName(folders.join(known, "path", "left_anti"))
    while True:
        found = folders.repartition(tasks).mapInArrow(_listing(settled), _WALK_SCHEMA)
        if kept is not None and level == 0:
            found = found.unionByName(kept)
        paths.append(f"{base}/level={level:06d}")
        # dealt anew: the entries of one folder are looked at by many tasks
        found.repartition(tasks).mapInArrow(_sized, _WALK_SCHEMA).write.parquet(paths[-1])
        folders = spark.read.schema(_WALK_SCHEMA).parquet(paths[-1]).where("is_dir").where(keep).select("path", "above")
        if known is not None:
            folders = folders.join(known, "path", "left_anti")
        if not recursive or folders.isEmpty():
            break
        level += 1
    if place:
        spark.range(1).write.parquet(f"{base}/done")
        for old in earlier[:-1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(old)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    out = spark.read.schema(_WALK_SCHEMA).parquet(*paths).where("mark is null")
    return out.where(F.col("error").isNotNull() | keep).select(*[f.split()[0] for f in ENTRY_SCHEMA.split(", ")])


def list_files(spark: SparkSession, root: str, recursive: bool = True, extensions=IMAGE_EXTENSIONS,
               exclude: list[str] | None = None, builtin_excludes: bool = True, limit: int | None = None,
               memory: str | None = None, settled: float = 60.0) -> DataFrame:
    """``(path, modtime, length)`` for the files under ``root`` that would be indexed.

    * extension allow-list, case-sensitive (``.JPG`` is not ``jpg``);
    * exclude patterns (glob, ``*``/``?`` cross ``/``) pruning whole subtrees, built-ins
      ``*/.cache`` and ``*/.thumb*`` plus ``*/x`` for each user pattern ``x``;
    * ``recursive=False`` keeps files directly in ``root``;
    * ``limit`` keeps the first ``limit`` files in path order (deterministic, unlike a walk);
    * modtime is whole epoch seconds; ``file:`` is stripped from paths;
    * unreadable folders are skipped (``walk`` returns them with their error);
    * with ``memory``, folders unchanged since the last walk are not opened again (``walk``).
    """
    r = root
    if r.startswith("file:"):
        r = "/" + r[5:].lstrip("/")
    r = r.rstrip("/") or "/"
    entries = walk(spark, r, recursive, exclude_patterns(exclude or [], builtin_excludes), memory, settled)
    out = entries.where("error is null and not is_dir").select("path", "modtime", "length")
    if extensions:
        out = out.where(has_allowed_extension("path", extensions))
    if limit is not None:
        out = out.orderBy("path").limit(limit)
    return out


def spread(files: DataFrame, per_task: int = 32) -> DataFrame:
    """Paths dealt over tasks by number, so that slow work per file fans out however few bytes the
    paths take; the count reads the (narrow) list of paths only."""
    n = files.count()
    return files.repartition(max(1, -(-n // per_task)))


def read_file(path: str) -> bytes | None:
    """The bytes of a file; None when it is missing or unreadable."""
    try:
        fs, inner = filesystem(path)
        with fs.open_input_stream(inner) as f:
            return f.read()
    except OSError:
        return None


def read_bytes(files: DataFrame, path_col: str = "path", budget: int = 64 << 20) -> DataFrame:
    """Adds ``content binary`` by opening each listed file in its task, one batch per ``budget`` bytes.

    Works on any table of paths and any file system ``pyarrow.fs`` knows. An unreadable file gets a
    null ``content``; recognition then records it as an error row.
    """
    names = [*files.columns, "content"]
    at = files.columns.index(path_col)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields] + ["content binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for i, p in enumerate(batch.column(at).to_pylist()):
                held.append(read_file(p) if p is not None else None)
                size += len(held[-1] or b"")
                if size >= budget or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, pa.array(held, pa.binary())], names=names)
                    start, held, size = i + 1, [], 0

    return files.mapInArrow(run, ddl)
