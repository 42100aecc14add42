"""The index run (reference lifecycle 3.1) and the search run (3.2) composed from the operators.

Index run: list → allow-list / exclude / limit → change detection against the current index → size
filter from header bytes → paths spread over tasks by number → each file opened and recognised in
its task → one incremental commit of the changed rows and, with cleanup, the deleted paths.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import within_size
from ..operators import recognise as R
from ..operators import search as S
from ..operators import store as ST
from ..session import checkpoint_dir
from ..sources import headers as H
from ..sources import listing as LS


@dataclass
class IndexOptions:
    lang: str = "eng"
    limit: int | None = None
    exclude: list[str] = field(default_factory=list)
    rescan: bool = False
    subdirs: bool = True
    cleanup: bool = False
    max_size: str | None = None  # "WxH"
    engine_options: dict = field(default_factory=dict)
    #: table of option names the engine knows, column ``name``; without it names are not checked
    known_options: DataFrame | None = None
    #: files one recognition task handles, about
    files_per_task: int = 32
    #: time limit of one file; with it engines run in processes of their own, None runs them in the task's
    seconds_per_file: float | None = 600.0
    #: folder in which walks keep what they saw, so that unchanged folders are not opened again (``listing.walk``)
    walk_memory: str | None = None


@dataclass
class RunReport:
    version: int
    counts: dict
    failures: DataFrame


def index_folder(spark: SparkSession, root: str, store: ST.IndexStore, make_engine, opts: IndexOptions | None = None) -> RunReport:
    o = opts or IndexOptions()
    if o.cleanup and not o.subdirs:
        raise ValueError("cleanup cannot be combined with a single-level scan")
    if o.cleanup and o.limit is not None:
        raise ValueError("cleanup with a scan limit would delete everything past the limit")
    lang = check_language(o.lang)
    if o.known_options is not None and o.engine_options:
        R.check_options(spark, o.engine_options, o.known_options)
    current = store.current()
    listed = LS.list_files(spark, root, recursive=o.subdirs, exclude=o.exclude, limit=o.limit, memory=o.walk_memory)
    todo = ST.changed_files(listed, current, rescan=o.rescan).select("path", "modtime")
    todo = LS.spread(todo, o.files_per_task)
    if o.max_size:
        todo = H.file_dimensions(todo).where(within_size("width", "height", o.max_size)).select("path", "modtime")
    res = R.recognise_files(todo, make_engine, {"lang": lang, **o.engine_options}, o.seconds_per_file)
    # recognition is the expensive step: materialise it once in the shared checkpoint folder, so the
    # commit, the counts and the failure report read the same rows and a lost executor re-runs nothing
    checkpoint_dir(spark)
    res = res.checkpoint(eager=True)
    gone = ST.deleted_paths(current, listed, root.rstrip("/") or "/") if o.cleanup else None
    done = store.commit_delta(R.succeeded(res), gone)
    counts = res.agg(F.count_if(F.col("error").isNull()).alias("rows_written"),
                     F.count_if(F.col("error").isNotNull()).alias("failed")).first().asDict()
    counts["deleted"] = gone.count() if gone is not None else 0
    return RunReport(done.version, counts, R.failed(res))


def check_language(code: str) -> str:
    """The language code in lower case; refused when it is not three ASCII bytes without separators."""
    if len(code.encode()) != 3 or not code.isascii() or set(code) & set("./\\"):
        raise ValueError(f"not a language code: {code!r}")
    return code.lower()


def search_index(store: ST.IndexStore, query, kind: str = "simple", **kwargs) -> DataFrame:
    """Search the current index through its postings and stored sizes (``--no-index``: just read it)."""
    return S.search_stored(store, query, kind=kind, **kwargs)
