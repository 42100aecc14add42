"""Recognition job (U1), engine options (U4), one-file recognition.

Recognition itself belongs to a caller-supplied engine: ``make_engine(options)`` is called once
per partition (engines are expensive to build) and returns ``engine(image_bytes) -> text``.
Failures are kept per row in an ``error`` column, so one damaged file never fails the job; the
index only takes rows without an error. Engines are native code that may hang or abort: with ``seconds``
an engine runs in a child process of the task, a file that takes longer or takes the process down
becomes an error row, and the next file gets a new process.
"""

from __future__ import annotations

import contextlib
import multiprocessing
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import strip_scheme
from ..functions.text import DEFAULT_BLACKLIST, collapse_blank_lines, strip_chars
from ..sources.listing import read_file

RESULT_SCHEMA = "path string, modtime long, content string, error string"
# Fixed value: page segmentation mode used when the caller gives none.
DEFAULT_PSM = 11


class EngineProcess:
    """An engine in a child process: calls have a time limit and survive the engine's death.

    The child is forked, so the factory needs no pickling; it is built anew after a kill or a crash.
    """

    def __init__(self, make_engine: Callable[[dict], Callable[[bytes], str]], options: dict, seconds: float, start_seconds: float = 300.0):
        self.make_engine, self.options, self.seconds, self.start_seconds = make_engine, options, seconds, start_seconds
        self.child, self.pipe = None, None

    def _serve(self, pipe) -> None:
        try:
            engine = self.make_engine(self.options)
        except Exception as e:
            pipe.send(f"{type(e).__name__}: {e}")
            return
        pipe.send(None)
        while (data := pipe.recv_bytes()) is not None:
            pipe.send(_one(engine, data))

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.child = context.Process(target=self._serve, args=(theirs,), daemon=True)
        self.child.start()
        theirs.close()
        failed = self.pipe.recv() if self.pipe.poll(self.start_seconds) else "the engine did not start in time"
        if failed:
            self.close()
            raise RuntimeError(failed)  # an engine that cannot be built fails the task, as without a process

    def __call__(self, data: bytes | None) -> tuple[str | None, str | None]:
        """(text, error) of one file."""
        if data is None:
            return _one(None, None)
        if self.child is None:
            self._start()
        try:
            self.pipe.send_bytes(data)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            error = f"TimeoutError: no result in {self.seconds:g} seconds"
        except (EOFError, OSError):
            self.child.join(5)
            error = f"EngineDied: exit code {self.child.exitcode}"
        self.close()
        return None, error

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


@contextlib.contextmanager
def _running(make_engine: Callable[[dict], Callable[[bytes], str]], opts: dict, seconds: float | None):
    """A function from a file's bytes to (text, error) for the life of a task."""
    if seconds is None:
        engine = make_engine(opts)
        yield lambda data: _one(engine, data)
        return
    engine = EngineProcess(make_engine, opts, seconds)
    try:
        yield engine
    finally:
        engine.close()


def recognise(images: DataFrame, make_engine: Callable[[dict], Callable[[bytes], str]],
              options: dict | None = None, content_col: str = "content", seconds: float | None = None) -> DataFrame:
    """``images (path, modtime, content binary)`` -> ``(path, modtime, content, error)`` for images
    that are in a table already. The characters of ``DEFAULT_BLACKLIST`` (or the option
    ``tessedit_char_blacklist``) are deleted, and blank lines are collapsed once."""
    opts = engine_options(options)

    def run(batches):
        with _running(make_engine, opts, seconds) as engine:
            for pdf in batches:
                out = [engine(None if b is None else bytes(b)) for b in pdf["bytes"]]
                yield pd.DataFrame({"path": pdf["path"], "modtime": pdf["modtime"], "content": [t for t, _ in out], "error": [e for _, e in out]})

    out = images.select("path", "modtime", F.col(content_col).alias("bytes")).mapInPandas(run, RESULT_SCHEMA)
    return _cleaned(out, opts)


def recognise_files(files: DataFrame, make_engine: Callable[[dict], Callable[[bytes], str]], options: dict | None = None,
                    seconds: float | None = None) -> DataFrame:
    """``files (path, modtime)`` -> ``(path, modtime, content, error)``: each file is opened, recognised
    and forgotten in one task, so image bytes are neither shuffled nor held beyond one file.
    Spread the paths first (``listing.spread``)."""
    opts = engine_options(options)

    def run(batches):
        with _running(make_engine, opts, seconds) as engine:
            for part in (pdf.iloc[i:i + 16] for pdf in batches for i in range(0, len(pdf), 16)):
                out = [engine(read_file(p)) for p in part["path"]]
                yield pd.DataFrame({"path": part["path"], "modtime": part["modtime"], "content": [t for t, _ in out], "error": [e for _, e in out]})

    return _cleaned(files.select("path", "modtime").mapInPandas(run, RESULT_SCHEMA), opts)


def engine_options(options: dict | None) -> dict:
    return {"psm": str(DEFAULT_PSM), "tessedit_char_blacklist": DEFAULT_BLACKLIST, **{k: str(v) for k, v in (options or {}).items()}}


def _one(engine: Callable[[bytes], str], data: bytes | None) -> tuple[str | None, str | None]:
    if data is None:
        return None, "OSError: the file cannot be read"
    try:
        return engine(data), None
    except Exception as e:  # one bad file: keep going
        return None, f"{type(e).__name__}: {e}"


def _cleaned(results: DataFrame, opts: dict) -> DataFrame:
    return results.withColumn("content", collapse_blank_lines(strip_chars("content", opts["tessedit_char_blacklist"])))


def succeeded(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNull()).select("path", "modtime", "content")


def failed(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNotNull()).select("path", "modtime", "error")


class UnknownOption(ValueError):
    pass


def check_options(spark, options: dict, known_names: DataFrame, name_col: str = "name") -> DataFrame:
    """Validate engine options against a caller-given table of known names (left anti join).

    Raises ``UnknownOption`` listing the unknown names; returns the options as a one-row
    ``map<string,string>`` to store next to the results.
    """
    given = spark.createDataFrame([(k, str(v)) for k, v in options.items()], "name string, value string")
    unknown = given.join(known_names.select(F.col(name_col).alias("name")), "name", "left_anti")
    bad = sorted(r.name for r in unknown.collect())  # options come from the driver: a few names
    if bad:
        raise UnknownOption(f"unknown engine option(s): {', '.join(bad)}")
    return given.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("options"))


def recognise_one(spark, path: str, make_engine, options: dict | None = None) -> DataFrame:
    """Recognise one file and return its row; nothing is stored."""
    img = spark.read.format("binaryFile").load(path).select(
        strip_scheme("path").alias("path"), F.floor(F.unix_micros("modificationTime") / 1_000_000).alias("modtime"), "content")
    return recognise(img, make_engine, options)
