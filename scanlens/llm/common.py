"""Helpers shared by the training-data operators: shared-folder tables, numpy word hashing over
Arrow buffers, grouped streaming over sorted partitions, distributed running offsets."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_dir

#: Bytes of text that one numpy block holds at most (one longer document forms a block alone).
BLOCK_BYTES = 1 << 19


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/scanlens-{name}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Let the driver collect handles of finished steps. Spark deletes shuffle files and checkpoints
    when their handles are collected; without this, those of all steps of an iterative operator
    pile up on the executors' disks until the driver happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage is cut, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- numpy hashing

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift and odd multiplication)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept per process and grown on demand."""
    have = _TABLES.get("pow")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("pow", _BASE), ("inv", _INV)):
            t = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:  # doubling: t[done:2*done] = t[:done] * base**done
                step = min(done, size - done)
                t[done:done + step] = t[:step] * _U(pow(base, done, 1 << 64))
                done += step
            _TABLES[key] = t
    return _TABLES["pow"][:n], _TABLES["inv"][:n]


class PrefixHash:
    """Rolling polynomial hashes over one byte buffer: the hash of any span costs two lookups."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.pow, self.inv = _powers(n)
        c = np.zeros(n, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * self.pow[:n - 1], out=c[1:])
        self.c = c

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.c[end] - self.c[start]) * self.inv[start]
        return mix64(raw + (end - start).astype(np.uint64) * _ODD)

    def grams(self, n: int) -> np.ndarray:
        """Hash of every n-byte span, by start."""
        if len(self.c) <= n:
            return np.zeros(0, dtype=np.uint64)
        return (self.c[n:] - self.c[:-n]) * self.inv[:len(self.c) - n]


def text_blocks(arr: pa.Array, budget: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into blocks of about ``budget`` bytes.

    Yields (first row, end row, bytes, row offsets into those bytes). Nulls count as empty.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return
    _, offs_buf, data_buf = arr.buffers()
    offs = np.frombuffer(offs_buf, dtype=np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + budget, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a block, A-Z folded on demand.

    Returns (hash per word, word offsets per row: row r owns words[o[r]:o[r+1]]).
    """
    rows = len(offs) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]  # a row starts a new word
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    last[before] = inside[before]
    s, e = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    h = PrefixHash(_LOWER[data] if lower else data).spans(s, e)
    return h, np.searchsorted(s, offs).astype(np.int64)


def shingle_sets(words: np.ndarray, woffs: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; a shorter row is one shingle,
    a row without words has none."""
    n = len(words)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, n)):
        acc[:n - j] += mix64(words[j:] + _U((j + 1) * 0x632BE59BD9B4E019 % (1 << 64))) * _U((2 * j + 3) * 0xA0761D6478BD642F % (1 << 64) | 1)
    acc = mix64(acc)
    out = []
    for r in range(len(woffs) - 1):
        a, b = woffs[r], woffs[r + 1]
        if b - a >= k:
            x = np.sort(acc[a:b - k + 1])
            keep = np.ones(len(x), dtype=bool)
            keep[1:] = x[1:] != x[:-1]
            out.append(x[keep])
        elif b > a:
            w = words[a:b]
            m = np.arange(1, b - a + 1, dtype=np.uint64) * _ODD
            out.append(mix64(np.array([np.sum(mix64(w + m)) + _U(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


#: what a Python worker remembers between tasks, by operator; one operator's at a time
_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """Something costly that tasks of one operator share in a worker process (a vocabulary, a memory
    of words). A worker that turns to another operator gives it up, see ``clean_batches``."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def _give_back() -> None:
    """Return freed memory to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def clean_batches(batches: Iterator[pa.RecordBatch], budget: int = 32 << 20, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Arrow batches sliced so that none holds much more than ``budget`` bytes. Starting a task drops
    what other operators than ``owner`` hold in this process; ending it gives back freed memory."""
    for key in [k for k in _HELD if k != owner]:
        del _HELD[key]
    for b in batches:
        if b.num_rows == 0:
            continue
        step = max(1, int(b.num_rows * min(1.0, budget / max(1, b.nbytes))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    _give_back()


#: rows of whole texts that travel to Python at once
TEXT_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``TEXT_ROWS`` rows, where they are larger: ten thousand
    whole texts at once can outgrow an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Re-cut a sorted stream of batches so that every table holds complete groups of ``keys``.

    Only the last, perhaps unfinished group is carried over, so memory is bounded by one batch and
    the largest group.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        tail = tuple(c[-1] for c in cols)
        same = np.ones(b.num_rows, dtype=bool)
        for c, t in zip(cols, tail):
            same &= c == t
        cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and (last is None or last == tail):
            held.append(b)
        else:
            head = pa.Table.from_batches(held + ([b.slice(0, cut)] if cut else []))
            if head.num_rows:
                yield head
            held = [b.slice(cut)]
        last = tail
    if held:
        yield pa.Table.from_batches(held)


def fixed_matrix(col: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    """A binary or list column of equally long values as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        return col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)
    data = b"".join(col.to_pylist())
    return np.frombuffer(data, dtype=dtype).reshape(-1, width)


def forest_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable for each of n nodes (minimum propagation with pointer jumping)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
        if (before == root).all():
            break
    return root


# ---------------------------------------------------------------- distributed numbering

def running_offsets(sizes: DataFrame, part: str, total: str) -> DataFrame:
    """(part, offset): the sum of ``total`` over smaller parts. One row per partition, so the
    window is bounded by the number of partitions."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(part, F.coalesce(F.sum(total).over(w), F.lit(0)).cast("long").alias("offset"))


def numbered(df: DataFrame, order: list[Column], size: Column, out: str, name: str) -> DataFrame:
    """``df`` with column ``out``: the sum of ``size`` over all rows before it in ``order``.

    A range-partitioned sort written to the shared folder, running sums inside each partition and
    an offset per partition; no window sees more than one partition. Every row comes back.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.withColumn("_size", size.cast("long"))
               .repartitionByRange(n, *order)
               .withColumn("_part", F.spark_partition_id()))
    table = written(ordered, name)
    offsets = running_offsets(table.groupBy("_part").agg(F.sum("_size").alias("_t")), "_part", "_t")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = table.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    return (local.join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("offset") + F.col("_before"))
            .drop("_part", "_size", "_before", "offset"))


def with_text(docs: DataFrame, keep: list[str], out: str) -> tuple[DataFrame, int, str]:
    """For Arrow functions over texts: the columns ``keep`` and the text (not twice if it is among
    them), the position of the text, and the DDL of ``keep`` followed by ``out``."""
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    if "text" in keep:
        base, at = docs.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in keep]), keep.index("text")
    else:
        base, at = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("text")), len(keep)
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:len(keep)]]
    return base, at, ", ".join([*ddl, out])
