"""Benchmark decontamination with suffix arrays over shards of the training texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A window is ``window`` consecutive
words of a benchmark item; an item with fewer words, but not none, is one window as a whole. A
document word inside any verbatim occurrence of a window is hit.

Plan, one pass over the documents and no shuffle
1. The benchmark goes to the shared folder as Parquet files; tasks read it in blocks of at most
   ``block_bytes`` of text, so neither the driver nor a task holds more than a block of it (a
   worker keeps blocks between shards while they fit ``held_bytes``).
2. A shard is an Arrow batch of at most ``shard_bytes`` of document text. Its words become integers by
   exact dictionary encoding, with a separator after every document, and its suffix array is built by
   prefix doubling up to the length of the longest item.
3. All suffixes of a block of items are binary-searched in the array at once; a search keeps the
   matched lengths at both ends of its interval, so words already compared are not compared again.
   The longer of the two neighbours gives the suffix's longest verbatim match and its place.
4. Where the longest match covers a window, two more searches bounded by the window's length give the
   interval of all its occurrences. Equal windows have equal intervals and are marked once, so the
   marks never exceed the shard's words, however often a passage is repeated in either table.
5. Hit words become spans per document; items follow from (document, window) pairs.

Edge cases. Null or wordless texts have no words and are never hit; null or wordless items have no
window. A null item_id reads as ''. Rows that share an item_id count as one item, repeated documents
are searched each. Extra columns do not matter; an empty benchmark hits nothing, an empty document
table gives an empty result. Texts of any length are searched whole; one document, and one item, is
the least that a shard or a block holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.listing import filesystem
from .common import clean_batches, held, with_text, written
from .terms import LETTERS_DIGITS, byte_words


@dataclass(frozen=True)
class CleanOptions:
    #: words of a passage that counts
    window: int = 10
    #: bytes of document text in a shard
    shard_bytes: int = 8 << 20
    #: bytes of benchmark text searched at once, and kept by a worker between shards
    block_bytes: int = 4 << 20
    held_bytes: int = 64 << 20


# ------------------------------------------------------------------ suffix array of a shard

#: codes around the words of a shard, which count from 1: end of a document; end of an item, unknown word of an item
_SEPARATOR, _END, _UNKNOWN = 0, -1, -2


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` codes at least (prefix doubling)."""
    rank, width = codes.astype(np.int64), 1
    while True:
        # a suffix that has ended sorts before all that go on
        key = rank * (int(rank.max(initial=0)) + 2)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(len(key), np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        rank[order] = new
        width *= 2
        if width >= depth or width >= len(codes) or (len(new) and new[-1] == len(new) - 1):
            return order


def _matched(items: np.ndarray, at: np.ndarray, codes: np.ndarray, place: np.ndarray, known: np.ndarray, most: np.ndarray | None) -> np.ndarray:
    """Length of the common prefix of item suffixes ``at`` and shard suffixes ``place``, of which ``known``
    words are known to agree, up to ``most``."""
    length = known.copy()
    live = np.arange(len(at))
    if most is not None:
        live = live[length < most]
    while len(live):
        same = items[at[live] + length[live]] == codes[place[live] + length[live]]
        live = live[same]
        length[live] += 1
        if most is not None:
            live = live[length[live] < most[live]]
    return length


def search(items: np.ndarray, at: np.ndarray, codes: np.ndarray, order: np.ndarray, most: np.ndarray | None = None,
           after: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of item suffixes in a suffix array: (place, words matched before it, words
    matched at it). With ``most`` suffixes end there, and ``after`` finds the place behind their equals."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    live = np.nonzero(low < high)[0]
    while len(live):
        mid = (low[live] + high[live]) >> 1
        place = order[mid]
        bound = most[live] if most is not None else None
        n = _matched(items, at[live], codes, place, np.minimum(left[live], right[live]), bound)
        whole = n >= bound if most is not None else np.zeros(len(live), bool)
        # where the bound is reached there is no next word to compare
        step = np.where(whole, 0, n)
        greater = items[at[live] + step] > codes[place + step]
        up = np.where(whole, after, greater)
        low[live[up]], left[live[up]] = mid[up] + 1, n[up]
        high[live[~up]], right[live[~up]] = mid[~up], n[~up]
        live = live[low[live] < high[live]]
    return low, left, right


# ------------------------------------------------------------------ blocks of the benchmark

@dataclass
class Block:
    """Items of a block as one sequence of words, each item followed by an end mark."""

    ids: list[str]
    distinct: pa.Array
    words: np.ndarray  # index into distinct, -1 at an end mark
    starts: np.ndarray  # of items
    sizes: np.ndarray
    windows: np.ndarray  # starts of windows
    lengths: np.ndarray  # of windows
    owner: np.ndarray  # item of every position

    @staticmethod
    def of(ids: list[str], texts: pa.Array, window: int) -> Block:
        words, offs = byte_words(texts, LETTERS_DIGITS)
        coded = words.dictionary_encode()
        sizes = np.diff(offs)
        starts = offs[:-1] + np.arange(len(sizes))
        seq = np.full(len(words) + len(sizes), -1, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        inside = np.ones(len(seq), bool)
        inside[starts + sizes] = False
        seq[inside] = coded.indices.to_numpy()
        length = np.minimum(sizes, window)
        left = (starts + sizes)[owner] - np.arange(len(seq))
        at = np.nonzero(inside & (left >= length[owner]) & (length[owner] > 0))[0]
        return Block(ids, coded.dictionary, seq, starts, sizes, at, length[owner[at]], owner)


class Blocks:
    """The blocks of the benchmark's files, in order; read again for every shard unless they all fit."""

    def __init__(self, files: list[str], opt: CleanOptions):
        self.files, self.opt, self.kept = files, opt, None

    def __iter__(self) -> Iterator[Block]:
        if self.kept is not None:
            yield from self.kept
            return
        kept, size = [], 0
        for path in self.files:
            fs, inner = filesystem(path)
            with fs.open_input_file(inner) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=2000, columns=["item_id", "text"]):
                    step = max(1, int(batch.num_rows * min(1.0, self.opt.block_bytes / max(1, batch.nbytes))))
                    for i in range(0, batch.num_rows, step):
                        part = batch.slice(i, step)
                        block = Block.of(part.column(0).to_pylist(), part.column(1), self.opt.window)
                        size += part.nbytes
                        if size <= self.opt.held_bytes:
                            kept.append(block)
                        yield block
        if size <= self.opt.held_bytes:
            self.kept = kept


# ------------------------------------------------------------------ one shard against all blocks

def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Shard:
    def __init__(self, texts: pa.Array):
        words, offs = byte_words(texts, LETTERS_DIGITS)
        coded = words.dictionary_encode()
        self.rows = len(offs) - 1
        self.sizes = np.diff(offs)
        self.starts = offs[:-1] + np.arange(self.rows)
        self.dictionary = coded.dictionary
        self.codes = np.zeros(len(words) + self.rows, np.int64)
        inside = np.ones(len(self.codes), bool)
        inside[self.starts + self.sizes] = False
        self.codes[inside] = coded.indices.to_numpy().astype(np.int64) + 1
        self.order, self.depth = None, 0
        self.hits = np.zeros(len(self.codes) + 1, np.int64)
        self.items: list[tuple[np.ndarray, list[str]]] = []
        self.longest: dict[int, list[dict]] = {}

    def _row(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def look_up(self, block: Block) -> None:
        known = pc.index_in(block.distinct, value_set=self.dictionary).fill_null(_UNKNOWN - 1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        items = np.append(known, _END)[block.words]
        at = np.nonzero(items > 0)[0]
        if not len(at):
            return
        need = int(block.sizes.max())
        if self.order is None or self.depth < need:
            self.order, self.depth = suffix_order(self.codes, need), need
        place, left, right = search(items, at, self.codes, self.order)
        longest = np.zeros(len(items), np.int64)
        longest[at] = np.maximum(left, right)
        where = np.zeros(len(items), np.int64)
        where[at] = self.order[np.where(right >= left, np.minimum(place, len(self.order) - 1), place - 1)]
        full = longest[block.windows] >= block.lengths
        at, length = block.windows[full], block.lengths[full]
        if not len(at):
            return
        low = search(items, at, self.codes, self.order, length)[0]
        high = search(items, at, self.codes, self.order, length, after=True)[0]
        # equal windows share their interval
        key, first, same = np.unique(low * (np.int64(length.max()) + 1) + length, return_index=True, return_inverse=True)
        low, count, size = low[first], (high - low)[first], length[first]
        starts = self.order[_spread(low, count)]
        self.hits += np.bincount(starts, minlength=len(self.hits)) - np.bincount(starts + np.repeat(size, count), minlength=len(self.hits))
        self._items(block, starts, np.repeat(np.arange(len(key)), count), same, block.owner[at])
        self._longest(block, longest, where)

    def _items(self, block: Block, starts: np.ndarray, window: np.ndarray, of_suffix: np.ndarray, owner: np.ndarray) -> None:
        """Distinct (document, item) pairs from (document, window) and (window, item), in bounded slices."""
        n = np.int64(len(block.ids))
        held_by = np.unique(of_suffix.astype(np.int64) * n + owner)
        windows = int(of_suffix.max()) + 1
        first = np.searchsorted(held_by // n, np.arange(windows))
        count = np.diff(np.append(first, len(held_by)))
        pairs = np.unique(self._row(starts).astype(np.int64) * windows + window)
        row, window = np.divmod(pairs, windows)
        ends = np.cumsum(count[window])
        i = 0
        while i < len(pairs):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (4 << 20), side="right")))
            item = held_by[_spread(first[window[i:j]], count[window[i:j]])] % n
            self.items.append((np.unique(np.repeat(row[i:j], count[window[i:j]]) * n + item), block.ids))
            i = j

    def _longest(self, block: Block, longest: np.ndarray, where: np.ndarray) -> None:
        """The shard's longest match of every item of the block, noted with its document."""
        some = np.nonzero(block.sizes > 0)[0]
        back = np.int64(len(longest)) - np.arange(len(longest))
        best = np.maximum.reduceat(longest * (len(longest) + 1) + back, block.starts)[some]
        size, pos = best // (len(longest) + 1), len(longest) - best % (len(longest) + 1)
        for k, n, p in zip(some.tolist(), size.tolist(), pos.tolist()):
            if n >= min(int(block.sizes[k]), int(block.lengths.max())):
                row = int(self._row(where[p:p + 1])[0])
                self.longest.setdefault(row, []).append({
                    "item_id": block.ids[k], "item_word": p - int(block.starts[k]), "doc_word": int(where[p] - self.starts[row]), "words": n})

    def columns(self) -> list[pa.Array]:
        """n_words, spans, items and longest, one value per document."""
        on = np.cumsum(self.hits[:-1]) > 0
        edge = np.diff(np.concatenate(([False], on, [False])).astype(np.int8))
        # separators are never hit, so a span stays inside its document
        first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        row = self._row(first)
        span = pa.StructArray.from_arrays([pa.array(first - self.starts[row]), pa.array(last - self.starts[row])], names=["first", "last"])
        offsets = pa.array(np.searchsorted(row, np.arange(self.rows + 1)).astype(np.int32))
        found: dict[int, set] = {}
        for pairs, ids in self.items:
            for p in pairs.tolist():
                found.setdefault(p // len(ids), set()).add(ids[p % len(ids)])
        items = [sorted(found[r]) if r in found else [] for r in range(self.rows)]
        longest = [self.longest.get(r, []) for r in range(self.rows)]
        return [pa.array(self.sizes.astype(np.int64)), pa.ListArray.from_arrays(offsets, span), pa.array(items, pa.list_(pa.string())),
                pa.array(longest, pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()),
                                                      ("words", pa.int64())])))]


_OUT = ("n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>, "
        "longest array<struct<item_id: string, item_word: bigint, doc_word: bigint, words: bigint>>")


# ------------------------------------------------------------------ the operator

def passages(docs: DataFrame, benchmark: DataFrame, keep: list[str], opt: CleanOptions | None = None) -> DataFrame:
    """``keep`` columns of every document with ``n_words``, the hit word ranges ``spans`` (first, last
    exclusive), the sorted ``items`` with occurring windows, and ``longest``: matches of items that are
    the longest of the document's shard, with their places (in words)."""
    opt = opt or CleanOptions()
    test = written(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                                    F.col("text").cast("string").alias("text")), "benchmark-items")
    files = sorted(test.inputFiles())
    base, at, ddl = with_text(docs, keep, _OUT)
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "n_words", "spans", "items", "longest"]
        for batch in clean_batches(batches, opt.shard_bytes, owner=f"benchmark-{files}"):
            blocks = held(f"benchmark-{files}", lambda: Blocks(files, opt))
            shard = Shard(batch.column(at))
            for block in blocks:
                shard.look_up(block)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *shard.columns()], names=names)

    return base.mapInArrow(run, ddl)


def longest_matches(docs: DataFrame, benchmark: DataFrame, opt: CleanOptions | None = None) -> DataFrame:
    """(item_id, words, item_word, doc_id, doc_word): the longest verbatim match of every item that has a
    window in some document; ties go to the smallest doc_id, then the first place."""
    found = passages(docs, benchmark, ["doc_id"], opt).select("doc_id", F.explode("longest").alias("m")).select("doc_id", "m.*")
    best = F.min_by(F.struct("words", "item_word", "doc_id", "doc_word"), F.struct(-F.col("words"), "doc_id", "doc_word", "item_word"))
    return found.groupBy("item_id").agg(best.alias("m")).select("item_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, opt: CleanOptions | None = None) -> DataFrame:
    """The documents in which no word is hit, with all their columns whatever they are called."""
    columns = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    own = [f"c{i}" for i in range(len(columns))]
    out = passages(inner.withColumn("text", F.col(f"c{columns.index('text')}")), benchmark, own, opt)
    return out.where(F.size("spans") == 0).select(*own).toDF(*columns)


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS passage
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM wins),
cuts AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS passage
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs) JOIN sizes ON i + m - 1 <= len(w)),
hits AS (SELECT r, i, cuts.m, item FROM cuts JOIN wins ON cuts.m = wins.m AND cuts.passage = wins.passage),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
