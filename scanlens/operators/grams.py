"""Trigram postings: build, corpus statistics, phrase places, and candidate lookup.

Postings are ``(gram, id, tf)``, in a store with ``dl``, the row's length, and ``pos``, the gram's places in
the text. With them phrases, proximity and ranking need neither texts nor rows: the places of a phrase are those of a few grams that
cover it, shifted and intersected. A row's grams are all in one task, which packs them as one list per gram and block of texts and writes
them in that form, without a shuffle. A task's files are dealt by a hash of the gram and sorted by (gram, id), so a lookup prunes
directories by bucket and pages by gram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, running_sums
from ..functions.predicates import MIN_PHRASE
from ..functions.text import fold, fold_text, token_count

#: code points handled at once, bytes of packed lists unpacked at once, grams behind one file of postings
BLOCK_CHARS, LIST_BYTES, FILE_GRAMS = 1 << 20, 1 << 19, 16_000_000
#: most buckets of a table of postings
BUCKETS = 8
PACKED = ["gram", "first", "ids", "tfs", "dls", "pos"]
PACKED_SCHEMA = "gram string, first long, ids binary, tfs binary, dls binary, pos binary"


def _folded(index: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return index.select(F.col(id_col).alias("id"), fold(content_col).alias("f"))


def postings(index: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """``(gram, id, tf)`` for every id of the index; the counts of rows that share an id (or have none) are added.

    Texts are shuffled once, by id, and counted in tasks with numpy, an id's rows one after the other; grams and
    postings are never shuffled.
    """
    folded = _folded(index, id_col, content_col)
    kind = folded.schema["id"].dataType.simpleString()
    return folded.repartition("id").sortWithinPartitions("id").mapInArrow(_counts, f"gram string, id {kind}, tf int")


def doc_stats(index: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """``(id, dl)`` — trigram tokens per row, the length term of BM25."""
    return index.select(F.col(id_col).alias("id"), token_count(content_col).cast("int").alias("dl"))


def gram_document_frequency(post: DataFrame) -> DataFrame:
    """``(gram, df)``; partial aggregation collapses hot grams inside each task before the shuffle."""
    return post.groupBy("gram").agg(F.count("*").alias("df"))


def phrase_grams(text: str) -> list[str]:
    t = fold_text(text)
    return sorted({t[i : i + 3] for i in range(len(t) - 2)}) if len(t) >= MIN_PHRASE else []


def candidates(post: DataFrame, text: str, lead: int = 3) -> DataFrame:
    """Ids that may hold the phrase: those with all of its ``lead`` rarest grams.

    One small query counts the posting lists of the phrase's grams (a pushed ``isin`` on sorted
    files, partial counts per task); the lists of the common grams are then never read. Callers
    verify candidates on the text, so leaving grams out costs no result.
    """
    grams = phrase_grams(text)
    if not grams:
        return post.sparkSession.createDataFrame([], "id long")
    if len(grams) > lead:
        counts = dict(gram_document_frequency(post.where(F.col("gram").isin(*grams))).collect())  # one row per gram of the phrase
        grams = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:lead]
    hit = post.where(F.col("gram").isin(*grams)).select("gram", "id")
    return hit.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(id, folded text) -> ids, sizes and code points of blocks of about ``BLOCK_CHARS``, whatever a batch holds."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_CHARS, side="right")))
            points = np.frombuffer("".join(t or "" for t in texts.slice(i, j - i).to_pylist()).encode("utf-32-le"), np.uint32)
            yield ids.slice(i, j - i), sizes[i:j], points
            i = j


def _lists(row: np.ndarray, rows: int, place: np.ndarray, most: int, points: np.ndarray, at: np.ndarray):
    """The grams that start at ``at``, by gram, row and place: names of the distinct grams, ends of their lists, and per list entry
    its row and the start of its places, which come last. One sort of integers that hold (gram, row, place)."""
    # grams as numbers in the block's own alphabet
    alphabet = np.nonzero(np.bincount(points))[0]
    letter = np.zeros(int(alphabet[-1]) + 1, np.int64)
    letter[alphabet] = np.arange(len(alphabet))
    coded, base = letter[points], len(alphabet)
    packed = (coded[at] * base + coded[at + 1]) * base + coded[at + 2]
    del coded
    place_bits = most.bit_length()
    grams = None
    if (base ** 3 * rows).bit_length() + place_bits > 62:
        grams, packed = np.unique(packed, return_inverse=True)  # at most 2 * 20 + 22 bits: a block has few rows or short ones
    packed = ((packed * rows + row) << place_bits) | place
    packed.sort()
    place = packed & ((1 << place_bits) - 1)
    packed >>= place_bits
    first = np.ones(len(packed), bool)
    first[1:] = packed[1:] != packed[:-1]
    starts = np.nonzero(first)[0]
    which, entry_row = np.divmod(packed[starts], rows)
    heads = np.nonzero(np.r_[True, which[1:] != which[:-1]])[0]
    which = which[heads] if grams is None else grams[which[heads]]
    digits = [alphabet[which // base ** 2], alphabet[which // base % base], alphabet[which % base]]
    names = pa.array([chr(x) + chr(y) + chr(z) for x, y, z in zip(*(d.tolist() for d in digits))], pa.string())
    return names, np.append(heads, len(starts)), entry_row, starts, place


def _varints(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers in seven bits a byte, the last byte of each below 128; one binary value per part between two ``cuts``."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int32)
    for k in range(7, 64, 7):
        more = v >= np.uint64(1 << k)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.nonzero(size > k)[0]
        out[ends[some] - size[some] + k] = (v[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | ((size[some] > k + 1) * 128).astype(np.uint8)
    offsets = np.append(0, ends)[cuts].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binary values of a column as int64, and where each value's begin (one more than values)."""
    parts = column.to_pylist()
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.nonzero(raw < 128)[0]
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    size = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max(initial=0))):
        some = np.nonzero(size > k)[0]
        out[some] |= (raw[starts[some] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64), np.searchsorted(ends, np.cumsum([0, *map(len, parts)]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, folded text) -> (gram, first, ids, tfs, dls, pos): per block of rows one list of each gram."""
    for ids, sizes, points in _blocks(batches):
        if ids.null_count:
            raise ValueError("a row without an id cannot be indexed")
        row = np.repeat(np.arange(len(ids)), sizes)
        at = np.nonzero(row[2:] == row[:-2])[0]  # grams do not cross rows
        if not len(at):
            continue
        place = at - (np.cumsum(sizes) - sizes)[row[at]]
        names, heads, entry_row, starts, place = _lists(row[at], len(ids), place, int(sizes.max()), points, at)
        steps = place.copy()
        steps[1:] -= place[:-1]
        steps[starts] = place[starts]
        offsets = np.append(starts, len(place))
        ident = ids.to_numpy()[entry_row]
        gap = np.diff(ident, prepend=0)
        gap[heads[:-1]] = 0
        columns = [names, pa.array(ident[heads[:-1]]), _varints(gap << 1 ^ gap >> 63, heads), _varints(np.diff(offsets), heads),
                   _varints(sizes[entry_row] - 2, heads), _varints(steps, offsets[heads])]
        del row, at, place, steps, starts, offsets, entry_row, points, ident, gap
        yield from pa.table(columns, names=PACKED).to_batches(max_chunksize=2_000)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed lists, with places or without, -> (gram, id, tf, dl[, pos])."""
    for whole in batches:
        binaries = [c for c in PACKED[2:] if c in whole.schema.names]
        ends = np.cumsum(sum(pc.binary_length(whole.column(c)).to_numpy().astype(np.int64) for c in binaries)) if whole.num_rows else []
        i = 0
        while i < whole.num_rows:
            # lists of one gram can be long: as many as fit LIST_BYTES, at least one
            n = max(1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LIST_BYTES, side="right")) - i)
            batch, i = whole.slice(i, n), i + n
            gap, cuts = _numbers(batch.column("ids"))
            many, gap = np.diff(cuts), gap >> 1 ^ -(gap & 1)  # the gap before the first id is 0
            run = np.cumsum(gap)
            ident = run + np.repeat(batch.column("first").to_numpy() - run[cuts[:-1]], many)
            tf = _numbers(batch.column("tfs"))[0]
            columns = [batch.column("gram").take(pa.array(np.repeat(np.arange(batch.num_rows), many))), pa.array(ident),
                       pa.array(tf.astype(np.int32)), pa.array(_numbers(batch.column("dls"))[0].astype(np.int32))]
            if "pos" in batch.schema.names:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)),
                                                        pa.array(_numbers(batch.column("pos"))[0].astype(np.int32))))
            yield from pa.table(columns, names=["gram", "id", "tf", "dl", "pos"][:len(columns)]).to_batches(max_chunksize=20_000)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, folded text) in order of id -> (gram, id, tf). The last id of a block is kept until another one comes."""
    kept, kept_id = [], None

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(kept)
        if len(kept) > 1:
            t = t.group_by("gram").aggregate([("tf", "sum")]).select(["gram", "tf_sum"]).rename_columns(["gram", "tf"])
        many = pa.array([kept_id] * t.num_rows, kind)
        yield from pa.table([t["gram"], many, t["tf"].cast(pa.int32())], names=["gram", "id", "tf"]).combine_chunks().to_batches(max_chunksize=50_000)

    for ids, sizes, points in _blocks(batches):
        kind = ids.type
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        group = np.cumsum(np.r_[0, code[1:] != code[:-1]])
        last = int(group[-1])
        row = np.repeat(np.arange(len(ids)), sizes)
        at = np.nonzero(row[2:] == row[:-2])[0]
        if len(at):
            names, heads, entry, starts, _ = _lists(group[row[at]], last + 1, np.zeros(len(at), np.int64), 0, points, at)
            tf = np.diff(np.append(starts, len(at)))
            which = np.repeat(np.arange(len(names)), np.diff(heads))
        else:
            names, entry, tf, which = pa.array([], pa.string()), *[np.zeros(0, np.int64)] * 3
        part = lambda pick: pa.table([names.take(pa.array(which[pick])), pa.array(tf[pick], pa.int64())], names=["gram", "tf"])
        if kept and ids[0].as_py() != kept_id:
            yield from flush()
            kept = []
        if kept:  # the same id goes on
            kept.append(part(entry == 0))
            if len(kept) > 64:
                kept = [pa.concat_tables(kept).group_by("gram").aggregate([("tf", "sum")]).select(["gram", "tf_sum"]).rename_columns(["gram", "tf"])]
            if last:
                yield from flush()
                kept = []
            done = (entry > 0) & (entry < last)
        else:
            done = entry < last
        if last or not kept:
            kept, kept_id = [part(entry == last)], ids[-1].as_py()
        firsts = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
        table = pa.table([names.take(pa.array(which[done])), ids.take(pa.array(firsts[entry[done]])), pa.array(tf[done].astype(np.int32))], names=["gram", "id", "tf"])
        yield from table.to_batches(max_chunksize=50_000)
    if kept:
        yield from flush()


def packed_positional(index: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """The postings of ``positional`` as one row per gram and block of texts: ``first`` id, and as packed numbers the gaps between
    the ids, ``tfs`` and ``dls`` of each, and ``pos``, the places of all one after the other. No shuffle."""
    folded = _folded(index.withColumn(id_col, F.col(id_col).cast("long")), id_col, content_col)
    return folded.mapInArrow(_packed, PACKED_SCHEMA)


def unpacked(packed: DataFrame, with_pos: bool = True) -> DataFrame:
    """``(gram, id, tf, dl, pos)`` of packed postings, or ``(gram, id, tf, dl)`` (then no places are read). Filter by gram before."""
    columns = PACKED if with_pos else PACKED[:-1]
    return packed.select(*columns).mapInArrow(_entries, "gram string, id long, tf int, dl int" + ", pos array<int>" * with_pos)


def positional(index: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """``(gram, id, tf, dl, pos)``: postings with the row's length in trigram tokens and the places of the gram
    in the text (0-based code points, each as the distance from the one before, the first from 0). No shuffle."""
    return unpacked(packed_positional(index, id_col, content_col))


def cover(text: str) -> list[tuple[int, str]]:
    """(offset, gram) of a phrase's grams that together hold all of its characters."""
    t = fold_text(text)
    offsets = list(range(0, len(t) - 2, 3))
    if offsets[-1] != len(t) - 3:
        offsets.append(len(t) - 3)
    return [(o, t[o:o + 3]) for o in offsets]


def starts_from_positions(lists: Column, text: str) -> Column:
    """Places of a phrase from ``lists`` (map gram -> delta-coded places in one text): the places of its
    covering grams, shifted by their offsets and intersected. Empty where a gram is missing."""
    def places(offset: int, gram: str) -> Column:
        steps = F.coalesce(F.try_element_at(lists, F.lit(gram)), F.array().cast("array<int>"))
        at = bound(running_sums(steps), lambda s: F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))))
        return at if offset == 0 else F.transform(at, lambda x: x - offset)

    grams = cover(text)
    out = places(*grams[0])
    for g in grams[1:]:
        out = F.array_intersect(out, places(*g))
    return out


def phrase_places(positions: DataFrame, phrases: list[str]) -> DataFrame:
    """``(id, dl, s_0, s_1, ...)``: the row's length and the places of every phrase (of three characters or more)
    in every row that has one, from postings alone. Only the lists of covering grams are read; they meet by id."""
    grams = sorted({g for p in phrases for _, g in cover(p)})
    lists = (positions.where(F.col("gram").isin(grams)).groupBy("id")
             .agg(F.max("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("gram", "pos"))).alias("lists")))
    found = lists.select("id", "dl", *[starts_from_positions(F.col("lists"), p).alias(f"s_{i}") for i, p in enumerate(phrases)])
    some = F.lit(False)
    for i in range(len(phrases)):
        some = some | (F.size(f"s_{i}") > 0)
    return found.where(some)


def bucket_of(gram: Column, buckets: int) -> Column:
    return (F.crc32(gram) % buckets).cast("int")


def bucket_number(gram: str, buckets: int) -> int:
    """The same on the driver."""
    return zlib.crc32(gram.encode()) % buckets


def write_postings(packed: DataFrame, path: str, length: int) -> int:
    """Files by ``bucket``, a hash of the gram, sorted by gram and first id of a list; returns the number of buckets.
    ``length`` is the number of grams in the texts. Lists are several times as large as their texts, so they are not
    shuffled: a task writes the lists of its texts, one file per bucket, and a gram's lists lie in as many files as there
    are tasks. A look-up reads the pages of its grams in the files of their buckets; a hot gram is the work of several tasks."""
    buckets = min(max(1, -(-length // FILE_GRAMS)), BUCKETS)
    dealt = packed.withColumn("bucket", bucket_of(F.col("gram"), buckets))
    dealt.sortWithinPartitions("bucket", "gram", "first").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return buckets


def build_index_tables(index: DataFrame, base: str) -> tuple[str, str]:
    """Write ``postings`` and ``doc_stats`` of an index that is not in a store; returns both paths."""
    post_path, stats_path = f"{base.rstrip('/')}/postings", f"{base.rstrip('/')}/doc_stats"
    length = index.agg(F.coalesce(F.sum(token_count("content").cast("long")), F.lit(0))).first()[0]
    write_postings(packed_positional(index), post_path, length)
    doc_stats(index).write.parquet(stats_path)
    return post_path, stats_path
