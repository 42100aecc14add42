"""Token ids as length-delimited binary records with a separate offset index.

File format, little-endian throughout.
- Record file ``*.rec``: per document uint64 length of the payload, uint32 masked crc32c of those 8
  bytes, payload, uint32 masked crc32c of the payload. The payload is int64 doc_id, uint8 flag (1 if
  doc_id is null), uint8 width of an id in bytes (2 or 4), then the ids. Masking is the usual
  rotation by 15 bits plus 0xA282EAD8.
- Index file ``*.idx``: per record uint64 byte offset, uint64 length of the frame, uint64 number of
  ids, so that a reader can seek to any document, in any order.

Writing. Documents are range-partitioned by doc_id and sorted; every task encodes its range in
Arrow batches and writes files of about ``file_bytes``. A file carries a random name, and only the
names that a successful task returns enter the manifest, so a repeated or lost task leaves files
that nobody reads. File numbers follow doc_id order. Reading takes the manifest and the indexes and
seeks record by record, checking both checksums.

Edge cases. Null text is the empty text (only the end id). Null doc_id sorts first. Repeated rows
are written once per row; rows that share a doc_id are ordered by digests of their texts. Extra columns are ignored. An empty table writes no file and reads back as
an empty result. Text of any length is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_batches, held, running_offsets, shared_folder, written


@dataclass(frozen=True)
class RecordOptions:
    tokenizer: str
    end_id: int = 2
    #: bytes after which a record file is closed
    file_bytes: int = 64 << 20
    #: pieces that a process remembers in each of two generations
    remembered: int = 500_000


# ------------------------------------------------------------------ checksums

def _crc32c_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


_T0 = _crc32c_table()


def _linear(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The linear map with images ``rows`` of the 32 unit states, applied to states ``v``."""
    acc = np.zeros(len(v), np.uint32)
    for k in range(32):
        acc ^= np.where(v >> np.uint32(k) & np.uint32(1), rows[k], np.uint32(0))
    return acc


_T16 = (_T0[np.arange(1 << 16) & 0xFF] >> np.uint32(8)) ^ _T0[(_T0[np.arange(1 << 16) & 0xFF] & np.uint32(0xFF)) ^ (np.arange(1 << 16) >> 8).astype(np.uint32)]
_SPAN = 256


def _advance_tables() -> np.ndarray:
    """4 x 256 tables that advance a state over ``_SPAN`` zero bytes, one table per state byte."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    rows = _T0[units & np.uint32(0xFF)] ^ (units >> np.uint32(8))
    for _ in range(_SPAN.bit_length() - 1):
        rows = _linear(rows, rows)
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_linear(rows, values << np.uint32(8 * byte)) for byte in range(4)])


_ADVANCE = _advance_tables()


def crc32c_many(data: list[bytes]) -> np.ndarray:
    """Castagnoli checksums of many byte strings at once.

    Every string is cut into spans of 256 bytes from its end (zeros before the first byte leave a zero
    state unchanged; the initial state is folded into the first four bytes), all spans run as lanes
    of one vector, two bytes a step, and a string's lanes are joined by advancing its state over a
    span. Strings of at most 16 bytes run in spans of 16.
    """
    size = np.array([len(d) for d in data], np.int64)
    out = np.zeros(len(data), np.uint32)
    short = np.nonzero(size < 4)[0]
    for i in short:
        c = 0xFFFFFFFF
        for b in data[i]:
            c = int(_T0[(c ^ b) & 0xFF]) ^ (c >> 8)
        out[i] = c ^ 0xFFFFFFFF
    full = np.nonzero(size >= 4)[0]
    if not len(full):
        return out
    size = size[full]
    width = 16 if size.max() <= 16 else _SPAN
    spans = -(-size // width)
    ends = np.cumsum(spans)
    lanes = np.zeros((int(ends[-1]), width), np.uint8)
    flat = lanes.reshape(-1)
    for i, n, e in zip(full.tolist(), size.tolist(), (ends * width).tolist()):
        flat[e - n:e] = np.frombuffer(data[i], np.uint8)
    first = ends * width - size
    for k in range(4):
        flat[first + k] ^= 0xFF
    state = np.zeros(len(lanes), np.uint32)
    pairs = lanes.view("<u2")
    for k in range(width // 2):
        state = _T16[(state ^ pairs[:, k]) & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))
    order = np.argsort(-spans, kind="stable")  # longest first, so that those still open are a prefix
    head, many = (ends - spans)[order], spans[order]
    c = state[head]
    for k in range(1, int(many[0])):
        m = int(np.searchsorted(-many, -k, side="left"))  # strings of more than k spans
        v = c[:m]
        c[:m] = (_ADVANCE[0][v & np.uint32(0xFF)] ^ _ADVANCE[1][v >> np.uint32(8) & np.uint32(0xFF)]
                 ^ _ADVANCE[2][v >> np.uint32(16) & np.uint32(0xFF)] ^ _ADVANCE[3][v >> np.uint32(24)] ^ state[head[:m] + k])
    out[full[order]] = c ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c_many(heads)).tolist(), masked(crc32c_many(payloads)).tolist()
    return [b"".join((h, struct.pack("<I", x), p, struct.pack("<I", y))) for h, x, p, y in zip(heads, a, payloads, b)]


def unframed(data: list[bytes]) -> list[bytes]:
    """The payloads of frames; raises when a length or checksum is wrong."""
    payloads = [d[12:-4] for d in data]
    a, b = masked(crc32c_many([d[:8] for d in data])), masked(crc32c_many(payloads))
    for d, p, x, y in zip(data, payloads, a.tolist(), b.tolist()):
        if len(d) < 16 or struct.unpack_from("<QI", d) != (len(p), x) or struct.unpack_from("<I", d, len(d) - 4)[0] != y:
            raise ValueError("damaged record")
    return payloads


# ------------------------------------------------------------------ encoding

#: a space whose left neighbour is neither a letter, digit or underscore nor ASCII punctuation
_ODD_SPACE = re.compile(r" (?<![\w!-/:-@\[-`{-~] )")
_SAFE_SPACE = re.compile(r"(?<=[\w!-/:-@\[-`{-~])(?= )")


class PieceEncoder:
    """A byte-level BPE tokenizer applied piece by piece.

    The tokenizer's pattern never joins a non-space with a following space, so a text falls into
    pieces that start with a space and are encoded independently. Frequent pieces are remembered
    (two generations, so that the memory is bounded); new ones are encoded together, many to a
    call, and told apart by the byte lengths of their tokens.
    """

    def __init__(self, path: str, remembered: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        # one character of a byte-level token stands for one byte
        self.bytes = np.array([len(self.tok.id_to_token(i)) for i in range(size)], np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remembered = remembered

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for i in range(0, len(texts), 4096)
                for e in self.tok.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        joined, alone = [], []
        for p in new:  # a piece that ends in white space may not stand before another one
            tail = p[-1:]
            (joined if "!" <= tail <= "~" or tail.isalnum() else alone).append(p)
        for i in range(0, len(joined), 64 * 64):
            some = joined[i:i + 64 * 64]
            found = self.tok.encode_batch_fast([" " + " ".join(some[j:j + 64]) for j in range(0, len(some), 64)], add_special_tokens=False)
            # the groups one after the other: a piece ends where the bytes of the tokens reach its own and its space's
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in found])
            reach = np.cumsum(pc.binary_length(pa.array(some)).to_numpy().astype(np.int64) + 1)
            cuts = ((np.searchsorted(np.cumsum(self.bytes[ids]), reach) + 1) * self.width).tolist()
            raw = ids.tobytes()
            self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        self.known.update(zip(alone, self._alone([" " + p for p in alone])))

    def _find(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces (given without the space they start with)."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, pieces))
        absent = [k for k, v in enumerate(found) if v is None]
        if absent:
            names = new = list(map(pieces.__getitem__, absent))
            if self.older:
                older = list(map(self.older.get, names))
                self.known.update((p, v) for p, v in zip(names, older) if v is not None)
                new = [p for p, v in zip(names, older) if v is None]
            self._learn(new)
            for k, v in zip(absent, map(self.known.__getitem__, names)):
                found[k] = v
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text (no nulls) as little-endian integers of ``width`` bytes.

        Arrow cuts the texts at spaces and numbers the distinct pieces; only those go through the
        memory, and numpy puts the ids of a text together by piece number.
        """
        plain = [_ODD_SPACE.search(t) is None for t in texts.to_pylist()]
        mask = pa.array(plain)
        lists = pc.split_pattern(texts.filter(mask), " ").combine_chunks() if isinstance(texts, pa.ChunkedArray) \
            else pc.split_pattern(texts.filter(mask), " ")
        rows = [lists]
        if not all(plain):  # cut at safe spaces only
            cut = [_SAFE_SPACE.split(t) for t in texts.filter(pc.invert(mask)).to_pylist()]
            rows.append(pa.array([[c[0], *[p[1:] for p in c[1:]]] for c in cut], lists.type))
        lists = pa.concat_arrays(rows)
        offs = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int32)
        heads = offs[:-1]
        found = self._find(coded.dictionary.to_pylist())
        # the first piece of a text has no space before it
        found += self._alone(lists.flatten().take(pa.array(heads)).to_pylist())
        word[heads] = len(coded.dictionary) + np.arange(len(heads))
        size = np.fromiter(map(len, found), np.int32, len(found)) // self.width
        start = np.cumsum(size, dtype=np.int32) - size
        many = size[word]
        end = np.cumsum(many, dtype=np.int32)  # a batch holds far fewer than 2**31 ids
        at = np.repeat(start[word] - (end - many), many)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.frombuffer(b"".join(found), self.dtype)[at]
        cuts = np.r_[0, end][offs]
        out = [ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
        order = np.argsort(np.r_[np.nonzero(plain)[0], np.nonzero(np.logical_not(plain))[0]], kind="stable")
        return [out[k] for k in order]


def encoder(opt: RecordOptions) -> PieceEncoder:
    return held(f"records {opt}", lambda: PieceEncoder(opt.tokenizer, opt.remembered))


# ------------------------------------------------------------------ files

def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder)


def _uri(folder: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", folder)


def write_records(docs: DataFrame, folder: str, opt: RecordOptions) -> DataFrame:
    """Encode and write; returns the manifest (part, seq, file, records, ids), one row per file."""
    spark = docs.sparkSession
    folder = _uri(folder)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one doc_id (or of none) are ordered by their text's digests, so they spread and reruns agree
    order = [F.col("doc_id").asc_nulls_first(), F.col("h1"), F.col("h2")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"),
                           F.xxhash64(F.lit(1), text).alias("h2"))
               .repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
               .withColumn("part", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(opt)
        fs, base = _filesystem(folder)
        end = np.array([opt.end_id], enc.dtype).tobytes()
        out, name, at, index, ids, part, seq = None, "", 0, [], 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(np.array(index, "<u8").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([f"{folder}/{name}"]),
                 pa.array([len(index)], pa.int64()), pa.array([ids], pa.int64())], names=["part", "seq", "file", "records", "ids"])

        for batch in clean_batches(batches, 8 << 20, f"records {opt}"):
            part = batch.column(2)[0].as_py()
            payloads = [struct.pack("<qBB", doc or 0, doc is None, enc.width) + body + end
                        for doc, body in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)))]
            for payload, rec in zip(payloads, frames(payloads)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, at, index, ids = uuid.uuid4().hex, 0, [], 0
                    out = fs.open_output_stream(f"{base}/{name}.rec")
                out.write(rec)
                many = (len(payload) - 10) // enc.width
                index.append((at, len(rec), many))
                at, ids = at + len(rec), ids + many
                if at >= opt.file_bytes:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    return written(ordered.mapInArrow(run, "part int, seq int, file string, records long, ids long"), "record-manifest")


def read_records(spark: SparkSession, manifest: DataFrame, with_ids: bool = True, budget: int = 8 << 20) -> DataFrame:
    """One row per record: doc_id, file, row, offset, start (ids of all records before it, in manifest
    order), n_tokens, ids_crc32 and, if wanted, ids (uint32 bytes). Index entries come first, then
    seeks into the record files, about ``budget`` bytes at a time."""
    order = manifest.withColumn("num", F.struct("part", "seq"))
    before = running_offsets(order, "num", "ids").withColumnRenamed("offset", "base")
    files = order.join(before, "num").select("file", "base")
    # as many tasks as files: their rows are few bytes, by which partitions would be merged
    files = files.repartition(max(1, manifest.count()), F.xxhash64("file"))
    fields = "doc_id long, file string, row long, offset long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = _filesystem(file)
                with fs.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 3).astype(np.int64)
                starts = base + np.cumsum(index[:, 2]) - index[:, 2]
                part = index[:, 0] // budget  # a file has at least one record
                cuts = np.r_[np.nonzero(np.r_[True, part[1:] != part[:-1]])[0], len(index)]
                with fs.open_input_file(f"{path}.rec") as f:
                    for i, j in zip(cuts[:-1], cuts[1:]):
                        raw = []
                        for off, size, _ in index[i:j].tolist():
                            f.seek(off)
                            raw.append(f.read(size))
                        docs, ids = [], []
                        for payload in unframed(raw):
                            doc, null, width = struct.unpack_from("<qBB", payload)
                            docs.append(None if null else doc)
                            ids.append(np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=10).astype("<u4").tobytes())
                        columns = [pa.array(docs, pa.int64()), pa.array([file] * (j - i)), pa.array(np.arange(i, j)),
                                   pa.array(index[i:j, 0]), pa.array(starts[i:j]), pa.array(index[i:j, 2]),
                                   pa.array([zlib.crc32(b) for b in ids], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids,
                                                         names=[f.split()[0] for f in fields.split(", ")])

    return files.mapInArrow(run, fields)


def encoded(docs: DataFrame, opt: RecordOptions, with_ids: bool = True) -> DataFrame:
    """Write ``docs`` as record files in the shared folder and read them back."""
    spark = docs.sparkSession
    manifest = write_records(docs, shared_folder(spark, "records"), opt)
    return read_records(spark, manifest, with_ids)
