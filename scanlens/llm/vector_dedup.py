"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine
verification, distributed connected components.

Two vectors of the same non-null label are linked when their cosine in double precision is at least
``cosine``. Vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length never link.

Plan
1. Equal vectors of a label collapse into a class (smallest vec_id, multiplicity), pre-aggregated
   before the shuffle.
2. Every class gets ``tables`` keys of ``bits`` sign bits. Two vectors at the threshold agree on a
   bit with probability 1 - acos(0.98)/pi = 0.936, on a key of 24 bits with 0.206, and on at least
   one of 64 keys with 1 - 4e-7; closer ones more often. Vectors far apart share a key with 2^-24, so
   chance meetings stay few up to tables of many millions a label.
3. Only classes that share a key with another one go on. Buckets are compared in numpy blocks inside
   the tasks; a bucket above ``chunk`` members is dealt over chunk pairs, so no group is collected
   into one task. A pair is counted in the first table in which its keys agree, so links are counted
   exactly without emitting pairs: a task returns, per member, the number of vectors linked, and a
   spanning forest of its links.
4. Forests are joined by distributed connected components.

Edge cases. Null vec_id: 0 links, component null, kept true. Repeated rows (same vec_id, label and
vector) count as copies of each other; several vectors under one vec_id have their links added up;
every row comes back. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_batches, fixed_matrix, forest_roots, whole_groups, written
from .components import components


@dataclass(frozen=True)
class SignHashOptions:
    cosine: float = 0.98
    tables: int = 64
    #: of one key, at most 32
    bits: int = 24
    #: members of a bucket that one task compares with each other
    chunk: int = 512
    seed: int = 3


def _planes(dims: int, opt: SignHashOptions) -> np.ndarray:
    return np.random.default_rng([opt.seed, dims]).normal(size=(dims, opt.tables * opt.bits))


def _vectors(col: pa.Array, usable: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) per length of the usable vectors of a list column: not empty, not zero, no null or
    non-finite component."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(col).to_numpy(zero_copy_only=False)  # nulls become NaN
    if not len(values):
        return
    row = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(row, ~np.isfinite(values), len(sizes)) > 0
    some = np.bincount(row, values != 0, len(sizes)) > 0
    starts = np.cumsum(sizes) - sizes
    ok = usable & some & ~odd
    for dims in np.unique(sizes[ok]):
        at = np.nonzero(ok & (sizes == dims))[0]
        yield at, values[starts[at][:, None] + np.arange(dims)]


def signed(vectors: DataFrame, opt: SignHashOptions) -> DataFrame:
    """vec_id, label, fp, vec (doubles as bytes), codes (keys as bytes, four each) for rows that can link;
    the other rows have null fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(opt.bits, dtype=np.int64)
        for b in clean_batches(batches):
            fp: list = [None] * b.num_rows
            vec: list = [None] * b.num_rows
            codes: list = [None] * b.num_rows
            for at, raw in _vectors(b.column(2), b.column(1).is_valid().to_numpy(zero_copy_only=False)):
                dims = raw.shape[1]
                x = raw / np.abs(raw).max(axis=1, keepdims=True)  # cosine ignores length; squares stay finite
                if dims not in planes:
                    planes[dims] = _planes(dims, opt)
                bits = (x @ planes[dims] >= 0).reshape(len(at), opt.tables, opt.bits)
                keys = (bits * weights).sum(axis=2).astype(np.uint32)
                for n, i in enumerate(at.tolist()):
                    vec[i], codes[i] = x[n].tobytes(), keys[n].tobytes()
                    fp[i] = hashlib.blake2b(raw[n].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fp, pa.binary()), pa.array(vec, pa.binary()), pa.array(codes, pa.binary())],
                names=["vec_id", "label", "fp", "vec", "codes"])

    if opt.bits > 32:
        raise ValueError("a key has at most 32 bits")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, "vec_id long, label string, fp binary, vec binary, codes binary")


def _padded(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of packed doubles as a matrix, shorter ones filled up with zeros, and their lengths."""
    dims = pc.binary_length(col).to_numpy() // 8
    x = np.zeros((len(dims), dims.max()))
    for d in np.unique(dims):
        at = np.nonzero(dims == d)[0]
        x[at, :d] = fixed_matrix(col.take(pa.array(at)) if len(at) < len(dims) else col, np.float64, int(d))
    return x, dims


def _compare(members: DataFrame, opt: SignHashOptions) -> DataFrame:
    """Per member and task: (id, links, root): vectors linked and one spanning link (id, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(clean_batches(batches), ["bucket", "tab", "lo", "hi"]):
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("bucket", "tab", "lo", "hi")])
            new = np.ones(t.num_rows, dtype=bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            group = np.cumsum(new)
            ids, many, side = (t.column(c).to_numpy() for c in ("id", "many", "side"))
            label = t.column("label").combine_chunks().dictionary_encode()
            label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
            tab, lo, hi = key[1], key[2], key[3]
            x, dims = _padded(t.column("vec"))
            codes = fixed_matrix(t.column("codes"), np.uint32, opt.tables)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            links = np.zeros(len(x), dtype=np.int64)
            ea, eb = [], []
            for d in range(1, len(x)):
                at = np.nonzero(group[:-d] == group[d:])[0]
                if not len(at):
                    break
                to = at + d
                ok = (label[at] == label[to]) & (dims[at] == dims[to]) & ((lo[at] == hi[at]) | (side[at] != side[to]))
                at, to = at[ok], to[ok]
                near = np.einsum("ij,ij->i", x[at], x[to]) >= opt.cosine * norm[at] * norm[to]
                at, to = at[near], to[near]
                if len(at):  # only the first table in which the keys agree counts the link
                    agree = codes[at] == codes[to]
                    fresh = agree.argmax(axis=1) == tab[at]
                    at, to = at[fresh], to[fresh]
                    np.add.at(links, at, many[to])
                    np.add.at(links, to, many[at])
                    ea.append(at)
                    eb.append(to)
            if ea:
                root = forest_roots(len(x), np.concatenate(ea), np.concatenate(eb))
                hit = np.nonzero(links)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], names=["id", "links", "root"])

    keys = ["bucket", "tab", "lo", "hi"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "id long, links long, root long")


def near_vectors(vectors: DataFrame, opt: SignHashOptions = SignHashOptions()) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of ``vectors`` (vec_id, embedding, label)."""
    rows = written(signed(vectors, opt), "signed-vectors")
    able = rows.where("fp is not null and vec_id is not null")
    classes = written(able.groupBy("label", "fp").agg(F.min("vec_id").alias("id"), F.count("*").alias("many")), "vector-classes")
    reps = (able.select(F.col("vec_id").alias("id"), "label", "fp", "vec", "codes").dropDuplicates(["id", "label", "fp"])
            .join(classes, ["id", "label", "fp"]).withColumn("cls", F.xxhash64("label", "fp")))
    # (table, key of the label and the table's code)
    spelled = F.expr(f"transform(sequence(0, {opt.tables - 1}), t -> substring(codes, 4 * t + 1, 4))")
    spread = reps.select("id", "cls", "label", F.posexplode(spelled).alias("tab", "code")) \
        .select("id", "cls", "tab", F.xxhash64("label", "tab", "code").alias("bucket"))
    met = spread.groupBy("bucket", "tab").agg(F.count("*").alias("size")).where("size > 1")
    chunks = F.ceil(F.col("size") / F.lit(opt.chunk)).cast("int")
    dealt = (spread.join(met, ["bucket", "tab"])
             .withColumn("side", F.pmod(F.xxhash64("id"), chunks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
             .select("id", "cls", "tab", "bucket", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi")))
    members = dealt.join(reps.select("id", "cls", "label", "many", "vec", "codes"), ["id", "cls"])
    found = written(_compare(members, opt), "vector-links")
    comp = written(components(found.select("id", "root"), "id", "root"), "vector-components")
    of = (classes.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
          .join(comp, "id", "left")
          .select("label", "fp", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
                  F.coalesce("component", "id").alias("component_id")))
    linked = able.select("vec_id", "label", "fp").join(of, ["label", "fp"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("fp is null or vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
