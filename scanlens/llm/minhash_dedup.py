"""MinHash near-duplicate detection with odd sketches.

A document is the set of its distinct k-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z folded).
Documents whose sets have a Jaccard similarity of at least ``threshold`` are linked; a group is a
connected component of links.

Plan
1. One pass over the texts computes the set, its 128-bit fingerprint, MinHash samples, a band key
   per band of samples, and the *odd sketch*: every sample (i, value) flips one bit of a bitmap, so
   the XOR of two bitmaps counts samples that differ. High similarities come out precisely.
2. Equal sets collapse into a class (smallest doc_id), pre-aggregated before the shuffle; copies
   are never paired.
3. Class representatives meet in band buckets. Every member is first tried against its bucket's
   smallest member (a star, not all pairs). Verified links form first components.
4. Buckets that still span several components are compared on the bitmaps alone, in numpy blocks;
   large buckets are split into chunk pairs. Pairs of different components whose estimate reaches
   the threshold minus a margin are open; a task returns a spanning forest of them, not the pairs.
   The components of these forests are clusters: every open pair lies inside one.
5. Inside a cluster, members of different components are compared on their full shingle sets. A
   large cluster is dealt over chunks, every pair of chunks a group of its own, so the work spreads
   and no pair is emitted; a task returns a spanning forest of the links it confirmed.
6. All confirmed links go to distributed connected components.

A link is missed only if no band meets: with 32 bands of 5 samples (1 - 0.85**5)**32 = 7e-9 at a
similarity of 0.85, 2e-6 at 0.8. The margin of 0.15 is five standard deviations.

Edge cases. Null, empty or blank text: set of size 0, linked with nothing. Fewer words than k: the
whole sequence is one shingle. Null doc_id: links with nothing, component null, kept true. Repeated
rows of one doc_id count as one document (if their texts differ, they are linked through the shared
id); every row comes back. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    bounded_batches,
    clean_batches,
    fixed_matrix,
    forest_roots,
    mix64,
    shingle_sets,
    text_blocks,
    whole_groups,
    word_hashes,
    written,
)
from .components import components


@dataclass(frozen=True)
class MinHashOptions:
    shingle_words: int = 5
    #: similarity as a percentage, so that the test 100 * inter >= percent * union is exact
    percent: int = 80
    bands: int = 32
    rows: int = 5
    sketch_bits: int = 1024
    #: by how much an odd-sketch estimate may fall short before a pair is given up
    margin: float = 0.15
    #: members of a bucket that one group compares on bitmaps; larger buckets are split
    chunk: int = 512
    #: shingles of a cluster's chunk, which one group compares on full sets
    chunk_shingles: int = 1 << 16

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def _sample_constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    c = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (c[:n] >> np.uint64(32)).astype(np.uint32), (c[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, xors: np.ndarray, muls: np.ndarray, step: int = 2048) -> np.ndarray:
    """MinHash samples (32 bits each) of one non-empty set."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(xors), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), step):
        v = h[None, i:i + step] ^ xors[:, None]
        v *= muls[:, None]
        v ^= v >> np.uint32(15)
        np.minimum(best, v.min(axis=1), out=best)
    return best


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps (rows x bits/8 bytes): sample i of value v flips bit hash(i, v) mod bits."""
    rows, k = samples.shape
    at = mix64(samples.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(32)))
    pos = (at % np.uint64(bits)).astype(np.int64) + np.arange(rows, dtype=np.int64)[:, None] * bits
    parity = np.bincount(pos.ravel(), minlength=rows * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(rows, bits), axis=1)


def sketch_similarity(flips: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Similarity estimated from the number of bits in which two odd sketches differ."""
    share = np.minimum(flips / bits, 0.4999)
    differing = -bits / 2.0 * np.log1p(-2.0 * share)  # size of the symmetric difference
    return 1.0 - differing / (2.0 * samples)


def features(docs: DataFrame, opt: MinHashOptions) -> DataFrame:
    """doc_id, n_shingles, fp (binary), bands (array of longs), sketch (binary) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xors, muls = _sample_constants(opt.samples)
        salt = np.arange(1, opt.bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for batch in clean_batches(batches):
            for i, j, data, offs in text_blocks(batch.column(1)):
                sets = shingle_sets(*word_hashes(data, offs), opt.shingle_words)
                full = [r for r, s in enumerate(sets) if len(s)]
                sig = np.array([signature(sets[r], xors, muls) for r in full], dtype=np.uint32).reshape(len(full), opt.samples)
                sk = odd_sketches(sig, opt.sketch_bits) if full else None
                keys = np.broadcast_to(salt, (len(full), opt.bands)).copy()
                by_band = sig.reshape(len(full), opt.bands, opt.rows)
                for c in range(opt.rows):
                    keys = mix64(keys * np.uint64(0x632BE59BD9B4E019) + by_band[:, :, c])
                bands: list = [None] * (j - i)
                sketch: list = [None] * (j - i)
                for n, r in enumerate(full):
                    bands[r], sketch[r] = keys[n].view(np.int64), sk[n].tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "fp", "bands", "sketch"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, fp binary, bands array<long>, sketch binary")


def confirmed(pairs: DataFrame, docs: DataFrame, opt: MinHashOptions) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. Both texts travel to the pair;
    both joins are plain equi-joins that the engine may split on hot ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where("doc_id is not null")
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in clean_batches(batches):
            for i, j, *left in text_blocks(batch.column(2)):
                sa = shingle_sets(*word_hashes(*left), opt.shingle_words)
                keep = []
                for p, q, *right in text_blocks(batch.column(3).slice(i, j - i)):
                    for r, t in enumerate(shingle_sets(*word_hashes(*right), opt.shingle_words), p):
                        s = sa[r]
                        if not len(s) or not len(t):
                            continue
                        x = np.concatenate([s, t])
                        x.sort(kind="stable")
                        inter = int((x[1:] == x[:-1]).sum())
                        if 100 * inter >= opt.percent * (len(x) - inter):
                            keep.append(i + r)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))],
                    names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def _open_links(members: DataFrame, opt: MinHashOptions) -> DataFrame:
    """(a, b): a spanning forest, per group, of the pairs of different components that set sizes and
    odd sketches do not rule out. ``members`` has (bucket, lo, hi, side, id, component, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(clean_batches(batches), ["bucket", "lo", "hi"]):
            key = np.stack([t.column(c).to_numpy() for c in ("bucket", "lo", "hi")])
            new = np.ones(t.num_rows, dtype=bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            group = np.cumsum(new)
            ids, comp, n, side = (t.column(c).to_numpy() for c in ("id", "component", "n", "side"))
            lo, hi = key[1], key[2]
            sk = fixed_matrix(t.column("sketch"), np.uint64, opt.sketch_bits // 64)
            left, right = [], []
            for d in range(1, t.num_rows):
                at = np.nonzero(group[:-d] == group[d:])[0]
                if not len(at):
                    break
                to = at + d
                ok = (comp[at] != comp[to]) & ((lo[at] == hi[at]) | (side[at] != side[to]))
                ok &= 100 * np.minimum(n[at], n[to]) >= opt.percent * np.maximum(n[at], n[to])
                at, to = at[ok], to[ok]
                if len(at):
                    flips = np.bitwise_count(sk[at] ^ sk[to]).sum(axis=1, dtype=np.int64)
                    ok = sketch_similarity(flips, opt.samples, opt.sketch_bits) >= opt.percent / 100 - opt.margin
                    left.append(at[ok])
                    right.append(to[ok])
            if left:
                yield _forest(ids, np.concatenate(left), np.concatenate(right))

    keys = ["bucket", "lo", "hi"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    root = forest_roots(len(ids), left, right)
    own = np.nonzero(root != np.arange(len(ids)))[0]
    return pa.RecordBatch.from_arrays([pa.array(ids[root[own]], pa.int64()), pa.array(ids[own], pa.int64())], names=["a", "b"])


def _links_in_clusters(clusters: DataFrame, label: DataFrame, docs: DataFrame, sizes: DataFrame, opt: MinHashOptions) -> DataFrame:
    """(a, b): confirmed links between members of one cluster that were in different components, as a
    spanning forest per group. clusters (id, cluster), label (id, component), sizes (id, n)."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = clusters.join(label, "id").join(sizes, "id")
    chunks = F.ceil(F.col("total") / F.lit(opt.chunk_shingles)).cast("int")
    dealt = (rows.join(rows.groupBy("cluster").agg(F.sum("n").alias("total")), "cluster")
             .withColumn("side", F.pmod(F.xxhash64("id"), chunks).cast("int"))
             .select("id", "cluster", "component", "n", "side", chunks.alias("chunks")))
    members = (dealt.join(texts, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
               .select("cluster", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"),
                       "side", "id", "component", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(clean_batches(batches), ["cluster", "lo", "hi"]):
            key = np.stack([t.column(c).to_numpy() for c in ("cluster", "lo", "hi")])
            cuts = np.nonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])[0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                g = t.slice(s, e - s)
                ids, comp, side = (g.column(c).to_numpy() for c in ("id", "component", "side"))
                sets: list[np.ndarray] = []
                for _, _, data, offs in text_blocks(g.column("text")):
                    sets += shingle_sets(*word_hashes(data, offs), opt.shingle_words)
                full = np.array([len(x) for x in sets])
                offs = np.r_[0, np.cumsum(full)]
                _, num = np.unique(np.concatenate(sets), return_inverse=True)  # shingles as small numbers
                mark = np.zeros(len(num) + 1, dtype=np.int64)
                left, right = [], []
                for x in range(len(ids)):
                    other = comp != comp[x]
                    other[:x + 1] = False
                    if key[1, s] != key[2, s]:
                        other &= side != side[x]
                    other &= 100 * np.minimum(full, full[x]) >= opt.percent * np.maximum(full, full[x])
                    other &= full > 0
                    to = np.nonzero(other)[0]
                    if not len(to):
                        continue
                    own = num[offs[x]:offs[x + 1]]
                    mark[own] = 1
                    if 4 * len(to) > len(ids):
                        inter = np.add.reduceat(mark[num], np.minimum(offs[:-1], len(num) - 1))[to]
                    else:
                        inter = np.array([mark[num[offs[y]:offs[y + 1]]].sum() for y in to])
                    mark[own] = 0
                    hit = to[100 * inter >= opt.percent * (full[x] + full[to] - inter)]
                    left.append(np.full(len(hit), x))
                    right.append(hit)
                if left:
                    yield _forest(ids, np.concatenate(left), np.concatenate(right))

    keys = ["cluster", "lo", "hi"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _labelled(ids: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``ids`` with column component: that of ``found`` (id, component), else the id itself."""
    return (ids.join(found.withColumnRenamed("id", key), key, "left")
            .withColumn("component", F.coalesce("component", key)))


def near_duplicates(docs: DataFrame, opt: MinHashOptions = MinHashOptions()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs`` (doc_id, text)."""
    feats = written(features(docs, opt), "minhash-features")
    linkable = feats.where("fp is not null and doc_id is not null")

    # equal sets: one class, named by its smallest doc_id
    classes = linkable.groupBy("fp").agg(F.min("doc_id").alias("cid"))
    rows = linkable.select("doc_id", "fp").distinct().join(classes, "fp").select("doc_id", "cid")
    rows = written(rows, "minhash-classes")
    reps = (linkable.join(rows.where("doc_id = cid").select("doc_id").distinct(), "doc_id", "left_semi")
            .dropDuplicates(["doc_id", "fp"]))
    # a doc_id that stands on several classes links them
    shared = rows.where("doc_id <> cid").select(F.col("doc_id").alias("a"), F.col("cid").alias("b")) \
        .join(rows.groupBy("doc_id").agg(F.count_distinct("cid").alias("k")).where("k > 1")
              .select(F.col("doc_id").alias("a")), "a", "left_semi")

    # stars: every member of a bucket against its smallest member
    spread = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    met = written(spread.join(buckets, "bucket"), "minhash-buckets")
    stars = met.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    small = reps.select("doc_id", "n_shingles", "sketch")
    a = small.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ka"))
    b = small.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("kb"))
    first = written(confirmed(_likely(stars.join(a, "a").join(b, "b"), opt), docs, opt), "minhash-links")
    found = components(first.unionByName(shared), "a", "b")

    # buckets that still hold several components: on bitmaps first, then on full sets
    parts = _labelled(met.select("bucket", "id", "size"), found, "id")
    open_ = parts.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket")
    left = parts.join(open_, "bucket", "left_semi").join(
        small.withColumnsRenamed({"doc_id": "id", "n_shingles": "n"}), "id")
    clusters = written(components(_open_links(_chunked(left, opt), opt), "a", "b")
                       .select("id", F.col("component").alias("cluster")), "minhash-clusters")
    label = _labelled(clusters.select("id"), found, "id")
    sizes = small.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    second = written(_links_in_clusters(clusters, label, docs, sizes, opt), "minhash-links")

    found = written(components(first.unionByName(second).unionByName(shared), "a", "b"), "minhash-components")
    label = (_labelled(rows.withColumnRenamed("cid", "id"), found, "id")
             .groupBy("doc_id").agg(F.min("component").alias("component_id")))
    return (feats.select("doc_id", "n_shingles").join(label, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _likely(pairs: DataFrame, opt: MinHashOptions) -> DataFrame:
    """Star pairs (a, b, na, nb, ka, kb) that set sizes and odd sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in clean_batches(batches):
            a, b, na, nb = (t.column(c).to_numpy() for c in range(4))
            ka, kb = (fixed_matrix(t.column(c), np.uint64, opt.sketch_bits // 64) for c in (4, 5))
            ok = 100 * np.minimum(na, nb) >= opt.percent * np.maximum(na, nb)
            flips = np.bitwise_count(ka ^ kb).sum(axis=1, dtype=np.int64)
            ok &= sketch_similarity(flips, opt.samples, opt.sketch_bits) >= opt.percent / 100 - opt.margin
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long").distinct()


def _chunked(members: DataFrame, opt: MinHashOptions) -> DataFrame:
    """Members of large buckets dealt over chunks, and every pair of chunks made a group of its own:
    (bucket, lo, hi, side). Small buckets are one chunk."""
    chunks = F.ceil(F.col("size") / F.lit(opt.chunk)).cast("int")
    mine = F.pmod(F.xxhash64("id"), chunks).cast("int")
    return (members.withColumn("side", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
            .withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
            .select("bucket", "lo", "hi", "side", "id", "component", "n", "sketch"))
