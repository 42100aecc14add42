"""Supervised subword embeddings: a document is the average of learned vectors of its hashed words
and byte n-grams, classified by a linear softmax (Joulin et al., "Bag of Tricks for Efficient Text
Classification", 2016). Trained by plain stochastic gradient descent in numpy on a bounded sample;
applied to every whole text in Arrow batches.

The sample is the only thing that reaches the driver: at most ``sample`` documents, chosen by hash
and dealt evenly over the labels, each as sparse bucket counts (at most ``buckets`` entries however
long the text). Scoring folds the embedding and output matrices into one table of label scores
per bucket, so a text costs one lookup per n-gram and label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _LOWER, PrefixHash, bounded_batches, clean_batches, mix64, text_blocks, with_text, word_hashes


@dataclass(frozen=True)
class SubwordOptions:
    #: hash buckets of the embedding table (at most 65,536)
    buckets: int = 1 << 15
    dims: int = 16
    #: byte n-gram lengths
    grams: tuple[int, ...] = (2, 3, 4)
    #: fold A-Z before hashing
    fold: bool = True
    #: give every word one more feature: whether it repeats the word before it
    repeats: bool = False
    #: bound on the documents that training sees, dealt evenly over the labels
    sample: int = 2000
    #: share of the sample kept back to calibrate scores
    kept_back: float = 0.2
    #: share of right predictions that calibration lets fall below the threshold of rejection
    lost: float = 1 / 500
    epochs: int = 6
    rate: float = 4.0
    seed: int = 7


@dataclass
class SubwordModel:
    labels: list
    #: label scores per bucket (labels x (buckets + 1)); the last bucket is empty
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    #: calibrated probability below which a prediction is to be rejected
    threshold: float
    options: SubwordOptions


def bucket_streams(data: np.ndarray, offs: np.ndarray, opt: SubwordOptions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket per feature, row offsets) for words and every n-gram length of a block. N-grams that
    would cross into the next row get the empty bucket ``opt.buckets``."""
    if len(data) == 0:
        return
    mask = np.uint64(opt.buckets - 1)
    h, woffs = word_hashes(data, offs, lower=opt.fold)
    yield (mix64(h + np.uint64(1)) & mask).astype(np.int32), woffs
    if opt.repeats and len(h):
        same = np.zeros(len(h), dtype=np.uint64)
        same[1:] = h[1:] == h[:-1]
        starts = woffs[:-1][woffs[:-1] < len(h)]
        same[starts] = 0
        yield (mix64(same + np.uint64(0x5EED)) & mask).astype(np.int32), woffs
    ph = PrefixHash(_LOWER[data] if opt.fold else data)
    for n in opt.grams:
        g = ph.grams(n)
        if not len(g):
            continue
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
        idx = (g >> np.uint64(33) & mask).astype(np.int32)
        for k in range(1, n):  # the last n-1 starts of every row
            at = offs[1:] - k
            at = at[(at >= 0) & (at < len(idx))]
            idx[at] = opt.buckets
        yield idx, np.minimum(offs, len(idx))


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offs) - 1, dtype=np.float64)
    full = np.nonzero(offs[1:] > offs[:-1])[0]
    if len(full):
        out[full] = np.add.reduceat(values, offs[full], dtype=np.float64)
    return out


#: a bucket's share of a document's features is kept as a half-precision float times this
_SHARE = 4096.0


def _sparse(docs: DataFrame, opt: SubwordOptions) -> DataFrame:
    """label, h, th (text hash), idx (uint16 bytes), x (float16 bytes: shares of the buckets) for rows
    (label, h, th, text): the row of the smallest text hash of every h, and per task perhaps others
    that came before its smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}  # at most one entry per drawn id
        for batch in clean_batches(batches):
            new = []
            for k, (h, th) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if h not in least or th < least[h]:
                    least[h] = th
                    new.append(k)
            if not new:
                continue
            batch = batch.take(pa.array(new, pa.int64()))
            for i, j, data, offs in text_blocks(batch.column(3)):
                parts = list(bucket_streams(data, offs, opt))
                idx, x = [], []
                for r in range(j - i):
                    own = np.concatenate([np.zeros(0, np.int32)] + [s[o[r]:o[r + 1]] for s, o in parts])
                    u, c = np.unique(own[own < opt.buckets], return_counts=True)
                    idx.append(u.astype(np.uint16).tobytes())
                    x.append((c * (_SHARE / max(1, c.sum()))).astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in range(3)], pa.array(idx, pa.binary()), pa.array(x, pa.binary())],
                    names=["label", "h", "th", "idx", "x"])

    bounded_batches(docs.sparkSession)
    rows = docs.select("label", "h", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "label string, h long, th long, idx binary, x binary")


def labelled_sample(docs: DataFrame, labels: DataFrame, opt: SubwordOptions) -> pa.Table:
    """At most ``opt.sample`` labelled documents as sparse counts, in hash order, on the driver.

    ``labels`` has (doc_id, label). The ids are drawn first, from id and label alone: a first cut by
    hash keeps about twice the sample of every label (all of a small one), so ranking inside a
    label handles a bounded number of rows however many carry it. Only the drawn ids (a bounded
    table) are broadcast to the texts. Of several texts under one doc_id the one with the smallest hash
    counts; the choice is made by an aggregation, so one row per drawn id reaches the driver.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(opt.seed)).alias("h")
    named = (labels.where("doc_id is not null and label is not null")
             .select("doc_id", F.col("label").cast("string").alias("label"), h))
    many = named.groupBy("label").agg(F.count("*").alias("n"))
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = named.join(many, "label").where(place * F.col("n") < F.lit(2.0 * opt.sample + 200)).drop("n")
    ranked = (near.groupBy("doc_id", "h").agg(F.min("label").alias("label"))
              .withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id")))
              .where(F.col("rn") <= opt.sample))
    drawn = ranked.orderBy("rn", "h", "doc_id").limit(opt.sample).select("doc_id", "label", "h")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    one = _sparse(texts, opt).groupBy("label", "h").agg(F.min(F.struct("th", "idx", "x")).alias("s"))
    rows = one.select("label", "h", "s.idx", "s.x").toArrow()
    order = pc.sort_indices(rows, [("h", "ascending"), ("label", "ascending"), ("idx", "ascending")])
    return rows.take(order[:opt.sample]).combine_chunks()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True, initial=-np.inf))
    return e / e.sum(axis=-1, keepdims=True)


def rejection_threshold(z: np.ndarray, right: np.ndarray, opt: SubwordOptions) -> float:
    """The winning probability below which a share of ``opt.lost`` of right predictions falls, from
    kept-back logits ``z`` (rows x labels, after temperature scaling).

    A sample of fewer than 1 / ``opt.lost`` rows has no such quantile: the lower tail of the log-odds
    is extended exponentially below the lowest twentieth (in log-odds, since probabilities crowd at
    1). The tail's scale is its mean excess there, widened by one standard error of that mean, so
    the fewer rows were kept back, the lower the threshold; a single one says nothing about spread.
    One label always has probability 1, so nothing can be rejected.
    """
    c = z.shape[1]
    if c < 2 or right.sum() < 2:
        return 0.0
    top = np.sort(z[right], axis=1)
    rest = top[:, :-1]
    odds = np.sort(top[:, -1] - rest[:, -1] - np.log(np.exp(rest - rest[:, -1:]).sum(axis=1)))
    n = len(odds)
    k = max(1, n // 20)
    scale = (odds[k] - odds[:k]).mean() * (1.0 + 1.0 / np.sqrt(k))
    at = odds[k] - scale * max(0.0, np.log(k / n / opt.lost))
    return float(1.0 / (1.0 + np.exp(-at)))


def fit(rows: pa.Table, opt: SubwordOptions) -> SubwordModel:
    """Train on rows (label, idx, x). Without rows the model has no labels; with one label it
    predicts that label."""
    names = rows.column("label").to_pylist()
    labels = sorted(set(names))
    c = len(labels)
    table = np.zeros((c, opt.buckets + 1), dtype=np.float32)
    if c == 0:
        return SubwordModel([], table, np.zeros(0), 1.0, 0.0, opt)
    ys = np.array([labels.index(x) for x in names])

    def features(k: int) -> tuple[np.ndarray, np.ndarray]:  # views into the Arrow buffers
        idx = np.frombuffer(rows.column("idx")[k].as_buffer(), np.uint16).astype(np.int64)
        return idx, np.frombuffer(rows.column("x")[k].as_buffer(), np.float16).astype(np.float32) / np.float32(_SHARE)

    rng = np.random.default_rng(opt.seed)
    order = rng.permutation(len(names))
    back = order[:int(len(names) * opt.kept_back)]
    train = order[len(back):]
    e = rng.uniform(-1.0 / opt.dims, 1.0 / opt.dims, (opt.buckets, opt.dims)).astype(np.float32)
    w = rng.normal(0, 0.5, (c, opt.dims)).astype(np.float32)
    b = np.zeros(c, dtype=np.float32)
    steps, done = max(1, opt.epochs * len(train)), 0
    for _ in range(opt.epochs):
        for k in rng.permutation(train):
            idx, x = features(k)
            rate = opt.rate * (1.0 - done / steps)
            done += 1
            hid = x @ e[idx] if len(idx) else np.zeros(opt.dims, np.float32)
            g = _softmax(w @ hid + b).astype(np.float32)
            g[ys[k]] -= 1.0
            back_h = w.T @ g
            w -= 0.05 * rate * np.outer(g, hid)
            b -= 0.01 * rate * g
            if len(idx):  # buckets of one document are distinct, so this is a plain scatter
                # the mean divides the gradient by the text's length; scaled back by its spread
                e[idx] -= (rate / max(float(x @ x), 1e-4) * 0.05) * x[:, None] * back_h[None, :]
    table[:, :opt.buckets] = w @ e.T
    model = SubwordModel(labels, table, b.astype(np.float64), 1.0, 0.0, opt)
    if len(back):
        z = np.stack([table[:, idx] @ x + b for idx, x in map(features, back)]).astype(np.float64)
        grid = np.geomspace(0.25, 16.0, 49)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(back)), ys[back]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        model.threshold = rejection_threshold(z / model.temperature, p.argmax(axis=1) == ys[back], opt)
    return model


def scored(docs: DataFrame, model: SubwordModel, keep: list[str],
           finish: Callable[[np.ndarray], list[pa.Array]], out: str) -> DataFrame:
    """The columns ``keep`` of every row and what ``finish`` makes of its label probabilities
    (rows x labels); ``out`` is the DDL of the added columns."""
    opt = model.options
    base, at, ddl = with_text(docs, keep, out)
    names = [*keep, *[f.split()[0] for f in out.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in clean_batches(batches):
            for i, j, data, offs in text_blocks(batch.column(at)):
                z = np.zeros((j - i, len(model.labels)))
                total = np.zeros(j - i)
                for idx, o in bucket_streams(data, offs, opt):
                    for c in range(len(model.labels)):
                        z[:, c] += row_sums(model.table[c][idx], o)
                    total += row_sums((idx < opt.buckets).astype(np.float32), o)
                z = z / np.maximum(total, 1.0)[:, None] + model.bias
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in range(len(keep))] + finish(_softmax(z / model.temperature)), names=names)

    return base.mapInArrow(run, ddl)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n
