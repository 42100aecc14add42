"""Exact top-k search by integer inner product with a distributed M-tree.

Every component x becomes floor(scale * x) as a long; the score of two vectors is their integer inner
product. Candidates are split into *trees* by their number of components and by norm bands (lengths
within a factor of two). With one more coordinate sqrt(M**2 - |x|**2) for candidates (M the largest
length of the tree) and 0 for queries, the Euclidean distance orders candidates as the inner product
does: d**2 = |q|**2 + M**2 - 2 * score. Every tree is an M-tree (Ciaccia, Patella, Zezula, 1997) in
that metric space; a band of its own keeps long vectors from flattening the distances of others.

Index, one table in the shared folder. A tree's routing objects are drawn from a bounded sample;
every vector belongs to the nearest one. A region of more than ``shard`` rows is cut into rings by
distance to its routing object, each with its least and largest distance, so that a hot region has
several subtrees and a query leaves out the rings that lie too far in or out; only vectors at one
and the same distance are dealt over several rings by hash. A ring's subtree has paged nodes: inner
nodes with routing object, covering radius and distance to the parent, and leaf pages of at most
``page`` vectors with their distance to the page's routing object.

Search. Queries meet rings in blocks, not in a cross join: a first pass searches for each query the
nearest ring of the region whose routing object scores best and yields a k-th best score; a second
pass sends a query only to rings whose distances leave room for a better one. Inside a task a block
of queries goes through the subtree together, nodes with the most room first: a node is left out for
a query first by the stored parent distance (no computation), then by its own distance, and page
entries by |d(query, page) - d(entry, page)|. What any query of the block needs of a node or page is
computed as one matrix product. Bounds are relaxed by a relative 1e-9, scores that count are computed
in integers (exactly, in doubles, below 2**53), so results are exact; ties go to the smaller vec_id.

Edge cases. Vectors that are null, empty or hold null or non-finite components take no part, nor do
rows with null vec_id; vectors of another length than a query's are not compared with it. Repeated
rows count once per row as candidates, and a vec_id is never a candidate of itself; a repeated query
id gives one result, of its vector that is smallest as (number of components, bytes). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import clean_batches, whole_groups, written


@dataclass(frozen=True)
class MTreeOptions:
    k: int = 5
    scale: int = 256
    #: routing objects of a tree, a sample of at most this many rows
    pivots: int = 64
    #: rows of one ring, about
    shard: int = 4096
    #: vectors of one leaf page, and children of one inner node
    page: int = 64
    #: queries of one block
    block: int = 2048


# ------------------------------------------------------------------ vectors

#: norm bands per number of components: half the binary exponents of a double's square, and zero
_BANDS = 1024


def _packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    m = np.ascontiguousarray(m)
    offsets = np.arange(len(m) + 1, dtype=np.int32) * np.int32(m.shape[1] * m.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def quantised(vectors: DataFrame, opt: MTreeOptions) -> DataFrame:
    """(id, tree, sq, vec): the integer vector as doubles (bytes) and its squared length, valid rows
    only; tree is the number of components times ``_BANDS`` plus the norm band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in clean_batches(batches, 8 << 20):
            ids, lists = b.column(0), b.column(1)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(size) - size
            flat = lists.flatten()
            value = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)  # a null is as invalid as a nan
            usable = (size > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            for d in np.unique(size[usable]).tolist():
                rows = np.nonzero(usable & (size == d))[0]
                x = value[begin[rows][:, None] + np.arange(d)]
                good = np.isfinite(x).all(axis=1)
                rows, x = rows[good], np.floor(opt.scale * x[good])
                sq = np.einsum("ij,ij->i", x, x)
                band = np.clip(np.frexp(sq)[1] // 2 + 1, 0, _BANDS - 1) * (sq > 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array((d * _BANDS + band).astype(np.int64)), pa.array(sq), _packed(x)],
                                                 names=["id", "tree", "sq", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")) \
        .mapInArrow(run, "id long, tree long, sq double, vec binary")


def _matrix(col: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    first = int(np.frombuffer(offsets, np.int32)[col.offset]) if len(col) else 0
    return np.frombuffer(data, np.float64, len(col) * dims, first).reshape(-1, dims) if len(col) else np.zeros((0, dims))


def _groups(t: pa.Table, keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal integer keys of a sorted table."""
    key = np.stack([t.column(c).to_numpy() for c in keys])
    cuts = np.nonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])[0]
    for s, e in zip(cuts[:-1], cuts[1:]):
        yield tuple(int(v) for v in key[:, s]), t.slice(s, e - s)


def _lifted(x: np.ndarray, sq: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - sq, 0.0))[:, None]])


def _distances(x: np.ndarray, o: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", x - o, x - o), 0.0))


# ------------------------------------------------------------------ index

@dataclass
class Root:
    """What the driver holds of an index, per tree: at most ``pivots`` routing objects, the largest squared
    length, and the least and largest distance of the vectors of every region."""

    pivots: dict[int, np.ndarray]
    top: dict[int, float]
    reach: dict[tuple[int, int], tuple[float, float]]


def _subtree(ids: np.ndarray, pts: np.ndarray, parent: np.ndarray, page: int, out: list, up: int) -> int:
    """Append the nodes below a routing object to ``out``; returns the number of the node made.

    A node is (parent number, routing object, radius, distance to the parent's object, entries).
    """
    at = len(out)
    dist = _distances(pts, parent)
    if len(ids) <= page or dist.max() == dist.min() == 0.0:
        for i in range(0, len(ids), page):  # equal points fill several pages
            o = pts[i]
            own = _distances(pts[i:i + page], o)
            out.append((up, o, float(own.max()), float(dist[i]), ids[i:i + page], pts[i:i + page], own))
        return at
    # routing objects of the children: farthest-first, so that radii shrink
    seeds, gap = [int(np.argmax(dist))], None
    want = min(page, max(2, -(-len(ids) // page)))
    while len(seeds) < want:
        d = _distances(pts, pts[seeds[-1]])
        gap = d if gap is None else np.minimum(gap, d)
        nxt = int(np.argmax(gap))
        if gap[nxt] == 0.0:
            break
        seeds.append(nxt)
    to = np.stack([_distances(pts, pts[s]) for s in seeds]).argmin(axis=0)
    for c, s in enumerate(seeds):
        mine = np.nonzero(to == c)[0]
        if not len(mine):
            continue
        if len(mine) == len(ids):  # all on one object: pages without another level
            for i in range(0, len(ids), page):
                own = _distances(pts[i:i + page], pts[i])
                out.append((up, pts[i], float(own.max()), float(dist[i]), ids[i:i + page], pts[i:i + page], own))
            continue
        o = pts[s]
        own = _distances(pts[mine], o)
        me = len(out)
        if len(mine) <= page:
            out.append((up, o, float(own.max()), float(dist[s]), ids[mine], pts[mine], own))
        else:
            out.append((up, o, float(own.max()), float(dist[s]), None, None, None))
            _subtree(ids[mine], pts[mine], o, page, out, me)
    return at


def build(rows: DataFrame, opt: MTreeOptions) -> tuple[DataFrame, DataFrame, Root]:
    """(node table, rings, root) over quantised rows. ``rings`` has (tree, pivot, ring, low, high)."""
    tops = {r.tree: float(r.m) for r in rows.groupBy("tree").agg(F.max("sq").alias("m")).collect()}  # one row per tree
    draw = Window.partitionBy("tree").orderBy(F.xxhash64("id"), "id", "vec")
    drawn: dict[int, list] = {}
    for r in rows.withColumn("n", F.row_number().over(draw)).where(F.col("n") <= opt.pivots).select("tree", "sq", "vec").collect():
        drawn.setdefault(r.tree, []).append(r)
    pivots = {t: np.unique(_lifted(np.stack([np.frombuffer(bytes(r.vec)) for r in some]), np.array([r.sq for r in some]), tops[t]), axis=0)
              for t, some in drawn.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in clean_batches(batches, 4 << 20):
            trees = b.column(1).to_numpy()
            where, far = np.zeros(len(trees), np.int32), np.zeros(len(trees))
            for t in np.unique(trees).tolist():
                m = np.nonzero(trees == t)[0]
                p = _lifted(_matrix(b.column(3).take(pa.array(m)), t // _BANDS), b.column(2).to_numpy()[m], tops[t])
                near = _products(p, pivots[t]).argmin(axis=1)
                where[m], far[m] = near, _distances(p, pivots[t][near])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where), pa.array(far)], names=["id", "tree", "sq", "vec", "pivot", "far"])

    placed = written(rows.mapInArrow(assign, "id long, tree long, sq double, vec binary, pivot int, far double"), "mtree-rows")
    regions = written(placed.groupBy("tree", "pivot").agg(
        F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"),
        F.percentile_approx("far", [i / 1024 for i in range(1, 1024)], 10_000).alias("cuts")), "mtree-regions")
    reach = {(r.tree, r.pivot): (r.low, r.high) for r in regions.select("tree", "pivot", "low", "high").collect()}
    # ring borders: every (1024 / rings)-th of the region's quantiles; a region has up to 1,024 rings of different distance,
    # and rows at one distance are dealt over as many rings as they fill
    rings = F.ceil(F.col("n") / F.lit(opt.shard))
    step = F.greatest(F.lit(1), F.floor(F.lit(1024) / rings)).cast("int")
    borders = regions.select("tree", "pivot", F.filter("cuts", lambda _, i: (i + 1) % step == 0).alias("cuts"), rings.alias("rings"))
    below = F.size(F.filter("cuts", lambda c: c < F.col("far")))
    upto = F.size(F.filter("cuts", lambda c: c <= F.col("far")))
    # a border's own share of the region's rings, where 1,024 quantiles are fewer than they
    fine = F.ceil(F.col("rings") / (F.size("cuts") + 1)).cast("int")
    slot = below + F.pmod(F.xxhash64("id", F.lit(1)), upto - below + 1).cast("int")
    dealt = placed.join(F.broadcast(borders), ["tree", "pivot"]).withColumn(
        "ring", slot * fine + F.pmod(F.xxhash64("id", F.lit(2)), fine).cast("int")).drop("cuts", "rings")
    spans = written(dealt.groupBy("tree", "pivot", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high")), "mtree-rings")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(clean_batches(batches), ["tree", "pivot", "ring"]):
            for (tree, p, ring), g in _groups(t, ["tree", "pivot", "ring"]):
                pts = _lifted(_matrix(g.column("vec"), tree // _BANDS), g.column("sq").to_numpy(), tops[tree])
                nodes: list = []
                _subtree(g.column("id").to_numpy(), pts, pivots[tree][p], opt.page, nodes, -1)
                n = len(nodes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, tree, np.int64)), pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, ring, np.int32)),
                    pa.array(np.arange(n, dtype=np.int32)), pa.array([v[0] for v in nodes], pa.int32()),
                    pa.array([v[1].tobytes() for v in nodes], pa.binary()), pa.array([v[2] for v in nodes], pa.float64()),
                    pa.array([v[3] for v in nodes], pa.float64()),
                    pa.array([None if v[4] is None else v[4].tobytes() for v in nodes], pa.binary()),
                    pa.array([None if v[5] is None else v[5].tobytes() for v in nodes], pa.binary()),
                    pa.array([None if v[6] is None else v[6].tobytes() for v in nodes], pa.binary())],
                    names=["tree", "pivot", "ring", "node", "up", "object", "radius", "parent", "ids", "points", "own"])

    keys = ["tree", "pivot", "ring"]
    nodes = written(dealt.select(*keys, "id", "sq", "vec").repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(
        plant, "tree long, pivot int, ring int, node int, up int, object binary, radius double, parent double, "
               "ids binary, points binary, own binary"), "mtree-nodes")
    return nodes, spans, Root(pivots, tops, reach)


# ------------------------------------------------------------------ search

_SLACK = 1e-9


class Best:
    """The k best (score, vec_id) of every query of a block, and the score that an entry has to reach."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, k: int):
        self.ids, self.cut, self.k = ids, known.copy(), k
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """Scores of entries ``vec`` for queries ``rows``; -inf where an entry is not offered."""
        score = np.where((vec[None, :] == self.ids[rows][:, None]) | (score < self.cut[rows][:, None]), -np.inf, score)
        some = np.isfinite(score).any(axis=1)
        rows, score = rows[some], score[some]
        if not len(rows):
            return
        both = np.hstack([self.score[rows], score])
        who = np.hstack([self.vec[rows], np.broadcast_to(vec, score.shape)])
        order = np.lexsort((who, -both), axis=-1)[:, :self.k]
        self.score[rows], self.vec[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
        # a k-th score is a bar that equals still pass
        self.cut[rows] = np.maximum(self.cut[rows], self.score[rows][:, -1])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices."""
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T), 0.0)


def search_block(nodes: list, below: dict, q: np.ndarray, ids: np.ndarray, to_root: np.ndarray, base: np.ndarray, known: np.ndarray,
                 k: int) -> tuple[Best, int]:
    """A block of queries through one subtree: the entries that may belong to each query's k best, given
    known k-th scores, and the number of scores computed.

    base = |q|**2 + M**2, so a distance bound b allows scores up to (base - b * b) / 2.
    """
    best, computed = Best(ids, known, k), 0
    slack = _SLACK * (np.abs(base) + 1.0)

    def room(rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a distance bound (queries x nodes) leaves a query room for its bar."""
        b = np.maximum(bound, 0.0)
        return (base[rows][:, None] - b * b) / 2.0 + slack[rows][:, None] >= best.cut[rows][:, None]

    # nodes wait by the least distance bound of their queries
    heap, made = [(0.0, 0, -1, np.arange(len(ids)), to_root)], 1
    while heap:
        _, _, n, rows, d_up = heapq.heappop(heap)
        if n >= 0:
            live = room(rows, d_up[:, None] - nodes[n][2])[:, 0]  # bars have risen since
            rows, d_up = rows[live], d_up[live]
        children = below.get(n, ())
        if not len(rows) or not len(children):
            continue
        radius = np.array([nodes[c][2] for c in children])
        # by the stored parent distance: nothing is computed
        may = room(rows, np.abs(d_up[:, None] - np.array([nodes[c][3] for c in children])) - radius)
        left, down = np.nonzero(may.any(axis=1))[0], np.nonzero(may.any(axis=0))[0]
        if not len(left):
            continue
        dist = np.sqrt(_products(q[rows[left]], np.stack([nodes[children[c]][1] for c in down])))
        may = may[np.ix_(left, down)]
        for c in np.argsort(dist.min(axis=0, where=may, initial=np.inf) - radius[down]).tolist():
            child = children[down[c]]
            on = np.nonzero(may[:, c])[0]
            on = on[room(rows[left[on]], dist[on, c][:, None] - radius[down[c]])[:, 0]]
            if not len(on):
                continue
            mine, own_dist = rows[left[on]], dist[on, c]
            _, _, _, _, vec, pts, own = nodes[child]
            if vec is None:
                heapq.heappush(heap, (float((own_dist - nodes[child][2]).min()), made, child, mine, own_dist))
                made += 1
                continue
            entry = room(mine, np.abs(own_dist[:, None] - own[None, :]))
            cols, asks = np.nonzero(entry.any(axis=0))[0], np.nonzero(entry.any(axis=1))[0]
            if len(cols):
                score = q[mine[asks], :-1] @ pts[cols, :-1].T
                computed += score.size
                best.offer(mine[asks], vec[cols], np.where(entry[np.ix_(asks, cols)], score, -np.inf))
    return best, computed


def _search(nodes: DataFrame, asked: DataFrame, opt: MTreeOptions, tops: dict[int, float]) -> DataFrame:
    """(query_id, vec_id, score) from rows asked (tree, pivot, ring, query, sq, vec, known, to_root): each
    query searches the ring it names. Nodes and queries of a ring meet in one sorted stream, dealt
    by (ring, block of queries)."""
    keys = ["tree", "pivot", "ring", "block"]
    blocks = asked.groupBy("tree", "pivot", "ring").agg(F.ceil(F.count("*") / F.lit(opt.block)).cast("int").alias("blocks"))
    asked = asked.join(blocks, ["tree", "pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
    nodes = nodes.join(blocks, ["tree", "pivot", "ring"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    none = F.lit(None)
    left = nodes.select(*keys, F.lit(0).alias("kind"), F.col("node").cast("long").alias("num"), "up", "object", "radius", "parent",
                        "ids", "points", "own", none.cast("double").alias("to_root"))
    right = asked.select(*keys, F.lit(1).alias("kind"), F.col("query").alias("num"), none.cast("int").alias("up"),
                         F.col("vec").alias("object"), F.col("sq").alias("radius"), F.col("known").alias("parent"),
                         none.cast("binary").alias("ids"), none.cast("binary").alias("points"), none.cast("binary").alias("own"), "to_root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(clean_batches(batches), keys):
            for (tree, _, _, _), g in _groups(t, keys):
                d = tree // _BANDS
                asks = g.filter(pc.equal(g.column("kind"), 1))
                g = g.filter(pc.equal(g.column("kind"), 0)).select(["up", "object", "radius", "parent", "ids", "points", "own"]).to_pydict()
                if not len(asks):
                    continue
                made, below = [], {}
                for up, o, radius, parent, vec, pts, own in zip(*g.values()):
                    below.setdefault(up, []).append(len(made))
                    made.append((up, np.frombuffer(o), radius, parent, None if vec is None else np.frombuffer(vec, np.int64),
                                 None if vec is None else np.frombuffer(pts).reshape(-1, d + 1), None if vec is None else np.frombuffer(own)))
                q = _matrix(asks.column("object"), d)
                ids = asks.column("num").to_numpy()
                best, _ = search_block(made, below, np.hstack([q, np.zeros((len(q), 1))]), ids, asks.column("to_root").to_numpy(),
                                       asks.column("radius").to_numpy() + tops[tree], asks.column("parent").to_numpy(), opt.k)
                row, col = np.nonzero(np.isfinite(best.score))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best.vec[row, col]), pa.array(best.score[row, col].astype(np.int64))],
                                                 names=["query_id", "vec_id", "score"])

    return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "kind", "num").mapInArrow(
        run, "query_id long, vec_id long, score long")


def _routed(queries: DataFrame, rings: DataFrame, root: Root, first: bool) -> DataFrame:
    """Queries (query, dims, sq, vec, known) with the rings they are to search: in the first pass the
    nearest ring of the region whose routing object scores best, in the second those that leave room."""
    by_dims: dict[int, list[int]] = {}
    for t in root.pivots:
        by_dims.setdefault(t // _BANDS, []).append(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in clean_batches(batches, 1 << 20):
            dims, sq, known = (b.column(c).to_numpy() for c in (1, 2, 4))
            for d in np.unique(dims).tolist():
                rows = np.nonzero(dims == d)[0]
                x = _matrix(b.column(3).take(pa.array(rows)), d)
                x = np.hstack([x, np.zeros((len(x), 1))])
                trees = np.concatenate([np.full(len(root.pivots[t]), t) for t in by_dims[d]])
                place = np.concatenate([np.arange(len(root.pivots[t])) for t in by_dims[d]])
                span = np.array([root.reach.get((t, p), (np.inf, -np.inf)) for t, p in zip(trees.tolist(), place.tolist())])
                dist = np.sqrt(_products(x, np.concatenate([root.pivots[t] for t in by_dims[d]])))
                base = sq[rows][:, None] + np.array([root.top[t] for t in trees.tolist()])[None, :]
                empty = ~np.isfinite(span[:, 0])
                if first:
                    at_object = np.where(empty[None, :], -np.inf, base - dist * dist)
                    take = np.zeros(dist.shape, bool)
                    take[np.arange(len(rows)), at_object.argmax(axis=1)] = True
                else:
                    gap = np.maximum(np.maximum(span[:, 0] - dist, dist - span[:, 1]), 0.0)
                    take = ((base - gap * gap) / 2.0 + _SLACK * (np.abs(base) + 1.0) >= known[rows][:, None]) & ~empty[None, :]
                q, p = np.nonzero(take)
                mine = b.take(pa.array(rows[q]))
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(trees[p]), pa.array(place[p].astype(np.int32)), pa.array(dist[q, p]), pa.array(base[q, p])],
                                                 names=["query", "dims", "sq", "vec", "known", "tree", "pivot", "to_root", "base"])

    routed = queries.select("query", "dims", "sq", "vec", "known").mapInArrow(
        run, "query long, dims long, sq double, vec binary, known double, tree long, pivot int, to_root double, base double")
    gap = F.greatest(F.col("low") - F.col("to_root"), F.col("to_root") - F.col("high"), F.lit(0.0))
    met = routed.join(rings, ["tree", "pivot"])
    if first:
        nearest = Window.partitionBy("query").orderBy(gap, "ring")
        met = met.withColumn("n", F.row_number().over(nearest)).where(F.col("n") == 1).drop("n")
    else:
        met = met.where((F.col("base") - gap * gap) / 2.0 + _SLACK * (F.abs("base") + 1.0) >= F.col("known"))
    return met.select("tree", "pivot", "ring", "query", "sq", "vec", "known", "to_root")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, opt: MTreeOptions = MTreeOptions()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows of ``vectors`` (vec_id, embedding) for
    every row for which ``is_query`` (over vec_id) holds."""
    rows = written(quantised(vectors, opt), "mtree-vectors")
    nodes, rings, root = build(rows, opt)
    asked = rows.withColumn("vec_id", F.col("id")).where(is_query).select(
        F.col("id").alias("query"), F.floor(F.col("tree") / _BANDS).alias("dims"), "sq", "vec")
    queries = asked.groupBy("query").agg(F.min(F.struct("dims", "vec", "sq")).alias("q")).select("query", "q.*")
    start = queries.withColumn("known", F.lit(float("-inf")))
    begun = written(_routed(start, rings, root, True), "mtree-asked")
    one = written(_search(nodes, begun, opt, root.top), "mtree-first")
    known = _top(one, opt.k).where(F.col("rank") == opt.k).select(
        F.col("query_id").alias("query"), F.col("score").cast("double").alias("found"))
    rest = queries.join(known, "query", "left").withColumn("known", F.coalesce("found", F.lit(float("-inf"))))
    others = _routed(rest, rings, root, False).join(begun.select("tree", "pivot", "ring", "query"), ["tree", "pivot", "ring", "query"], "left_anti")
    two = _search(nodes, others, opt, root.top)
    return _top(one.unionByName(two), opt.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
