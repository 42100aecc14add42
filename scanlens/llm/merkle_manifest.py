"""Merkle manifest of a dataset by time-forward processing.

A leaf is the SHA-256 of a row's fields; the leaves of a source, in doc_id order, form a tree in which
every ``arity`` consecutive nodes (the last run may be shorter, even one) become their hash, until one
is left: the source's subroot. The subroots, ordered by source, form the top tree with the root.
Digests travel as lowercase hex text; a hash takes its inputs concatenated.

Labels. Inside a block, a node's label is the pair (last leaf it covers, level): a post-order, so
children precede their parent. The forward sweep visits the block's nodes by ascending label and sends
each digest through a priority queue to its parent's label; when the sweep gets there, the queue's
head holds exactly that node's children. In this order a block's queue never holds more than
``arity`` messages a level. The reversed sweep visits by descending label and sends to every child
its proof suffix: the siblings on the way up from the child, behind them its parent's suffix.

Plan
1. Leaf digests are computed where the texts are read (native SQL, both the row's and the checked
   copy's); from then on rows are narrow. A distributed sort numbers them by (source, doc_id).
2. Blocks have arity**``block_levels`` consecutive leaves. One round of forward sweeps, a task
   per group of blocks, turns leaves into block roots. These messages are the queue's outer part: a
   table in the shared folder, dealt by the block they go to and sorted by label. The next round
   reads them as leaves; after log(n) / block_levels rounds every source is one node, and the same
   rounds run over the subroots.
3. The rounds are repeated in reverse: each block gets the suffix of its root from the round above and
   delivers one to each of its leaves. At the end every row folds its checked leaf with its proof.
No task sees more than a few blocks, no source however large meets in one task, nothing but counts
reaches the driver.

Edge cases. A null field is hashed as ``-``, others as byte count, ``:``, value. Null sources come first,
null doc_ids first in their source; rows that share a doc_id are ordered by their digests, so reruns
agree (equal rows are equal leaves). A source of one row has that leaf as its subroot, a table of
one source that subroot as its root. An empty table gives an empty result. Extra columns are
ignored. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_batches, numbered, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class ManifestOptions:
    #: nodes of a run
    arity: int = 3
    #: levels that one round of sweeps climbs
    block_levels: int = 7


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else byte count, ``:``, value."""
    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def node_digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------ sweeps over one block

class TimeForwardQueue:
    """Messages to nodes that the sweep has not reached, by label; a node takes all of its own."""

    def __init__(self) -> None:
        self.heap: list[tuple] = []
        self.sent = 0

    def send(self, label: tuple[int, int], message) -> None:
        self.sent += 1
        heapq.heappush(self.heap, (label, self.sent, message))

    def receive(self, label: tuple[int, int]) -> list:
        out = []
        while self.heap and self.heap[0][0] == label:
            out.append(heapq.heappop(self.heap)[2])
        return out

    def next_label(self) -> tuple[int, int] | None:
        return self.heap[0][0] if self.heap else None


def _last_leaf(index: int, level: int, arity: int, leaves: int) -> int:
    """The last of a block's leaves under node ``index`` of ``level``."""
    return min((index + 1) * arity ** level, leaves) - 1


def forward_sweep(leaves: list[str], levels: int, arity: int) -> list[list[str]]:
    """Digests of a block's nodes by level; node i of a level covers leaves from i * arity**level."""
    nodes: list[list[str]] = [leaves] + [[] for _ in range(levels)]
    queue = TimeForwardQueue()
    n = len(leaves)

    def to_parent(level: int, index: int, digest: str) -> None:
        if level < levels:
            queue.send((_last_leaf(index // arity, level + 1, arity, n), level + 1), digest)

    for i, digest in enumerate(leaves):
        to_parent(0, i, digest)
        # every node whose last leaf this is, from the bottom up
        while (label := queue.next_label()) is not None and label[0] == i:
            children = queue.receive(label)
            level = label[1]
            made = node_digest(children)
            nodes[level].append(made)
            to_parent(level, len(nodes[level]) - 1, made)
    return nodes


def reversed_sweep(nodes: list[list[str]], suffix: str, arity: int) -> list[str]:
    """The proof suffix of every leaf of a block, given that of the block's root.

    A suffix is one step per level, ``<position in the run><siblings>;``.
    """
    n, levels = len(nodes[0]), len(nodes) - 1
    out = [""] * n
    queue = TimeForwardQueue()
    # descending labels: both parts are negated
    queue.send((-(n - 1), -levels), (0, suffix))
    while (label := queue.next_label()) is not None:
        for index, own in queue.receive(label):
            level = -label[1]
            if level == 0:
                out[index] = own
                continue
            first = index * arity
            run = nodes[level - 1][first:first + arity]
            for k in range(len(run)):
                step = f"{k}{''.join(run[:k] + run[k + 1:])};"
                queue.send((-_last_leaf(first + k, level - 1, arity, n), -(level - 1)), (first + k, step + own))
    return out


def proof_steps(proof: str) -> list[tuple[int, list[str]]]:
    """(position, siblings) per level, from the leaf up."""
    return [(int(s[0]), [s[i:i + 64] for i in range(1, len(s), 64)]) for s in proof.split(";") if s]


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its siblings give."""
    for k, siblings in proof_steps(proof):
        leaf = node_digest([*siblings[:k], leaf, *siblings[k:]])
    return leaf


# ------------------------------------------------------------------ rounds

def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, list[tuple]]]:
    """(tree, block, rows in label order) from rows sorted by (tree, i); a row is its columns after those."""
    held, key = [], None
    for batch in clean_batches(batches):
        for tree, i, *rest in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
            now = (tree, i // width)
            if now != key:
                if held:
                    yield *key, held
                held, key = [], now
            held.append((i, *rest))
    if held:
        yield *key, held


def _dealt(messages: DataFrame, width: int) -> DataFrame:
    """Messages dealt by the block they go to and sorted by label."""
    return (messages.withColumn("block", F.floor(F.col("i") / width)).repartition("tree", "block").drop("block")
            .sortWithinPartitions("tree", "i"))


def _levels(n: int, opt: ManifestOptions) -> int:
    """Levels of a block: up to the tree's root if it is near, else ``block_levels``."""
    up = 0
    while n > 1 and up < opt.block_levels:
        n, up = -(-n // opt.arity), up + 1
    return up


def _send_up(messages: DataFrame, opt: ManifestOptions) -> DataFrame:
    """One round of forward sweeps. In and out: (tree, i, n, digest), n the nodes of that level."""
    width = opt.arity ** opt.block_levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=["tree", "i", "n", "digest"])
            made.clear()
            return out

        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        for tree, block, rows in _blocks(batches, width):
            n = rows[0][1]
            nodes = forward_sweep([r[2] for r in rows], _levels(n, opt), opt.arity)
            made.append((tree, block, -(-n // width), nodes[-1][0]))
            if len(made) >= 2000:
                yield flush()
        if made:
            yield flush()

    return _dealt(messages, width).mapInArrow(run, "tree long, i long, n long, digest string")


def _send_down(messages: DataFrame, suffixes: DataFrame, opt: ManifestOptions) -> DataFrame:
    """One round of reversed sweeps: the messages of a round with the suffix of every one of them, from
    the suffixes (tree, i, suffix) of its block roots."""
    width = opt.arity ** opt.block_levels
    above = suffixes.select(F.col("tree").alias("up_tree"), F.col("i").alias("up_i"), "suffix")
    joined = messages.join(above, (F.col("tree") == F.col("up_tree")) & (F.floor(F.col("i") / width) == F.col("up_i")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, _, rows in _blocks(batches, width):
            nodes = forward_sweep([r[2] for r in rows], _levels(rows[0][1], opt), opt.arity)
            proofs = reversed_sweep(nodes, rows[0][3], opt.arity)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(proofs, pa.string())],
                names=["tree", "i", "suffix"])

    return _dealt(joined.select("tree", "i", "n", "digest", "suffix"), width).mapInArrow(run, "tree long, i long, suffix string")


def proofs(leaves: DataFrame, opt: ManifestOptions, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (tree, digest) of all trees, and the written messages of every round, leaves first.
    ``leaves`` is (tree, i, n, digest) with i counting from 0 to n - 1 in each tree."""
    rounds, roots = [leaves], []
    while True:
        done = rounds[-1].where("n = 1")
        roots.append(done.select("tree", "digest"))
        going = rounds[-1].where("n > 1")
        if going.isEmpty():
            break
        rounds.append(written(_send_up(going, opt), name))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return out, rounds


def _delivered(rounds: list[DataFrame], top: DataFrame, opt: ManifestOptions, name: str) -> DataFrame:
    """(tree, i, suffix) of every leaf, from the suffix (tree, suffix) of every tree's root."""
    down = None
    for messages in reversed(rounds):
        ended = messages.where("n = 1").select("tree", "i").join(top, "tree").select("tree", "i", "suffix")
        if down is not None:
            ended = ended.unionByName(_send_down(messages.where("n > 1"), down, opt))
        down = written(ended, name)
    return down


# ------------------------------------------------------------------ the operator

def manifest(docs: DataFrame, check: dict[str, Column] | None = None, opt: ManifestOptions | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, proof (steps as ``proof_steps`` reads them),
    proof_sha256 (digest of all siblings, leaf's run first), folded_root and verified.

    ``check`` replaces fields by columns of ``docs`` for the copy that is held against the manifest:
    folded_root comes from the copy's leaf and the manifest's siblings.
    """
    opt = opt or ManifestOptions()
    check = check or {}
    original = [F.col(c) for c in FIELDS]
    copy = [check.get(c, F.col(c)) for c in FIELDS]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                         leaf_digest(original).alias("leaf"), leaf_digest(copy).alias("copy"))
    # a key without nulls that sorts null sources first
    keyed = narrow.withColumn("key", F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")))
    placed = numbered(keyed, [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("copy")], F.lit(1), "at", "manifest-leaves")
    sources = placed.groupBy("key").agg(F.min("at").alias("base"), F.count("*").alias("n"))
    trees = written(numbered(sources, [F.col("key")], F.lit(1), "tree", "manifest-order"), "manifest-sources")
    rows = written(placed.join(trees, "key").select("doc_id", "source", "leaf", "copy", "tree", (F.col("at") - F.col("base")).alias("i"), "n"),
                   "manifest-rows")

    subroots, rounds = proofs(rows.select("tree", "i", "n", F.col("leaf").alias("digest")), opt, "manifest-up")
    subroots = written(subroots, "manifest-subroots")
    count = F.lit(subroots.count())
    tops, top_rounds = proofs(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), count.alias("n"), "digest"), opt, "manifest-top")
    start = tops.select("tree", F.lit("").alias("suffix"))
    upper = _delivered(top_rounds, start, opt, "manifest-top-down").select(F.col("i").alias("tree"), "suffix")
    lower = _delivered(rounds, upper, opt, "manifest-down")

    ends = subroots.withColumnRenamed("digest", "subroot")
    root = tops.select("digest").scalar().alias("root")  # one row
    out = rows.join(lower, ["tree", "i"]).join(ends, "tree").select("doc_id", "source", "leaf", "copy", "subroot", root, F.col("suffix").alias("proof"))
    return out.mapInArrow(_checked, "doc_id long, source string, leaf string, subroot string, root string, proof string, "
                                    "proof_sha256 string, folded_root string, verified boolean")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in clean_batches(batches):
        doc_id, source, leaf, copy, subroot, root, proof = batch.columns
        digests, folded = [], []
        for c, p in zip(copy.to_pylist(), proof.to_pylist()):
            digests.append(node_digest([s for _, siblings in proof_steps(p) for s in siblings]))
            folded.append(fold(c, p))
        same = [a == b for a, b in zip(folded, root.to_pylist())]
        yield pa.RecordBatch.from_arrays([doc_id, source, leaf, subroot, root, proof, pa.array(digests, pa.string()), pa.array(folded, pa.string()),
                                          pa.array(same, pa.bool_())],
                                         names=["doc_id", "source", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])


#: crc32 of the decimal doc_id by its bitwise definition; trees and folds by recursion over levels
ORACLE_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
    CASE WHEN doc_id IS NOT NULL AND list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda s, b: list_reduce(list_prepend(xor(s, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
        lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) % 2 = 1
      THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
framed AS (SELECT r, doc_id, source,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text, changed FROM docs),
leaf AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS copy FROM framed),
placed AS (SELECT r, doc_id, leaf, copy, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, copy) - 1 AS i FROM leaf),
nodes AS (SELECT CAST(tree AS BIGINT) AS tree, CAST(0 AS BIGINT) AS lvl, CAST(i AS BIGINT) AS i, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 3),
subs AS (SELECT tree, d FROM nodes WHERE n = 1),
tops AS (SELECT CAST(0 AS BIGINT) AS lvl, tree AS i, d, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, i // 3),
heights AS (SELECT tree, max(lvl) AS h FROM nodes GROUP BY tree),
allnodes AS (SELECT tree, lvl, i, d, n > 1 AS more FROM nodes WHERE n > 1
  UNION ALL SELECT h.tree, h.h + t.lvl, t.i, t.d, t.n > 1 FROM heights h CROSS JOIN tops t),
runs AS (SELECT tree, lvl, i // 3 AS p, list(d ORDER BY i) AS run FROM allnodes WHERE more GROUP BY tree, lvl, i // 3),
walk AS (SELECT r, tree, CAST(0 AS BIGINT) AS lvl, i, copy AS cur, '' AS sib FROM placed
  UNION ALL
  SELECT w.r, w.tree, w.lvl + 1, k // 3,
    sha256(array_to_string(list_concat(list_concat(run[1:k % 3], [w.cur]), run[k % 3 + 2:]), '')),
    w.sib || array_to_string(list_concat(run[1:k % 3], run[k % 3 + 2:]), '')
  FROM (SELECT w.*, CASE WHEN w.lvl = h.h THEN w.tree ELSE w.i END AS k FROM walk w JOIN heights h USING (tree)) w
  JOIN runs ON runs.tree = w.tree AND runs.lvl = w.lvl AND runs.p = w.k // 3),
ends AS (SELECT r, arg_max(cur, lvl) AS folded_root, arg_max(sib, lvl) AS sib FROM walk GROUP BY r)
SELECT doc_id, leaf, subs.d AS subroot, tops.d AS root, sha256(sib) AS proof_sha256, folded_root, folded_root = tops.d AS verified
FROM placed JOIN ends USING (r) JOIN subs USING (tree) CROSS JOIN (SELECT d FROM tops WHERE n = 1) tops
"""
