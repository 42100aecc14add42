"""Divergence audit of the sources of each language, with late string materialisation.

Terms are runs of letters ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a language keeps
the terms that stand in at least ``min_documents`` of its rows. Every (lang, source) group and every
language gives each kept term the smoothed share p = 1 + floor(scale * (count + 1) / (N + V)), where N
is the group's (the language's) count of kept terms and V their number. The divergence of a term is
f(p, q) = floor((p - q)**2 / q): summed over all kept terms for every ordered pair of sources of a
language, and per term against the language's own share.

Plan
1. One pass over the texts counts terms inside tasks. What leaves a task is fixed-width: group key,
   64-bit digest of the term, occurrences, documents. The term's string goes along once per task and
   term, in a column of its own that no count shuffle carries.
2. Strings are aggregated per digest to their minimum and maximum. Where these differ the digest
   stands for several strings; a second pass counts just those by string (``t`` in the keys, empty
   elsewhere), so results are exact whatever collides.
3. Counts meet by digest: (lang, source, term), then document frequency per (lang, term).
4. Pair sums without a dense table: with p0 the share of a term that a source does not have,
   sum f(p, q) = V f(p0, q0) + sum over g's terms of f(p, q0) - f(p0, q0) + sum over h's terms of
   f(p0, q) - f(p0, q0) + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).
   The second and third sum need a histogram of shares per source only; the last one runs over
   terms sorted by digest inside tasks, in cells of at most ``source_block`` by ``source_block``
   sources, and only sums per pair leave a task.
5. Of the term part, the best ``top_terms`` values of a group, ties included, are found on digests
   (each task prunes before the shuffle); strings are joined back to these rows only and break
   the ties.

All arithmetic is on integers (decimals of 38 digits where a long could overflow).

Edge cases. Null text, lang and source read as ''. Every row is a document, repeated ones too. A group
without terms counts as a source with N = 0; a language without kept terms has V = 0 and divergence
0 between its sources. Texts of any length are counted whole; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, clean_batches, numbered, whole_groups, written
from .terms import LETTERS, byte_words, string_digests


@dataclass(frozen=True)
class AuditOptions:
    min_documents: int = 3
    scale: int = 1_000_000_000
    top_terms: int = 200
    #: sources of one language that one side of a cell of the pair sum holds
    source_block: int = 256
    #: width of a term digest; fewer bits only make collisions (and their splitting) frequent
    digest_bits: int = 64
    #: bytes of text counted at once, and rows of counts a task holds before it hands them on
    chunk_bytes: int = 8 << 20
    held_rows: int = 1_500_000


# ------------------------------------------------------------------ counting inside tasks

_COUNTS = "l long, g long, d long, c long, n long, term string"


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in a sorted array."""
    first = np.ones(len(sorted_keys), dtype=bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.nonzero(first)[0]


def _chunk_counts(batch: pa.RecordBatch) -> pa.Table | None:
    """(l, g, term, c, n) of one batch of (l, g, text)."""
    words, offs = byte_words(batch.column(2), LETTERS)
    if len(words) == 0:
        return None
    encoded = words.dictionary_encode()
    size = len(encoded.dictionary)
    key = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(offs)) * size + encoded.indices.to_numpy()
    key.sort()
    at = _runs(key)
    occurrences = np.diff(np.append(at, len(key)))
    row, code = np.divmod(key[at], size)
    groups, first, of_row = np.unique(batch.column(1).to_numpy(), return_index=True, return_inverse=True)
    key = of_row[row] * size + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = _runs(key)
    group, code = np.divmod(key[at], size)
    langs = batch.column(0).to_numpy()[first]
    return pa.table({"l": langs[group], "g": groups[group], "term": encoded.dictionary.take(pa.array(code)),
                     "c": np.add.reduceat(occurrences[order], at).astype(np.int64),
                     "n": np.diff(np.append(at, len(key))).astype(np.int64)})


def _count_terms(opt: AuditOptions, every_string: bool):
    """The Arrow function of the pass over (l, g, text)."""
    drop = np.uint64(64 - opt.digest_bits)

    def merged(parts: list[pa.Table]) -> pa.Table:
        if len(parts) == 1:
            return parts[0]
        out = pa.concat_tables(parts).group_by(["l", "g", "term"], use_threads=False).aggregate([("c", "sum"), ("n", "sum")])
        return out.rename_columns({"c_sum": "c", "n_sum": "n"}).select(["l", "g", "term", "c", "n"])

    def out(counts: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = counts.column("term").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        digest = (string_digests(coded.dictionary) >> drop).view(np.int64)[code]
        if every_string:
            shown = counts.column("term").combine_chunks().cast(pa.string())
        else:
            first = np.full(len(coded.dictionary), -1, np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            hidden = np.ones(len(code), dtype=bool)
            hidden[first] = False
            shown = pc.if_else(pa.array(hidden), pa.scalar(None, pa.large_string()), counts.column("term").combine_chunks()).cast(pa.string())
        table = pa.table([counts.column("l"), counts.column("g"), pa.array(digest), counts.column("c"), counts.column("n"), shown],
                         names=["l", "g", "d", "c", "n", "term"])
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in clean_batches(batches, opt.chunk_bytes):
            part = _chunk_counts(batch)
            if part is None:
                continue
            parts.append(part)
            rows += part.num_rows
            if rows >= opt.held_rows:
                parts = [merged(parts)]
                rows = parts[0].num_rows
                if rows >= opt.held_rows // 2:
                    yield from out(parts[0])
                    parts, rows = [], 0
        if parts:
            yield from out(merged(parts))

    return run


# ------------------------------------------------------------------ pair sums inside tasks

def _f(p, q):
    return (p - q) * (p - q) // q


def _common_sums(block: int):
    """The Arrow function of the sum over common terms. In: (l, a, b, d, t, g, x, p, p0), sorted by term
    inside cell (a, b) of a language, x the block of source g. Out: (g, h, s)."""
    def cell(a: int, b: int, term: np.ndarray, g: np.ndarray, x: np.ndarray, p: np.ndarray, p0: np.ndarray):
        sources, first, col = np.unique(g, return_index=True, return_inverse=True)
        block_of, zero = x[first], p0[first]
        step = max(1, (4 << 20) // len(sources))
        for low in range(0, int(term[-1]) + 1, step):
            here = slice(np.searchsorted(term, low), np.searchsorted(term, low + step))
            share = np.zeros((min(step, int(term[-1]) + 1 - low), len(sources)), np.int64)
            share[term[here] - low, col[here]] = p[here]
            for i in range(len(sources)):
                rows = np.nonzero(share[:, i])[0]
                # inside one block every other source is a partner, between blocks those of the other block
                partners = np.nonzero(block_of != block_of[i])[0] if a != b else np.nonzero(np.arange(len(sources)) != i)[0]
                if not len(rows) or not len(partners):
                    continue
                q, q0 = share[np.ix_(rows, partners)], zero[partners][None, :]
                mine, mine0 = share[rows, i][:, None], zero[i]
                both = q > 0
                q = np.where(both, q, 1)
                gain = _f(mine, q) - _f(mine, q0) - _f(mine0, q) + _f(mine0, q0)
                total = np.sum(gain, axis=0, where=both)
                met = both.any(axis=0)
                yield np.full(int(met.sum()), sources[i]), sources[partners[met]], total[met]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(clean_batches(batches), ["l", "a", "b", "d"]):
            lang, a, b, d, g, x, p, p0 = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                                          for c in ("l", "a", "b", "d", "g", "x", "p", "p0"))
            t = table.column("t").combine_chunks()
            new_cell = np.ones(len(d), dtype=bool)
            new_cell[1:] = (lang[1:] != lang[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new_term = new_cell.copy()
            new_term[1:] |= (d[1:] != d[:-1]) | pc.not_equal(t.slice(1), t.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
            term = np.cumsum(new_term) - 1
            at = np.append(np.nonzero(new_cell)[0], len(d))
            for s, e in zip(at[:-1], at[1:]):
                found = list(cell(int(a[s]), int(b[s]), term[s:e] - term[s], g[s:e], x[s:e], p[s:e], p0[s:e]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], names=["g", "h", "s"])

    return run


# ------------------------------------------------------------------ the operator

def _share(count: Column, total: Column, opt: AuditOptions) -> Column:
    """1 + floor(scale * (count + 1) / total), exactly; 0 where there is no kept term."""
    top = F.lit(opt.scale).cast("decimal(12,0)") * (count + 1).cast("decimal(25,0)")
    whole = F.call_function("div", top, total.cast("decimal(25,0)"))
    return F.when(total > 0, F.lit(1) + whole).otherwise(F.lit(0).cast("long"))


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _group_keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """Every (lang, source) with integer keys l and g, and the seed that keeps the keys apart."""
    pairs = written(docs.select("lang", "source").distinct(), "audit-groups")
    seed = 0
    while True:
        groups = pairs.select("lang", "source", F.xxhash64(F.lit(seed), "lang").alias("l"), F.xxhash64(F.lit(seed), "lang", "source").alias("g"))
        n = groups.agg(F.count("*"), F.count_distinct("g"), F.count_distinct("lang"), F.count_distinct("l")).first()
        if n[0] == n[1] and n[2] == n[3]:
            return groups, seed
        seed += 1


def divergence(docs: DataFrame, opt: AuditOptions | None = None) -> DataFrame:
    """(lang, source, part, item, value long, rank int): part ``pair`` has every other source of the
    language, part ``term`` the ``top_terms`` kept terms that the source uses more than its language."""
    opt = opt or AuditOptions()
    bounded_batches(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups, seed = _group_keys(docs)
    keyed = docs.select(F.xxhash64(F.lit(seed), "lang").alias("l"), F.xxhash64(F.lit(seed), "lang", "source").alias("g"), "text")
    terms = written(keyed.mapInArrow(_count_terms(opt, False), _COUNTS), "audit-terms")
    names = written(terms.where("term is not null").groupBy("d").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "audit-names")
    split = names.where("lo <> hi").select("d")
    plain = terms.select("l", "g", "d", F.lit("").alias("t"), "c", "n")
    if not split.isEmpty():
        strings = keyed.mapInArrow(_count_terms(opt, True), _COUNTS).join(split, "d", "left_semi")
        plain = plain.join(split, "d", "left_anti").select("l", "g", "d", "t", "c", "n").unionByName(
            strings.select("l", "g", "d", F.col("term").alias("t"), "c", "n"))
    by_term = Window.partitionBy("l", "d", "t")
    counted = plain.groupBy("l", "g", "d", "t").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    kept = written(
        counted.select("*", F.sum("n").over(by_term).alias("rows"), F.sum("c").over(by_term).alias("lc"),
                       F.count("*").over(by_term).alias("spread"), F.min("g").over(by_term).alias("lead"))
        .where(F.col("rows") >= opt.min_documents)
        .select("l", "g", "d", "t", "c", "lc", "spread", (F.col("lead") == F.col("g")).alias("lead")), "audit-kept")

    # sizes per group and language: a narrow table, one row per group
    totals = kept.groupBy("l", "g").agg(F.sum("c").alias("n"), F.count_if("lead").alias("v"))
    per_lang = totals.groupBy("l").agg(F.sum("n").alias("ln"), F.sum("v").alias("v"))
    placed = numbered(groups, [F.col("lang"), F.col("source")], F.lit(1), "at", "audit-order")
    spans = placed.groupBy("l").agg(F.min("at").alias("base"), F.count("*").alias("width"))
    stats = written(
        placed.join(spans, "l").join(totals.select("g", "n"), "g", "left").join(per_lang, "l", "left")
        .select("l", "g", "lang", "source", F.floor((F.col("at") - F.col("base")) / opt.source_block).cast("int").alias("x"),
                F.ceil(F.col("width") / opt.source_block).cast("int").alias("blocks"),
                *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "ln", "v")])
        .withColumn("p0", _share(F.lit(0).cast("long"), F.col("n") + F.col("v"), opt)), "audit-sources")
    shares = kept.join(stats.drop("l", "lang", "source"), "g").select(
        "l", "g", "d", "t", "spread", "x", "blocks", "p0", _share(F.col("c"), F.col("n") + F.col("v"), opt).alias("p"),
        _share(F.col("lc"), F.col("ln") + F.col("v"), opt).alias("q"))

    pairs = _pair_sums(shares, stats, opt)
    best = shares.where("p > q").select("g", "d", "t", _divergence(F.col("p"), F.col("q")).alias("value"))
    best = best.withColumn("place", F.rank().over(Window.partitionBy("g").orderBy(F.desc("value")))).where(F.col("place") <= opt.top_terms)
    named = best.join(names.select("d", "lo"), "d").select("g", F.when(F.col("t") != "", F.col("t")).otherwise(F.col("lo")).alias("item"), "value")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("g").orderBy(F.desc("value"), "item")
        return (rows.withColumn("rank", F.row_number().over(order)).join(stats.select("g", "lang", "source"), "g")
                .select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank"))

    return ranked(pairs, "pair").unionByName(ranked(named, "term").where(F.col("rank") <= opt.top_terms))


def _pair_sums(shares: DataFrame, stats: DataFrame, opt: AuditOptions) -> DataFrame:
    """(g, item, value) for every ordered pair of sources of a language."""
    wide = "decimal(38,0)"
    side = [stats.select("l", *[F.col(c).alias(f"{c}_{s}") for c in ("g", "p0", "source")], "v") for s in "ab"]
    pairs = side[0].join(side[1].drop("v"), "l").where("g_a <> g_b")
    # a language without kept terms has p0 = 0, no terms, and no divergence
    none = F.when(F.col("v") > 0, F.col("v").cast(wide) * _divergence(F.col("p0_a"), F.greatest("p0_b", F.lit(1)))).otherwise(F.lit(0))
    parts = [pairs.select(F.col("g_a").alias("g"), F.col("g_b").alias("h"), none.cast(wide).alias("s"))]

    # one source's terms against the other's share of an absent term, both ways, by histogram
    bars = shares.groupBy("l", "g", "p0", "p").agg(F.count("*").alias("terms"))
    met = bars.join(side[1], "l").where("g <> g_b")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("p0_b")
    sums = met.groupBy("g", "g_b").agg(
        F.sum(F.col("terms").cast("decimal(18,0)") * (_divergence(p, q0) - _divergence(p0, q0)).cast("decimal(19,0)")).alias("out"),
        F.sum(F.col("terms").cast("decimal(18,0)") * (_divergence(q0, p) - _divergence(q0, p0)).cast("decimal(19,0)")).alias("back"))
    parts.append(sums.select("g", F.col("g_b").alias("h"), F.col("out").cast(wide).alias("s")))
    parts.append(sums.select(F.col("g_b").alias("g"), F.col("g").alias("h"), F.col("back").cast(wide).alias("s")))

    # common terms, cell by cell
    cells = (shares.where("spread > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("l", F.least("x", "other").alias("a"), F.greatest("x", "other").alias("b"), "d", "t", "g", "x", "p", "p0"))
    dealt = cells.repartition("l", "a", "b", "d", "t").sortWithinPartitions("l", "a", "b", "d", "t")
    common = dealt.mapInArrow(_common_sums(opt.source_block), "g long, h long, s long")
    parts.append(common.select("g", "h", F.col("s").cast(wide).alias("s")))

    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    total = total.groupBy("g", "h").agg(F.sum("s").alias("value"))
    return total.join(stats.select(F.col("g").alias("h"), F.col("source").alias("item")), "h").select("g", "item", "value")


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lc FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
cnt AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM tok t JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM kept GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM grp g LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + v.v) AS HUGEINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.lc + 1)) // (v.ln + v.v) AS HUGEINT) AS q
  FROM n JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN cnt c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM allpairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
