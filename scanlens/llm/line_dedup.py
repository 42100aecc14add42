"""Removal of repeated line runs: suffix ranks over line-id sequences by distributed prefix doubling.

Documents are read as sequences of line ids (128-bit hashes; blank lines are skipped). A run of
consecutive lines of one document with at least ``min_chars`` characters in total that also
stands earlier (smaller doc_id, or earlier in the same document) is a later copy. Every line that
lies in a later copy is deleted; the first copy stays, so each line text survives at least once.

Plan, DataFrame functions only
1. Lines whose id occurs once cannot lie in a repeated run: one aggregation by id removes them, and
   the rest gets a global position ``g`` in (doc_id, text hash, line) order.
2. Prefix doubling: ``r_0`` of a suffix is the smallest g with the same line; ``r_{k+1}`` is the
   smallest g with the same pair (r_k at g, r_k at g + 2**k). Equal r_k means an equal prefix of 2**k
   lines, so the classes are the blocks of the suffix array, named by their first member. Suffixes
   that became unique drop out. Doubling stops at the longest run that step 3 looks up.
3. A longest-common-prefix interval of depth l, 2**k <= l < 2**(k+1), is the set of suffixes that
   agree on (r_k at the start, r_k at the last 2**k lines). For every line the shortest run that
   starts there, and the shortest one that ends there, with ``min_chars`` characters is looked up
   in its interval; all members but the first are later copies. The union of these shortest runs
   covers every longer repeated run, so maximal runs need no enumeration.
4. Deleted line numbers go back to their document, which is rebuilt from the lines kept.

Hot lines (one line in a third of all documents) are pre-aggregated and then joined back, a plain
equi-join that can be split; no window spans more than one document.

Edge cases. Null text stays null; empty text stays empty. A document whose lines all go keeps its
row with what is left (blank lines or an empty text). Null doc_id sorts first. Repeated rows (same
doc_id and text) are one document at one place: each comes back with the same deletions. Several
texts under one doc_id are ordered by text hash. Extra columns pass through; ``lines_total`` and
``lines_removed`` replace columns of those names; names that start with ``__`` are reserved. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, written

#: characters that a repeated run must hold at least
MIN_CHARS = 20
_VISIBLE = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, th, p, i, h1, h2, n): the p-th non-blank line of a document, at line number i."""
    listed = F.filter(F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                      lambda s: s["x"].rlike(_VISIBLE))
    return (docs.where("text is not null")
            .select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), F.posexplode(listed).alias("p", "s"))
            .select("doc", "th", "p", F.col("s.i").alias("i"), F.xxhash64("s.x").alias("h1"),
                    F.xxhash64("s.x", F.lit(1)).alias("h2"), F.length("s.x").alias("n")))


def _shortest(window_values, min_chars: int):
    """Length of the shortest prefix of an array of character counts that reaches the minimum."""
    sums = F.aggregate(window_values, F.struct(F.lit(0).alias("c"), F.lit(0).alias("l")),
                       lambda a, n: F.when(a["c"] >= min_chars, a).otherwise(
                           F.struct((a["c"] + n).alias("c"), (a["l"] + 1).alias("l"))))
    return F.when(sums["c"] >= min_chars, sums["l"])


def _repeated(docs: DataFrame, min_chars: int) -> DataFrame:
    """Lines that occur more than once: (doc, th, block, p, i, g, r, ahead, back)."""
    lines = _lines(docs)
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    rows = lines.join(often, ["h1", "h2"], "left_semi").dropDuplicates(["doc", "th", "p"])
    rows = numbered(rows, [F.col("doc"), F.col("th"), F.col("p")], F.lit(1), "g", "lines")
    first = rows.groupBy("h1", "h2").agg(F.min("g").alias("r"))
    rows = rows.join(first, ["h1", "h2"]).select("doc", "th", "p", "i", "n", "g", "r")
    # lines that follow each other without a gap have a constant g - p within a document
    rows = rows.withColumn("block", F.col("g") - F.col("p"))
    w = Window.partitionBy("doc", "th", "block").orderBy("p")
    ahead = F.collect_list("n").over(w.rowsBetween(0, min_chars - 1))
    back = F.reverse(F.collect_list("n").over(w.rowsBetween(1 - min_chars, 0)))
    return rows.select("doc", "th", "block", "p", "i", "g", "r",
                       _shortest(ahead, min_chars).alias("ahead"), _shortest(back, min_chars).alias("back"))


def later_copies(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, th, i): the lines that lie in a later copy of a repeated run, once each."""
    rows = written(_repeated(docs, min_chars), "line-suffixes")
    longest = rows.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    level, found, k = rows.select("doc", "th", "block", "p", "g", "r", "ahead", "back"), None, 0
    while True:
        size = 1 << k
        w = Window.partitionBy("doc", "th", "block").orderBy("p")
        near = F.collect_list(F.struct("g", "r")).over(w.rowsBetween(0, 2 * size - 1))
        prior = F.reverse(F.collect_list(F.struct("g", "r")).over(w.rowsBetween(1 - 2 * size, 0)))
        level = level.select("*", near.alias("near"), prior.alias("prior"))
        # (start, length, rank of the first 2**k lines, rank of the last 2**k lines)
        starts = level.where(F.col("ahead").between(size, 2 * size - 1)).select(
            F.col("g").alias("s"), F.col("ahead").alias("l"), F.col("r").alias("a"),
            F.get("near", F.col("ahead") - size)["r"].alias("b"))
        ends = level.where(F.col("back").between(size, 2 * size - 1)).select(
            F.get("prior", F.col("back") - 1)["g"].alias("s"), F.col("back").alias("l"),
            F.get("prior", F.col("back") - 1)["r"].alias("a"), F.get("prior", F.lit(size - 1))["r"].alias("b"))
        runs = starts.unionByName(ends).where("a is not null and b is not null").distinct()
        if k == 0:  # one line: its rank is the first occurrence itself
            later = runs.where("s > a").select("s", "l")
        else:
            first = runs.groupBy("l", "a", "b").agg(F.min("s").alias("f"), F.count("*").alias("c")).where("c > 1")
            later = runs.join(first, ["l", "a", "b"]).where("s > f").select("s", "l")
        found = later if found is None else found.unionByName(later)
        if 2 * size > longest:
            break
        # double the prefixes; those that occur once end here (a key of their own keeps them from
        # meeting in the null group)
        own = -1 - F.col("g")
        longer = (level.withColumn("next", F.coalesce(F.get("near", F.lit(size))["r"], own))
                  .withColumn("r", F.coalesce("r", own)).drop("near", "prior"))
        pairs = (longer.where("r >= 0 and next >= 0").groupBy("r", "next")
                 .agg(F.min("g").alias("q"), F.count("*").alias("c")).where("c > 1").drop("c"))
        level = written(longer.join(pairs, ["r", "next"], "left").select(
            "doc", "th", "block", "p", "g", F.col("q").alias("r"), "ahead", "back"), "line-suffixes")
        k += 1
    gone = found.select(F.explode(F.sequence("s", F.col("s") + F.col("l") - 1)).alias("g")).distinct()
    return rows.join(gone, "g", "left_semi").select("doc", "th", "i")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with later copies of repeated line runs taken out of the text,
    plus lines_total and lines_removed (of all lines, blank ones included in the total)."""
    columns = docs.columns
    gone = (later_copies(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_chars)
            .groupBy(F.col("doc").alias("__doc"), F.col("th").alias("__at")).agg(F.collect_set("i").alias("__gone")))
    keyed = docs.withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__th") == F.col("__at")), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text").cast("string")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    joined = joined.select(
        *[docs[c] for c in columns if c not in ("text", "lines_total", "lines_removed")], text.alias("__text"),
        F.coalesce(F.size(lines), F.lit(0)).alias("__total"), F.coalesce(F.size("__gone"), F.lit(0)).alias("__removed"))
    order = [c for c in columns if c not in ("lines_total", "lines_removed")]
    return joined.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in order],
                         F.when(F.col("__text").isNull(), 0).otherwise(F.col("__total")).cast("long").alias("lines_total"),
                         F.col("__removed").cast("long").alias("lines_removed"))


#: DuckDB SQL of (doc_id, lines_total, lines_removed, text) for documents with unique ids, written
#: from the definition: every shortest run of enough characters, compared as joined text.
ORACLE_SQL = r"""
WITH ls AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM ls),
l AS (SELECT doc_id, i, x, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
      FROM raw WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM l),
-- a run from a to b: enough characters, but not without its last (or its first) line
runs AS (SELECT a.doc_id, a.p AS p0, b.p AS p1 FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {m} - 1
         WHERE b.upto - a.upto + a.n >= {m}
           AND (b.upto - b.n - a.upto + a.n < {m} OR b.upto - a.upto < {m})),
content AS (SELECT r.doc_id, r.p0, r.p1, md5(string_agg(l.x, chr(10) ORDER BY l.p)) AS h
            FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.p BETWEEN r.p0 AND r.p1 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p0) AS k FROM content),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM ranked r JOIN l ON l.doc_id = r.doc_id AND l.p BETWEEN r.p0 AND r.p1 WHERE r.k > 1),
kept AS (SELECT raw.doc_id, string_agg(raw.x, chr(10) ORDER BY raw.i) FILTER (WHERE gone.i IS NULL) AS text,
                count(*) AS lines_total, count(gone.i) AS lines_removed
         FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = raw.i GROUP BY raw.doc_id)
SELECT d.doc_id, CAST(coalesce(k.lines_total, 0) AS BIGINT) AS lines_total, CAST(coalesce(k.lines_removed, 0) AS BIGINT) AS lines_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""".replace("{m}", str(MIN_CHARS))
