"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled (by hash) and laid end to end as one stream of words, cut into
equal blocks of ``block`` words. Slot n of the mix has the golden-ratio point frac(n * phi); the
point falls into one source's share of the cumulative weights. The slots of a source are ranked, and
the slot of rank r takes block r of its stream, running round into a second pass where the target
exceeds the source. So at any moment the mix is close to its weights, and a source's total is its
target to the word (rounded down).

Weights 5, 2, 1 repeat over the sources in code-point order, null last. The mix holds ``share`` times
all words; no source gives more than ``most`` times its size, and the excess is shared again by
weight among the others until none is above.

All steps are joins and aggregations: slots are ranked in chunks of n with offsets per (chunk,
source), documents are placed by a range-partitioned running sum, so a source with a third of all
rows spreads over all tasks. Sizes of sources reach the driver only as totals.

Edge cases. Null or blank text: size 0, takes nothing. Null source: a source of its own, last. An
empty table, or one without words, gives targets of 0. Null doc_id: a document like any other.
Repeated rows are separate documents of the stream. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, written

#: golden-ratio lattice: n * STEP mod 2**31 visits every point once, evenly at every length
_GRID = 1 << 31
_STEP = 1327217885
#: cells of the point axis in which points and source shares meet
_CELLS = 1024
_CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    block: int = 256
    seed: int = 11


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, opt: MixOptions) -> DataFrame:
    """source, source_size, first (words of all sources before it), idx, target, quota (slots)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = numbered(sums, [F.col("source").asc_nulls_last()], F.lit(1), "idx", "mix-sources")
    src = numbered(src, [F.col("source").asc_nulls_last()], F.col("source_size"), "first", "mix-sources")
    weights = F.array(*[F.lit(float(w)) for w in opt.weights])
    src = written(src.withColumn("w", F.get(weights, (F.col("idx") % len(opt.weights)).cast("int")))
                  .withColumn("cap", (F.col("source_size") * opt.most).cast("double")), "mix-sources")
    # the level at which sum(min(cap, level * w)) is the whole mix: sources above their cap leave
    whole = float(src.agg(F.sum("source_size")).first()[0] or 0) * opt.share
    level = 0.0
    while whole > 0:
        over = F.col("w") * level >= F.col("cap")
        capped, free = src.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        if not free:
            break
        nxt = max((whole - capped) / free, 0.0)
        if nxt <= level:
            break
        level = nxt
    target = F.least(F.col("cap"), F.col("w") * F.lit(level))
    return (src.withColumn("target", target)
            .withColumn("words", F.floor("target").cast("long"))
            .withColumn("quota", F.ceil(F.col("words") / F.lit(opt.block)).cast("long"))
            .select("source", "source_size", "first", "idx", "target", "words", "quota"))


def schedule(sources: DataFrame, opt: MixOptions) -> DataFrame:
    """(slot, idx, rank): the order in which the mix takes blocks; each source has ranks 0 to
    quota - 1. Slots order the mix; numbers may be left out."""
    spark = sources.sparkSession
    src = numbered(sources.select("idx", "quota").where("quota > 0"), [F.col("idx")], F.col("quota"), "before", "mix-shares")
    src = written(src, "mix-shares")
    slots = int(src.agg(F.sum("quota")).first()[0] or 0)
    edge = lambda c: F.floor(c / F.lit(float(max(slots, 1))) * F.lit(float(_GRID))).cast("long")
    cell = _GRID // _CELLS
    shares = src.select("idx", edge(F.col("before").cast("double")).alias("lo"),
                        edge((F.col("before") + F.col("quota")).cast("double")).alias("hi")).where("lo < hi")
    shares = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    points = spark.range(slots).withColumnRenamed("id", "slot") \
        .withColumn("u", (F.col("slot") % _GRID) * F.lit(_STEP) % _GRID) \
        .withColumn("cell", F.floor(F.col("u") / cell)).withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    drawn = points.join(shares, "cell").where("u >= lo and u < hi").select("slot", "chunk", "idx")
    per = drawn.groupBy("idx", "chunk").agg(F.count("*").alias("n"))
    w = Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("off", F.coalesce(F.sum("n").over(w), F.lit(0))).select("idx", "chunk", "off")
    within = drawn.withColumn("k", F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot")) - 1)
    ranked = (within.join(offsets, ["idx", "chunk"]).select("slot", "idx", (F.col("off") + F.col("k")).alias("rank"))
              .join(src.select("idx", "quota"), "idx").where("rank < quota").select("slot", "idx", "rank"))
    # a share that drew a few slots too few takes the rest at the end
    have = per.groupBy("idx").agg(F.sum("n").alias("have"))
    short = (src.join(have, "idx", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < quota")
             .select("idx", "before", F.explode(F.sequence(F.col("have"), F.col("quota") - 1)).alias("rank"))
             .select((F.lit(slots) + F.col("before") + F.col("rank")).alias("slot"), "idx", "rank"))
    return ranked.unionByName(short)


def placed(docs: DataFrame, opt: MixOptions) -> tuple[DataFrame, DataFrame]:
    """(documents on their source's stream, sources): doc_id, source, size, at and every source's
    target. ``at`` counts all words before a document, sources one after another."""
    # the texts are counted once: the range partitioning below reads its input twice
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    order = [F.col("source").asc_nulls_last(), F.xxhash64(F.col("doc_id"), F.lit(opt.seed)), F.col("doc_id"), F.col("size")]
    laid = written(numbered(sized, order, F.col("size"), "at", "mix-sizes"), "mix-placed")
    return laid, written(source_targets(laid, opt), "mix-targets")


def segments(laid: DataFrame, sources: DataFrame, opt: MixOptions) -> DataFrame:
    """(slot, at, start, words): what every slot of the mix takes, document by document."""
    key = F.col("source").eqNullSafe(F.col("s_source"))
    on = laid.where("size > 0").join(sources.withColumnRenamed("source", "s_source"), key).select(
        "at", "size", "idx", "source_size", "words", (F.col("at") - F.col("first")).alias("pos"))
    runs = on.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(opt.most - 1)))) \
        .withColumn("lo", F.col("pos") + F.col("lap") * F.col("source_size")) \
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words"))).where("lo < hi")
    cut = runs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / opt.block), F.floor((F.col("hi") - 1) / opt.block))))
    parts = cut.select("idx", "rank", "at", F.greatest("lo", F.col("rank") * opt.block).alias("from"),
                       F.least("hi", (F.col("rank") + 1) * opt.block).alias("to"), "lo")
    return schedule(sources, opt).join(parts, ["idx", "rank"]).select(
        "slot", "at", (F.col("from") - F.col("lo")).alias("start"), (F.col("to") - F.col("from")).alias("words"))


def mixed(docs: DataFrame, opt: MixOptions = MixOptions()) -> DataFrame:
    """doc_id, size, source_size, target, taken per document: how many of its words the mix takes."""
    laid, sources = placed(docs, opt)
    taken = segments(laid, sources, opt).groupBy("at").agg(F.sum("words").alias("taken"))
    some = laid.where("size > 0").join(taken, "at", "left")
    none = laid.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    key = F.col("source").eqNullSafe(F.col("s_source"))
    every = some.unionByName(none).join(
        sources.select(F.col("source").alias("s_source"), "source_size", "target"), key)
    return every.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
