"""A training-data pipeline over ``documents``: five stages, each one operator of ``scanlens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs`` (the
last one: token ids). Between stages the result is a Parquet table. Rules of each stage for nulls,
empty texts and repeated rows stand in its docstring. Columns other than those of ``documents`` travel
through a stage packed in one struct, so they come back unchanged whatever they are called; the last
stage ignores them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanlens.llm import language_id, line_dedup, minhash_dedup, piece_codec, source_mix
from scanlens.llm.common import written


#: the columns that stages read
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_PACK = "packed_columns"


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but ``COLUMNS`` in one struct of positional names."""
    extra = [c for c in docs.columns if c not in COLUMNS]
    own = [docs[c] for c in docs.columns if c in COLUMNS]
    return docs.select(*own, F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(extra)]).alias(_PACK)) if extra else docs


def _unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in its order, from rows that ``_packed`` made."""
    extra = [c for c in docs.columns if c not in COLUMNS]
    return out.select(*[F.col(_PACK)[f"c{extra.index(c)}"].alias(c) if c in extra else out[c] for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: no letter in the text (null and empty
    texts too), or a calibrated score below the model's threshold. Learnt from rows with a lang."""
    rows = _packed(docs)
    model = language_id.train(rows, F.col("lang").isNotNull())
    return _unpacked(language_id.predict(rows, model, rows.columns).where("not rejected"), docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take later copies of repeated line runs out of the texts (n_chars follows). A document that
    had visible text and lost all of it is a copy and goes; others stay."""
    out = line_dedup.dedup_lines(_packed(docs))
    gone = (F.col("lines_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = out.where(~gone)
    if "n_chars" in docs.columns:
        n = F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", n)
    return _unpacked(changed, docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest doc_id, of every group of near duplicates (5-word shingles,
    similarity of 0.8 or more). Rows of one doc_id are one document: one row stays (smallest text
    hash). Rows with null doc_id stay."""
    rows = _packed(docs)
    kept = minhash_dedup.near_duplicates(rows).where("kept and doc_id is not null").select("doc_id").distinct()
    own = rows.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one = own.withColumn("first", first).where(F.col("first") == 1).select(*rows.columns)
    return _unpacked(one.unionByName(rows.where("doc_id is null")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights, document by document: a document comes as many times as the mix
    takes its words, rounded (0, 1 or 2). Texts without words have no place in a mix of words and
    go. Rows that share a doc_id share their number of copies."""
    rows = _packed(docs)
    taken = (source_mix.mixed(rows).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
             .select(F.col("doc_id").alias("id"), F.when(F.col("s") > 0, F.floor(F.col("t") / F.col("s") + 0.5)).otherwise(0)
                     .cast("int").alias("copies")).where("copies > 0"))
    joined = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("id")))
    return _unpacked(joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*rows.columns), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every whole text with an end id, decoded again: doc_id, source, n_tokens,
    ids and whether the decoded text is the text. A null text is the empty one (the end id alone);
    repeated rows are encoded each."""
    opt = piece_codec.PieceOptions(model=public_tokenizers.path("piece_bpe_32k.model"))
    out = piece_codec.pieces(docs, opt, ["doc_id", "source", "text"])
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL cannot express the learnt and hashed stages; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
