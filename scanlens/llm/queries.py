"""Registered queries of the training-data operators, one per operator: each runs over its whole
table with production parameters. ``ORACLE`` has the DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (benchmark_clean, language_id, line_dedup, merkle_manifest, minhash_dedup, mtree, piece_codec, quality, record_files, source_audit,
               source_mix, vector_dedup, warc_derive)
from .subword import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of whole documents: 3-word shingles, similarity of 0.85 or more."""
    return minhash_dedup.near_duplicates(
        _table(spark, sf_dir, "documents"), minhash_dedup.MinHashOptions(shingle_words=3, percent=85))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from documents whose crc32 mod 3 is not 1."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, crc_mod(F.col("doc_id"), 3) != 1)
    out = language_id.predict(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "rejected")


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-id records, read back from the files."""
    opt = record_files.RecordOptions(tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    out = record_files.encoded(_table(spark, sf_dir, "documents"), opt, with_ids=False)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "offset")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings of equal label: cosine of 0.98 or more."""
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best by integer inner product for every vector whose id is divisible by 50."""
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1: words taken of every document."""
    return source_mix.mixed(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response record."""
    return warc_derive.derive(warc_derive.responses(_table(spark, sf_dir, "pages")), ["page_id"])


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids and decoded text of every whole document, as digests."""
    opt = piece_codec.PieceOptions(model=public_tokenizers.path("piece_bpe_32k.model"))
    return piece_codec.pieces(_table(spark, sf_dir, "documents"), opt, ["doc_id"], digest=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learnt from rows whose crc32 mod 5 is not 0."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    out = quality.score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                      "score", "predicted")


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_total", "lines_removed", "text")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of each language from the others, and the terms it over-uses."""
    return source_audit.divergence(_table(spark, sf_dir, "documents"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document that lie in 10-word passages of the benchmark."""
    out = benchmark_clean.passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle roots and proofs of all documents, held against a copy with deleted line ends."""
    docs = _table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle_manifest.manifest(docs, check={"text": changed})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_language": op2_language,
    "op3_records": op3_records,
    "op4_vectors": op4_vectors,
    "op5_topk": op5_topk,
    "op6_mix": op6_mix,
    "op7_warc": op7_warc,
    "op8_pieces": op8_pieces,
    "op9_quality": op9_quality,
    "op10_line_runs": op10_line_runs,
    "op11_divergence": op11_divergence,
    "op12_decontaminate": op12_decontaminate,
    "op13_manifest": op13_manifest,
}

ORACLE: dict[str, str] = {
    "op10_line_runs": line_dedup.ORACLE_SQL,
    "op11_divergence": source_audit.ORACLE_SQL,
    "op12_decontaminate": benchmark_clean.ORACLE_SQL,
    "op13_manifest": merkle_manifest.ORACLE_SQL,
}
