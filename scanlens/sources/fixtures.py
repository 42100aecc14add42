"""Views over the driver's ``documents`` table that stand in for an index, a folder listing and
recognised layout (FIXTURES F1-F4). They are plain projections, so Catalyst prunes and pushes
through them like through any other source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: bytes of text behind one task of rows that are split into words
CLUSTER_BYTES = 4 << 20


def clustered(documents: DataFrame) -> DataFrame:
    """``documents`` dealt by doc_id, so that whatever is split from a document later (words, symbols, regions) is
    grouped and joined by image where it is: texts are shuffled once, not the many wider rows made of them. All
    tables dealt here from one input have the same number of parts, one per ``CLUSTER_BYTES`` of its texts: they are
    measured in one scan, since files say little about them (a compressed file can hold twenty times its size)."""
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = min(max(documents.sparkSession.sparkContext.defaultParallelism, -(-size // CLUSTER_BYTES)), 20_000)
    return documents.repartition(parts, "doc_id")


def _folder(doc_id: Column) -> Column:
    return (
        F.when(doc_id % 11 == 0, "/.cache")
        .when(doc_id % 13 == 0, "/.thumbs")
        .when(doc_id % 17 == 0, "/a_b")
        .otherwise("")
    )


# Extensions by doc_id % 7 (the last two are dropped by the allow-list).
FIXTURE_EXTENSIONS = [".png", ".jpeg", ".jpg", ".gif", ".webp", ".JPG", ".txt"]


def images_from_documents(documents: DataFrame) -> DataFrame:
    """``(id, path, modtime, width, height, content)``, one row per document, paths unique."""
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in FIXTURE_EXTENSIONS]), (d % 7).cast("int") + 1)
    return documents.select(
        d.alias("id"),
        F.concat(F.lit("/lib/"), F.col("lang"), _folder(d), F.lit("/"), F.col("source"), F.lit("/"),
                 d.cast("string"), ext).alias("path"),
        (F.lit(1700000000) + (d * 7919) % 1000000).alias("modtime"),
        (F.lit(100) + (d * 37) % 4000).cast("int").alias("width"),
        (F.lit(100) + (d * 53) % 4000).cast("int").alias("height"),
        F.col("text").alias("content"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images_from_documents(load(spark, sf_dir, "documents"))


def scan_from_images(images_df: DataFrame) -> DataFrame:
    """a new listing — ids ending in 3 are gone, ids ending in 4 were modified (+60 s)."""
    return images_df.where(F.col("id") % 10 != 3).withColumn(
        "modtime", F.col("modtime") + F.when(F.col("id") % 10 == 4, 60).otherwise(0)
    )


def indexed_from_images(images_df: DataFrame) -> DataFrame:
    """the index before the run — ids ending in 5 were not indexed yet."""
    return images_df.where(F.col("id") % 10 != 5)


def words_from_documents(documents: DataFrame) -> DataFrame:
    """one row per non-empty word; four text lines per block; reading order page, block, par, line, word."""
    lines = documents.select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n")).alias("ln", "lt"))
    words = lines.select("image_id", "ln", F.posexplode(F.split("lt", " ")).alias("wn", "w")).where(F.col("w") != "")
    ln, wn = F.col("ln"), F.col("wn")
    return words.select(
        "image_id",
        F.lit(1).cast("int").alias("page"),
        (F.floor(ln / 4) + 1).cast("int").alias("block"),
        F.lit(1).cast("int").alias("par"),
        (ln % 4 + 1).cast("int").alias("line"),
        (wn + 1).cast("int").alias("word"),
        (10 + 60 * wn).cast("int").alias("left"),
        (20 * ln).cast("int").alias("top"),
        (8 * F.length("w")).cast("int").alias("width"),
        F.lit(16).cast("int").alias("height"),
        ((F.col("image_id") * 31 + ln * 7 + wn * 13) % 101).cast("int").alias("conf"),
        F.col("w").alias("text"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_from_documents(clustered(load(spark, sf_dir, "documents")))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, width, height)`` of F1, dealt like ``words``."""
    docs = clustered(load(spark, sf_dir, "documents"))
    return images_from_documents(docs).select(F.col("id").alias("image_id"), "width", "height")


# The same views as DuckDB SQL, for oracle queries.
IMAGES_SQL = """images AS (SELECT doc_id AS id,
  concat('/lib/', lang, CASE WHEN doc_id % 11 = 0 THEN '/.cache' WHEN doc_id % 13 = 0 THEN '/.thumbs' WHEN doc_id % 17 = 0 THEN '/a_b' ELSE '' END,
    '/', source, '/', CAST(doc_id AS VARCHAR), CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '.png' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.jpg' WHEN 3 THEN '.gif' WHEN 4 THEN '.webp' WHEN 5 THEN '.JPG' ELSE '.txt' END) AS path,
  1700000000 + (doc_id * 7919) % 1000000 AS modtime,
  CAST(100 + (doc_id * 37) % 4000 AS INT) AS width, CAST(100 + (doc_id * 53) % 4000 AS INT) AS height, text AS content
FROM documents)"""

SCAN_SQL = """scan AS (SELECT id, path, modtime + CASE WHEN id % 10 = 4 THEN 60 ELSE 0 END AS modtime, width, height, content FROM images WHERE id % 10 <> 3)"""

INDEXED_SQL = """indexed AS (SELECT * FROM images WHERE id % 10 <> 5)"""

WORDS_SQL = """words AS (SELECT image_id, CAST(1 AS INT) AS page, CAST(ln // 4 + 1 AS INT) AS block, CAST(1 AS INT) AS par, CAST(ln % 4 + 1 AS INT) AS line, CAST(wn + 1 AS INT) AS word,
 CAST(10 + 60 * wn AS INT) AS "left", CAST(20 * ln AS INT) AS top, CAST(8 * length(w) AS INT) AS width, CAST(16 AS INT) AS height,
 CAST((image_id * 31 + ln * 7 + wn * 13) % 101 AS INT) AS conf, w AS text FROM (SELECT image_id, ln, unnest(range(len(ws))) AS wn, unnest(ws) AS w FROM (SELECT image_id, ln, string_split(lt, ' ') AS ws FROM (SELECT doc_id AS image_id, unnest(range(len(ls))) AS ln, unnest(ls) AS lt FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))) WHERE w <> '')"""


def with_views(sql: str, *views: str) -> str:
    """Prefix a query with the named fixture views as CTEs (in dependency order)."""
    order = {"images": IMAGES_SQL, "scan": SCAN_SQL, "indexed": INDEXED_SQL, "words": WORDS_SQL}
    need = list(views)
    if ("scan" in need or "indexed" in need) and "images" not in need:
        need.insert(0, "images")
    ctes = [order[v] for v in ("images", "scan", "indexed", "words") if v in need]
    return "WITH " + ",\n".join(ctes) + "\n" + sql
