"""Plan shape and distributed numbering: the properties the design relies on at scale."""

import re

from pyspark.sql import functions as F

from scanlens.operators import grams as G
from scanlens.operators import layout as L
from scanlens.operators import search as S
from scanlens.operators import store as ST


def test_dense_ids_match_global_rank(spark):
    df = spark.range(0, 1000, numPartitions=8).select(
        F.concat(F.lit("/p/"), F.lpad(((F.col("id") * 7919) % 1000).cast("string"), 4, "0")).alias("path"))
    got = sorted((r.path, r.id) for r in ST.dense_ids(df, "path", 41).collect())
    assert [i for _, i in got] == list(range(42, 1042))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scope_pushdown_and_topk(spark, tmp_path):
    rows = [(i, f"/lib/{'en' if i % 2 else 'de'}/{i}.png", i, f"text {i} needle") for i in range(200)]
    store = ST.IndexStore(spark, str(tmp_path / "s"))
    store.commit(spark.createDataFrame(rows, ST.INDEX_SCHEMA))
    res = S.search(store.current(), "needle", root="/lib/en", limit=10, with_snippet=False)
    assert "TakeOrderedAndProject" in plan_of(res)
    assert res.count() == 10 and all(r.path.startswith("/lib/en/") for r in res.collect())
    glob = S.search(store.current(), "*needle*", kind="glob", root="/lib/en", limit=10, with_snippet=False)
    assert "TakeOrderedAndProject" in plan_of(glob) and "StringStartsWith(path,/lib/en/)" in plan_of(glob)


def test_postings_lookup_pushes_its_grams(spark, tmp_path):
    rows = [(i, f"/r/{i}.png", i, f"text {i} needle") for i in range(50)]
    store = ST.IndexStore(spark, str(tmp_path / "s"))
    store.commit(spark.createDataFrame(rows, ST.INDEX_SCHEMA))
    plan = plan_of(G.candidates(store.postings(), "needle"))
    assert "PushedFilters: [In(gram, [" in plan and plan.count("FileScan") == 1
    # the three rarest grams only
    assert len(re.search(r"In\(gram, \[([^]]*)\]", plan)[1].split(",")) == 3


def test_search_reads_the_texts_once(spark, tmp_path):
    rows = [(i, f"/r/{i}.png", i, f"text {i} needle") for i in range(50)]
    store = ST.IndexStore(spark, str(tmp_path / "s"))
    store.commit(spark.createDataFrame(rows, ST.INDEX_SCHEMA))
    res = S.search(store.current(), "needle", limit=10, with_snippet=False)
    scans = re.findall(r"FileScan parquet \[([^]]*)\]", plan_of(res))
    assert len(scans) == 1 and "content" not in scans[0]


def test_page_forms_scan_their_source_once(spark, tmp_path):
    words = [(i, 1, 1, 1, 1, 1, 10, 20, 30, 16, 90, "a") for i in range(20)]
    schema = "image_id long, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf int, text string"
    spark.createDataFrame(words, schema).write.parquet(str(tmp_path / "w"))
    w = spark.read.parquet(str(tmp_path / "w"))
    pages = spark.createDataFrame([(i, 1, 200, 100) for i in range(20)], "image_id long, page int, page_width int, page_height int")
    for df in (L.tsv_rows(w, pages), L.hocr_pages(w, pages), L.alto_pages(w, pages)):
        assert plan_of(df).count("FileScan parquet") == 1


def test_upsert_does_not_shuffle_index_text(spark):
    index = spark.range(0, 500).select(F.col("id"), F.concat(F.lit("/r/"), F.col("id").cast("string")).alias("path"),
                                       F.lit(1).cast("long").alias("modtime"), F.lit("t").alias("content"))
    res = index.where("id % 50 = 0").select("path", F.lit(2).cast("long").alias("modtime"), F.lit("u").alias("content"))
    plan = plan_of(ST.upsert(index, res))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
