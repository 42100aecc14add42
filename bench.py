"""Headline timings on the driver's tables; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

search by scan and by postings, glob and match searches, incremental commits (20 % of rows, one
row, a cleanup), compaction, and the TSV form of the layout table. Every step reads the store's
files like a real run.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from scanlens.functions import paths  # noqa: E402
from scanlens.functions import predicates as P  # noqa: E402
from scanlens.operators import layout as L  # noqa: E402
from scanlens.operators import search as S  # noqa: E402
from scanlens.operators import store as ST  # noqa: E402
from scanlens.plans.index_run import search_index  # noqa: E402
from scanlens.session import checkpoint_dir, local_session  # noqa: E402
from scanlens.sources import fixtures as fx  # noqa: E402


def timed(fn):
    t = time.time()
    out = fn()
    return round(time.time() - t, 3), out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8))
    base = f"{checkpoint_dir(spark)}/bench-{uuid.uuid4().hex}"

    images = fx.images(spark, sf)
    store = ST.IndexStore(spark, f"{base}/store", block_rows=1024)
    q = {}
    # F4 as a whole: rows, postings and sizes in one commit
    q["postings_build"], _ = timed(lambda: store.commit(fx.indexed_from_images(images).select("id", "path", "modtime", "content")))
    index = store.current()
    index.count()

    q["search_scan"], _ = timed(lambda: S.search(index, "tion", limit=100, corpus_size=store.corpus_size()).collect())
    q["search_postings"], _ = timed(lambda: search_index(store, "tion", limit=100).collect())
    q["search_scan_rare"], _ = timed(lambda: S.search(index, "ción", limit=100, corpus_size=store.corpus_size()).collect())
    q["search_postings_rare"], _ = timed(lambda: search_index(store, "ción", limit=100).collect())
    q["search_scan_rare_plain"], _ = timed(lambda: S.search(index, "ción", limit=100, corpus_size=store.corpus_size(), with_snippet=False).collect())
    q["search_postings_rare_plain"], _ = timed(lambda: search_index(store, "ción", limit=100, with_snippet=False).collect())
    q["search_match"], _ = timed(lambda: S.search(index, P.all_of("tion", "ment"), kind="match", limit=100).collect())
    q["search_match_postings"], _ = timed(lambda: search_index(store, P.all_of("tion", "ment"), kind="match", limit=100).collect())
    q["search_regex_postings"], _ = timed(lambda: search_index(store, "licen[cs]ed under cc", kind="regex", limit=100).collect())
    q["search_glob"], _ = timed(lambda: S.search(index, "[A-Z]*tion*", kind="glob", limit=100).collect())
    q["search_glob_postings"], _ = timed(lambda: search_index(store, "*licensed under cc by*", kind="glob", limit=100).collect())

    scan = fx.scan_from_images(images)
    # new (ids ending 5) and changed (ending 4): 20 % of rows, as one incremental commit
    q["upsert"], _ = timed(lambda: store.commit_delta(ST.changed_files(scan, store.current())))
    # one changed row: the cost of a commit follows the change
    one = scan.limit(1).select("path", (F.col("modtime") + 1).alias("modtime"), "content")
    q["upsert_one"], _ = timed(lambda: store.commit_delta(one))

    def cleanup():
        kept = scan.where(paths.has_allowed_extension("path") & ~paths.excluded("path", "/lib", paths.exclude_patterns()))
        return store.commit_delta(deleted=ST.deleted_paths(store.current(), kept, "/lib"))

    q["cleanup"], _ = timed(cleanup)
    q["compact"], _ = timed(store.compact)

    words = fx.words(spark, sf)
    pages = images.select(F.col("id").alias("image_id"), F.lit(1).alias("page"), F.col("width").alias("page_width"),
                          F.col("height").alias("page_height"))
    q["layout_tsv"], _ = timed(lambda: L.tsv_rows(words, pages).write.parquet(f"{base}/tsv"))

    total = round(sum(q.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": q, "sf": os.path.basename(sf),
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
