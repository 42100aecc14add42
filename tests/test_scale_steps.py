"""Steps that grow with the input: what is shuffled, and that rows come out whole."""

import re

import pytest
from pyspark.sql import functions as F

from scanlens.operators import layout as L
from scanlens.plans import registry
from scanlens.sources import fixtures as fx

DOCS = [(1, "one two  three\n\nfour & five\nsix"), (2, ""), (3, None), (4, "a\nb\nc\nd\ne <f> g\nh"), (7, "x"), (7, "x")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.length("text").cast("int").alias("n_chars"))
    docs.write.parquet(f"{at}/documents.parquet")
    return at


def exchanges(df):
    """Keys of the plan's shuffles."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ", 1)[1] for line in plan.splitlines() if "Exchange " in line and "Broadcast" not in line]


@pytest.mark.parametrize("name", ["tsv_out", "tsv_in", "hocr_out", "hocr_in", "alto_out", "alto_in", "wordstr", "word_boxes", "word_regions",
                                  "page_text", "region_text", "symbol_box", "word_confs"])
def test_texts_are_shuffled_once_and_words_never(spark, tables, name):
    """Every shuffle deals documents by doc_id, none deals words, trees or page documents."""
    shuffles = exchanges(registry.QUERIES[name](spark, tables))
    assert shuffles and all(s.startswith("hashpartitioning(doc_id") and "REPARTITION_BY_NUM" in s for s in shuffles)


def test_words_come_back_from_page_documents(spark, tables):
    once = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id <> 7")  # two rows of one page make one page with its words twice
    words = fx.words_from_documents(once)
    pages = once.select(F.col("doc_id").alias("image_id"), F.lit(1).alias("page"), F.lit(100).alias("page_width"), F.lit(50).alias("page_height"))
    want = sorted(map(tuple, words.collect()))
    assert len(want) == 15
    for back in (L.hocr_parse(L.hocr_pages(words, pages)), L.alto_parse(L.alto_pages(words, pages)), L.tsv_parse(L.tsv_rows(words, pages))):
        assert sorted(map(tuple, back.select(*words.columns).collect())) == want


def test_trees_cut_levels_with_repeated_and_null_keys(spark):
    rows = [(1, 1, 1, 1, 1, 1, 5, 5, 10, 10, 90, "a"), (1, 1, 1, 1, 1, 1, 5, 5, 10, 10, 90, "a"), (1, 1, 2, 1, 1, 2, 0, 30, 7, 4, None, "c"),
            (1, 1, 1, 2, 1, 1, 50, 5, 1, 1, 3, "b"), (1, 1, None, 1, 1, 1, 1, 1, 1, 1, 1, "n"), (1, 1, None, 1, 1, 2, 2, 1, 1, 1, 1, "m")]
    words = spark.createDataFrame(rows, "image_id long, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf int, text string")
    pages = spark.createDataFrame([(1, 1, 9, 9), (1, 1, 8, 8)], "image_id long, page int, page_width int, page_height int")
    trees = L.page_trees(words, pages).collect()
    assert sorted(t.page_width for t in trees) == [8, 9] and trees[0].blocks == trees[1].blocks
    got = [(b.block, b.l, b.t, b.r, b.b, [(p.par, [(n.line, [w.text for w in n.words]) for n in p.lines]) for p in b.paras]) for b in trees[0].blocks]
    assert got == [(None, 1, 1, 3, 2, [(1, [(1, ["n", "m"])])]), (1, 5, 5, 51, 15, [(1, [(1, ["a", "a"])]), (2, [(1, ["b"])])]),
                   (2, 0, 30, 7, 34, [(1, [(1, ["c"])])])]


def test_numbers_before_the_first_tag_of_a_level(spark):
    """Words outside pages, areas and lines get number 1, and counting starts anew in every parent."""
    hocr = ("<span class='ocrx_word' title='bbox 0 0 1 1'>a</span><div class='ocr_page'><span class='ocrx_word' title='bbox 0 0 1 1'>b</span>"
            "<div class='ocr_carea'></div><div class='ocr_carea'><span class='ocr_line'><span class='ocrx_word' title='bbox 0 0 1 1'>c</span>"
            "<span class='ocrx_word' title='bbox 0 0 1 1'>d</span></span></div></div><div class='ocr_page'><span class='ocrx_word' title='bbox 0 0 1 1'>e</span></div>")
    got = L.hocr_parse(spark.createDataFrame([(1, hocr), (2, ""), (3, None)], "image_id long, hocr string")).collect()
    assert sorted((r.text, r.page, r.block, r.par, r.line, r.word) for r in got) == [
        ("a", 1, 1, 1, 1, 1), ("b", 1, 1, 1, 1, 1), ("c", 1, 2, 1, 1, 1), ("d", 1, 2, 1, 1, 2), ("e", 2, 1, 1, 1, 1)]


# ------------------------------------------------------------------ postings

def test_packed_numbers_come_back():
    import numpy as np
    from scanlens.operators import grams as G

    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 31, (1 << 63) - 1, 5])
    column = G._varints(values, np.array([0, 3, 3, 9]))
    got, cuts = G._numbers(column)
    assert got.tolist() == values.tolist() and cuts.tolist() == [0, 3, 3, 9]
    assert [len(x) for x in column.to_pylist()] == [3, 0, 2 + 2 + 3 + 5 + 9 + 1]
    assert G._numbers(G._varints(values[:0], np.array([0])))[0].tolist() == []


def test_postings_are_packed_by_block(spark, monkeypatch):
    """One row per gram and block of texts is shuffled and written, not one per gram and text; ids in any order come back."""
    from scanlens.operators import grams as G

    index = spark.createDataFrame([(i * 7919 % 1009 - 500, "abcabc" + "x" * (i % 3)) for i in range(300)], "id long, content string").coalesce(1)
    packed = G.packed_positional(index)
    assert packed.count() == packed.select("gram").distinct().count()
    got = {(r.gram, r.id, r.tf, r.dl, tuple(r.pos)) for r in G.unpacked(packed).collect()}
    want = {(g, r.id, len(at), len(r.content) - 2, tuple([at[0], *[b - a for a, b in zip(at, at[1:])]]))
            for r in index.collect() for g in {r.content[k:k + 3] for k in range(len(r.content) - 2)}
            for at in [[k for k in range(len(r.content) - 2) if r.content[k:k + 3] == g]]}
    assert got == want
    assert {tuple(r) for r in G.unpacked(packed, False).collect()} == {w[:4] for w in want}


def test_counts_of_ids_that_repeat_are_added(spark, monkeypatch):
    """rows of one id (or of none) lie in several blocks and batches; grams and postings are not shuffled."""
    import pyarrow as pa
    from scanlens.operators import grams as G

    rows = [(1, "abcd"), (1, "abc"), (2, None), (2, "zzzz"), (None, "abcabc"), (3, "xy"), (None, "abc"), (4, "qrs"), (1, "Abc"), (5, "")]
    index = spark.createDataFrame(rows, "id long, content string")
    want = {("abc", 1, 3), ("bcd", 1, 1), ("zzz", 2, 2), ("abc", None, 3), ("bca", None, 1), ("cab", None, 1), ("qrs", 4, 1)}
    assert {tuple(r) for r in G.postings(index).collect()} == want and G.postings(index).count() == len(want)
    kept = index.coalesce(1).sortWithinPartitions("id").select("id", F.lower("content").alias("f")).collect()
    for size in (1, 2, 3, 10):
        monkeypatch.setattr(G, "BLOCK_CHARS", size)
        table = pa.Table.from_pylist([{"id": r.id, "f": r.f} for r in kept], pa.schema([("id", pa.int64()), ("f", pa.string())]))
        out = [x for b in G._counts(iter(table.to_batches(max_chunksize=size))) for x in b.to_pylist()]
        assert {(x["gram"], x["id"], x["tf"]) for x in out} == want and len(out) == len(want)
    assert [s.split("(")[0] for s in exchanges(G.postings(index))] == ["hashpartitioning"]


def test_long_lists_are_unpacked_in_small_parts(spark, monkeypatch):
    """What is unpacked at once is bounded in bytes, not in lists; without places none are unpacked."""
    import pyarrow as pa
    from scanlens.operators import grams as G

    texts = pa.table({"id": pa.array(range(1, 301), pa.int64()), "f": ["abc" * 200] * 300})
    monkeypatch.setattr(G, "BLOCK_CHARS", 6_000)
    lists = pa.Table.from_batches(list(G._packed(iter(texts.to_batches())))).combine_chunks().to_batches()
    monkeypatch.setattr(G, "LIST_BYTES", 5_000)
    plain, most = G._numbers, []

    def numbers(column):
        most.append(sum(len(v) for v in column.to_pylist()))
        return plain(column)

    monkeypatch.setattr(G, "_numbers", numbers)
    got = [x for b in G._entries(iter(lists)) for x in b.to_pylist()]
    assert max(most) <= 5_000 and len(got) == 900 and {(x["gram"], x["tf"], len(x["pos"])) for x in got} == {("abc", 200, 200), ("bca", 199, 199), ("cab", 199, 199)}
    assert sorted({x["id"] for x in got}) == list(range(1, 301))


def _written_plans(monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plain, seen = DataFrameWriter.parquet, {}

    def parquet(self, path, *args, **kwargs):
        seen[path.rsplit("/", 1)[1]] = exchanges(self._df)
        return plain(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


def test_a_commit_shuffles_no_lists(spark, tmp_path, monkeypatch):
    """Tasks write the lists of their own texts; texts in order of id are written where they are, others by block."""
    from scanlens.operators import store as ST

    seen = _written_plans(monkeypatch)
    rows = [(i, f"/p{i}", 1, f"needle {i} hay" if i % 2 else "") for i in range(1, 401)]
    index = spark.createDataFrame(rows, ST.INDEX_SCHEMA)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100m")
    for k, (made, by_block) in enumerate(((index.coalesce(4), False), (index.repartition(8), True))):
        store = ST.IndexStore(spark, str(tmp_path / f"s{k}"), block_rows=10)
        store.commit(made)
        assert seen["postings"] == [] and any("block" in x for x in seen["rows"]) == by_block
        assert store.positions(None, ["needle"]).where("gram = 'nee'").count() == 200 and store.current().count() == 400
        assert {(r.id, r.tf) for r in store.postings().where("gram = 'hay'").collect()} == {(i, 1) for i in range(1, 401, 2)}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "100m"
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_late_commits_are_spread_like_early_ones(spark, tmp_path):
    """new paths at the end of a large index fill as many blocks as their rows, and few scattered ones no more than that."""
    from scanlens.operators import store as ST

    store = ST.IndexStore(spark, str(tmp_path / "s"), block_rows=10)
    blocks = lambda c: len(list((tmp_path / "s" / "segments" / c.segment / "rows").glob("block=*")))
    new = lambda paths, m: spark.createDataFrame([(f"/p{i:04d}", m, f"text {i}") for i in paths], "path string, modtime long, content string")
    for k in range(4):
        c = store.commit_delta(new(range(100 * k, 100 * k + 100), 1))
        assert 10 <= blocks(c) <= 20
    assert blocks(store.commit_delta(new(range(0, 400, 40), 2))) <= 2
    assert store.current().count() == 400 and store.current().where("modtime = 2").count() == 10
    got = store.rows_of(spark.createDataFrame([(i,) for i in (1, 200, 400, 401)], "id long"), ["id", "content"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "text 0"), (200, "text 199"), (400, "text 399")]


def test_segments_with_postings_by_row_are_still_read(spark, tmp_path):
    import json
    import shutil

    from scanlens.operators import grams as G
    from scanlens.operators import store as ST

    store = ST.IndexStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1, "/a", 1, "needle hay"), (2, "/b", 1, "hay needles")], ST.INDEX_SCHEMA)
    store.commit(rows)
    want = {(r.gram, r.id, r.tf, r.dl, tuple(r.pos)) for r in store.positions().collect()}
    log = next((tmp_path / "s" / "log").glob("v*.json"))
    entry = json.loads(log.read_text())
    at = tmp_path / "s" / "segments" / entry["segment"] / "postings"
    shutil.move(at, tmp_path / "packed")
    G.positional(rows).withColumn("bucket", G.bucket_of(F.col("gram"), entry["buckets"])).write.partitionBy("bucket").parquet(str(at))
    for crc in log.parent.glob(".v*.crc"):
        crc.unlink()
    log.write_text(json.dumps({k: v for k, v in entry.items() if k != "packed"}))
    assert {(r.gram, r.id, r.tf, r.dl, tuple(r.pos)) for r in store.positions().collect()} == want
    store.commit_delta(spark.createDataFrame([("/b", 2, "hay")], "path string, modtime long, content string"))
    assert {(r.gram, r.id) for r in store.positions(None, ["hay", "needle"]).collect()} == {("hay", 1), ("hay", 2), ("nee", 1), ("eed", 1), ("edl", 1), ("dle", 1)}
    assert store.postings().count() == G.postings(store.current()).count()


def test_parts_follow_the_texts_not_the_files(spark, tmp_path, monkeypatch):
    """A file that compresses well has as many parts as its texts need, so no task sorts more words than planned."""
    rows = [(i, "one line of words " * 200, "en", "src1", 3600) for i in range(400)] + [(400, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fx, "CLUSTER_BYTES", 20_000)
    wanted = 400 * 3600 // 20_000
    assert fx.words(spark, str(tmp_path)).rdd.getNumPartitions() == wanted == fx.sizes(spark, str(tmp_path)).rdd.getNumPartitions()


# ------------------------------------------------------------------ symbols

def test_symbols_are_cut_from_dealt_words(spark, tables):
    """what a word's symbols share is computed below the split, the pages are the built side, and level boxes cut no text."""
    plan = registry.QUERIES["symbol_box"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    level = L.component_boxes(fx.words(spark, tables), "symbol")
    assert "split(text#" not in level._jdf.queryExecution().optimizedPlan().toString().split("posexplode(split(lt#")[0]
    words = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 10, 20, 7, 5, 9, "a😀ß"), (1, 1, 1, 1, 1, 2, 0, 0, 4, 4, 9, "z"), (1, 1, 1, 1, 1, 3, 0, 0, 4, 4, 9, None)],
                                  "image_id long, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf int, text string")
    pages = spark.createDataFrame([(1, 1, 100, 50)], "image_id long, page int, page_width int, page_height int")
    got = sorted((r.word, r.symbol, r.box) for r in L.symbol_boxes(words, pages).collect())
    assert got == [(1, 0, "a 10 25 12 30 0"), (1, 1, "😀 12 25 14 30 0"), (1, 2, "ß 14 25 17 30 0"), (2, 0, "z 0 46 4 50 0")]
    boxes = sorted((r.word, r.symbol, r.left, r.width) for r in L.component_boxes(words, "symbol").collect())
    assert boxes == [(1, 0, 10, 2), (1, 1, 12, 2), (1, 2, 14, 3), (2, 0, 0, 4)]


def test_pieces_learnt_together_are_those_learnt_alone():
    """op3_records: many groups in one step give the ids of every piece by itself."""
    import public_tokenizers
    from scanlens.llm import record_files as R

    enc = R.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), 10_000)
    pieces = list(dict.fromkeys(f"{w}{i}{e}" for i in range(700) for w in ("wort", "señal", "x😀", "") for e in ("", ".", "é\n")))
    pieces = [p for p in pieces if " " not in p]
    assert enc._find(pieces) == enc._alone([" " + p for p in pieces])
    enc.remembered = 0
    assert enc._find(pieces[::-1]) == enc._alone([" " + p for p in pieces[::-1]])


# ------------------------------------------------------------------ regions

@pytest.mark.parametrize("name", ["region_text", "word_regions"])
def test_words_meet_regions_where_they_are(spark, tables, name):
    """F3, F6 of round 4: large tables, which are not broadcast, are joined and grouped by the deal of the documents: no word is shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = exchanges(registry.QUERIES[name](spark, tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffles and all(s.startswith("hashpartitioning(doc_id") and "REPARTITION_BY_NUM" in s for s in shuffles)


def test_words_lie_in_the_boxes_that_hold_them(spark):
    """Against every box and word of a page: bands with edges on both sides, boxes that repeat, overlap, lie above 0 or lack a number."""
    where = [(1, 1), (1, 2), (2, 1), (None, 1)]
    words = [(*p, 1, 1, 1, n, left, top, 10, 16, 50, f"w{n}") for p in where for n, (left, top) in enumerate(
        [(0, 0), (5, 47), (5, 48), (5, 64), (90, 128), (0, -70), (0, None), (None, 5), (300, 4000)], 1)] + [(1, None, 1, 1, 1, 1, 0, 0, 1, 1, 1, "p")]
    boxes = [(*p, k, x, y, w, h) for p in where[:3] + [(None, 1), (1, None)] for k, (x, y, w, h) in enumerate(
        [(0, 0, 50, 64), (0, 0, 50, 64), (0, 0, 100, 200), (5, 48, 10, 16), (-5, -80, 400, 9000), (0, 0, None, 90), (0, None, 5, 90), (0, 0, 90, None), (0, 0, 0, 0)])]
    w = spark.createDataFrame(words, "image_id long, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf int, text string")
    b = spark.createDataFrame(boxes, "image_id long, page int, k int, x int, y int, w int, h int")
    want = sorted((*a[:2], a[5], k) for a in words for (i, p, k, x, y, wd, h) in boxes
                  if None not in (*a[:2], a[6], a[7], x, y, wd, h) and (i, p) == a[:2] and a[6] >= x and a[7] >= y and a[6] + a[8] <= x + wd and a[7] + a[9] <= y + h)
    got = L.words_in_boxes(w, b, ["k"])
    assert got.columns == [*w.columns, "k"] and sorted((r.image_id, r.page, r.word, r.k) for r in got.collect()) == want and len(want) > 40


# ------------------------------------------------------------------ page forms

def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tsv_lines_are_cut_once_and_words_printed_before_they_are_collected(spark, tables):
    """F2 of round 4: a line is cut once and each number read once; a word is printed where it is, not by a lambda over its page."""
    plan = _plan(L.tsv_parse(spark.createDataFrame([(1, "x")], "image_id long, tsv string").repartition(2)))
    assert plan.count(", 12)") == 1 and plan.count("try_cast(") == 11
    plan = _plan(registry.QUERIES["tsv_out"](spark, tables))
    assert "inline(array(struct(l, " in plan and not re.search(r"concat_ws\(\t, 5, [^)]*lambda", plan)


def test_tsv_rows_of_repeated_and_null_keys(spark):
    rows = [(1, 1, 1, 1, 1, 1, 5, 5, 10, 10, 90, "a"), (1, 1, 1, 1, 1, 1, 5, 5, 10, 10, 90, "a"), (1, 1, 1, 2, 1, 1, 50, 9, 1, 1, None, "b"),
            (1, 1, 0, 0, 0, 1, 3, 3, 1, 1, 7, None), (1, 1, None, 1, 1, 1, 1, 1, 1, 1, 1, "n"), (2, 1, 1, 1, 1, 1, 0, 0, 1, 1, 1, "no page"), (None, 1, 1, 1, 1, 1, 0, 0, 1, 1, 1, "no id")]
    words = spark.createDataFrame(rows, "image_id long, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf int, text string")
    pages = spark.createDataFrame([(1, 1, 9, 8), (1, 1, 9, 8), (3, 1, 7, 6), (None, 1, 5, 4)], "image_id long, page int, page_width int, page_height int")
    got = sorted(((r.image_id, r.level, r.tsv) for r in L.tsv_rows(words, pages).collect()), key=str)
    one = [(1, 1, "1 1 0 0 0 0 0 0 9 8 -1 "), (1, 2, "2 1 0 0 0 0 3 3 1 1 -1 "), (1, 2, "2 1 0 0 0 1 1 1 1 -1 "), (1, 2, "2 1 1 0 0 0 5 5 46 10 -1 "),
           (1, 3, "3 1 0 0 0 0 3 3 1 1 -1 "), (1, 3, "3 1 1 0 0 1 1 1 1 -1 "), (1, 3, "3 1 1 1 0 0 5 5 10 10 -1 "), (1, 3, "3 1 1 2 0 0 50 9 1 1 -1 "),
           (1, 4, "4 1 0 0 0 0 3 3 1 1 -1 "), (1, 4, "4 1 1 1 0 1 1 1 1 -1 "), (1, 4, "4 1 1 1 1 0 5 5 10 10 -1 "), (1, 4, "4 1 1 2 1 0 50 9 1 1 -1 "),
           (1, 5, "5 1 0 0 0 1 3 3 1 1 7"), (1, 5, "5 1 1 1 1 1 1 1 1 1 n"), (1, 5, "5 1 1 1 1 1 5 5 10 10 90 a"), (1, 5, "5 1 1 1 1 1 5 5 10 10 90 a"), (1, 5, "5 1 1 2 1 1 50 9 1 1 b")]
    want = 2 * one + [(3, 1, "1 1 0 0 0 0 0 0 7 6 -1 "), (None, 1, "1 1 0 0 0 0 0 0 5 4 -1 ")]
    assert got == sorted(((i, n, t.replace(" ", "\t")) for i, n, t in want), key=str)


def test_tsv_line_ends_and_bad_lines(spark):
    doc = "level\tpage\n5\t1\t1\t1\t1\t1\t2\t3\t4\t5\t96.7\ta\tb\r\n\r\n4\t1\t1\t1\t1\t0\t2\t3\t4\t5\t-1\t\r\r\n5\t1\t1\t1\t1\t2\t2\t3\t4\t5\t9\n5\t1\tx\n5\t1\t1\t1\t1\t3\t2\t3\t4\t5\t9\tc\r"
    docs = spark.createDataFrame([(1, doc), (2, ""), (3, None)], "image_id long, tsv string")
    assert sorted((r.word, r.conf, r.text) for r in L.tsv_parse(docs).collect()) == [(1, 96, "a\tb"), (2, 9, ""), (3, 9, "c\r")]
    assert [r.tsv for r in L.tsv_bad_lines(docs).collect()] == ["5\t1\tx"]


def test_page_documents_of_other_writers(spark):
    """Attributes in any order, spacing and quotes, some missing or broken; words before any other tag; markup and escapes in words."""
    hocr = ("<SPAN id=\"word_9_8_7_6_5\" title='x_wconf 91.6; bbox -1 2 30 4' class = \"ocrx_word\">a &lt;<strong>b</strong>&amp;lt; 'c'\t\"d\"\n</SPAN>"
            "<div class='ocr_page' title='ppageno 4'><p class='ocr_par' class='x'><span lang='en' class='ocr_line'><span class='ocrx_word' title='bbox 1 2 3'> </span>"
            "<span class='ocrx_word' title='bbox 1 2 30 4' id='word_1_2_3_4'>e<br/></span></span></p></div>")
    got = L.hocr_parse(spark.createDataFrame([(1, hocr), (2, "no tags"), (3, "<div class='ocr_page'>")], "image_id long, hocr string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == [
        (1, 5, 1, 1, 1, 1, None, None, None, None, None, ""), (1, 5, 1, 1, 1, 2, 1, 2, 29, 2, None, "e"),
        (1, 9, 8, 7, 6, 5, -1, 2, 31, 2, 91, "a <b&lt; 'c'\t\"d\"\n")]
    alto = ("<String CONTENT='before'/><a:Page PHYSICAL_IMG_NR='3'><TextBlock><TextLine>"
            "<a:String WC=\"0.07\" CONTENT=\"a &amp;quot; &#39;b&quot;\" ID=\"string_4_3_2_1\" HEIGHT=\"9\" WIDTH=\"8\" VPOS=\"7.9\" HPOS=\"6\"/><SP/>"
            "<String ID='x' HPOS = '1'\tVPOS=\"2\" WIDTH=\"x\" CONTENT=\"it's\" WC='1'/><String ID=\"string_1_1_1_1x\" HPOS=\"1\" VPOS=\"2\" WIDTH=\"3\" HEIGHT=\"4\" WC=\"\" CONTENT=\"\"/>"
            "<String  ID=\"string_1_2_3_4\" HPOS=\"1\" VPOS=\"2\" WIDTH=\"3\" HEIGHT=\"4\" WC=\"0.5\" CONTENT=\"a  b\"/><String ID=\"p\" HPOS=\"1\" VPOS=\"2\" WIDTH=\"3\" HEIGHT=\"4\" WC=\".1\" CONTENT=\"open/>"
            "</TextLine></TextBlock></a:Page>")
    got = L.alto_parse(spark.createDataFrame([(1, alto), (2, ""), (3, "<Page/>")], "image_id long, alto string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == [
        (1, 1, 1, 1, 1, 1, None, None, None, None, None, "before"), (1, 3, 1, 1, 1, 2, 1, 2, None, None, 100, "it"),
        (1, 3, 1, 1, 1, 3, 1, 2, 3, 4, None, ""), (1, 3, 1, 1, 1, 5, 1, 2, 3, 4, 10, ""), (1, 3, 1, 2, 3, 4, 1, 2, 3, 4, 50, "a  b"),
        (1, 3, 4, 3, 2, 1, 6, 7, 8, 9, 7, "a &quot; 'b\"")]


def test_page_documents_print_null_numbers(spark):
    rows = [(1, 1, 1, 1, 1, 1, None, 5, 10, 10, None, "a<"), (1, 1, 1, 1, 1, 2, 3, 5, 10, 10, 50, "b"), (1, 1, 1, 1, 1, 3, 3, 5, 10, 10, 50, None)]
    words = spark.createDataFrame(rows, "image_id long, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf int, text string")
    pages = spark.createDataFrame([(1, 1, 9, 8)], "image_id long, page int, page_width int, page_height int")
    hocr, alto = L.hocr_pages(words, pages).first().hocr, L.alto_pages(words, pages).first().alto
    assert "id='word_1_1_1_1_1' title='bbox null 5 null 15; x_wconf null'>a&lt;</span> <span class='ocrx_word' id='word_1_1_1_1_2' title='bbox 3 5 13 15; x_wconf 50'>b</span></span>" in hocr
    assert alto.count("<String") == 1 and 'HPOS="3" VPOS="5" WIDTH="10" HEIGHT="10" WC="0.50" CONTENT="b"/></TextLine>' in alto


@pytest.mark.parametrize("name, most", [("hocr_in", 6), ("alto_in", 6)])
def test_words_of_page_documents_are_read_in_one_pass(spark, tables, name, most):
    """F1, F4 of round 4: what a word tag holds is found in one pass, and a word is formatted before it is collected, not by a lambda."""
    plan = _plan(registry.QUERIES[name](spark, tables))
    assert plan.count("regexp_extract(") <= most and not re.search("format_string[(]<(span class=.ocrx_word|String)", plan) and "inline(array(struct(r, " in plan
