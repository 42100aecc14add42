"""Store, search, grams, layout, headers, listing and the index run on small literal inputs."""

import json
import os
import re
import struct

import pytest
from pyspark.sql import functions as F

from scanlens.functions import predicates as P
from scanlens.operators import grams as G
from scanlens.operators import layout as L
from scanlens.operators import recognise as R
from scanlens.operators import search as S
from scanlens.operators import store as ST
from scanlens.plans.index_run import IndexOptions, index_folder, search_index
from scanlens.sources import headers as H
from scanlens.sources import listing as LS

IDX = "id long, path string, modtime long, content string"


def test_is_indexed(spark):
    index = spark.createDataFrame([(1, "/r/p.png", 5, "t")], IDX)
    scan = spark.createDataFrame([("/r/p.png", 5)], "path string, modtime long")
    assert ST.changed_files(scan, index).count() == 0
    assert ST.unchanged_files(scan, index).count() == 1
    assert ST.changed_files(scan, index, rescan=True).count() == 1


def test_cleanup_counts(spark):
    index = spark.createDataFrame([(1, "/r/a.png", 1, "a"), (2, "/r/b.png", 1, "b"), (3, "/other/c.png", 1, "c")], IDX)
    seen = spark.createDataFrame([("/r/a.png",), ("/r/b.png",)], "path string")
    assert index.count() - ST.cleanup(index, seen, "/r").count() == 0
    seen = spark.createDataFrame([("/r/a.png",)], "path string")
    left = ST.cleanup(index, seen, "/r")
    assert sorted(r.path for r in left.collect()) == ["/other/c.png", "/r/a.png"]


def test_modified_then_cleanup_keeps_row(spark):
    index = spark.createDataFrame([(1, "/r/p.png", 1, "old")], IDX)
    scan = spark.createDataFrame([("/r/p.png", 2)], "path string, modtime long")
    todo = ST.changed_files(scan, index)
    res = todo.withColumn("content", F.lit("new"))
    new = ST.cleanup(ST.upsert(index, res), scan, "/r").collect()
    assert [(r.id, r.modtime, r.content) for r in new] == [(1, 2, "new")]


def test_upsert_ids_and_idempotence(spark):
    index = spark.createDataFrame([(7, "/r/b.png", 1, "b")], IDX)
    res = spark.createDataFrame([("/r/c.png", 1, "c"), ("/r/a.png", 1, "a"), ("/r/b.png", 2, "b2")],
                                "path string, modtime long, content string")
    once = ST.upsert(index, res)
    got = sorted((r.path, r.id, r.modtime) for r in once.collect())
    assert got == [("/r/a.png", 8, 1), ("/r/b.png", 7, 2), ("/r/c.png", 9, 1)]
    twice = ST.upsert(once, res)
    assert sorted((r.path, r.id, r.modtime) for r in twice.collect()) == got


def test_store_commit_and_layout(spark, tmp_path):
    store = ST.IndexStore(spark, str(tmp_path / "idx"))
    assert store.check_layout() == 0 and store.current().count() == 0
    v = store.commit(spark.createDataFrame([(1, "/r/a.png", 1, "a")], IDX))
    assert v == 1 and store.current().count() == 1
    log = tmp_path / "idx" / "log"
    first = json.loads((log / "v00000001.json").read_text())
    for layout in (1, 3, None):
        (log / "v00000002.json").write_text(json.dumps({**first, "version": 2, "layout_version": layout}))
        (log / ".v00000002.json.crc").unlink(missing_ok=True)
        with pytest.raises(ST.LayoutError):
            store.current()


def test_unreadable_log_is_an_error(spark, tmp_path):
    store = ST.IndexStore(spark, str(tmp_path / "idx"))
    store.commit(spark.createDataFrame([(1, "/r/a.png", 1, "a")], IDX))
    log = tmp_path / "idx" / "log"
    (log / "v00000001.json").write_text("not json")
    (log / ".v00000001.json.crc").unlink()
    for use in (store.current, store.check_layout, store.current_version, store.commit_delta):
        with pytest.raises(ST.LayoutError):
            use()
    assert sorted(p.name for p in (tmp_path / "idx" / "segments").iterdir()) and len(list((tmp_path / "idx" / "segments").iterdir())) == 1


def test_version_is_claimed_once(spark, tmp_path):
    store = ST.IndexStore(spark, str(tmp_path / "idx"))
    store.commit(spark.createDataFrame([(1, "/r/a.png", 1, "a")], IDX))
    taken = store.log()[0]
    with pytest.raises(ST.CommitConflict):
        store._claim(taken)
    assert store.log() == [taken]


def delta(spark, rows):
    return spark.createDataFrame(rows, "path string, modtime long, content string")


def test_delta_writes_only_its_rows(spark, tmp_path):
    store = ST.IndexStore(spark, str(tmp_path / "idx"))
    store.commit(spark.createDataFrame([(i, f"/r/{i}.png", 1, f"text {i}") for i in range(1, 101)], IDX))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "idx").rglob("*.parquet")}
    done = store.commit_delta(delta(spark, [("/r/7.png", 2, "changed text"), ("/r/new.png", 5, "fresh")]),
                              spark.createDataFrame([("/r/9.png",), ("/r/nowhere.png",)], "path string"))
    assert (done.version, done.written, done.removed, done.n_rows, done.max_id) == (2, 2, 2, 100, 101)
    assert {p: p.stat().st_mtime_ns for p in before} == before  # no untouched file was rewritten
    written = spark.read.parquet(str(tmp_path / "idx" / "segments" / done.segment / "rows"))
    assert sorted(r.path for r in written.collect()) == ["/r/7.png", "/r/new.png"]
    got = {r.path: (r.id, r.modtime, r.content) for r in store.current().collect()}
    assert got["/r/7.png"] == (7, 2, "changed text") and got["/r/new.png"] == (101, 5, "fresh")
    assert "/r/9.png" not in got and len(got) == 100
    # postings and sizes stay in step, through a second commit and a compaction
    store.commit_delta(delta(spark, [("/r/9.png", 3, "back again"), ("/r/7.png", 3, "third text")]))
    for _ in range(2):
        rows = store.current()
        key = lambda df: sorted(map(tuple, df.select("gram", "id", "tf").collect()))
        assert key(store.postings()) == key(G.postings(rows))
        n, mean = store.corpus_size()
        lengths = [max(len(r.content) - 2, 0) for r in rows.collect()]
        assert n == len(lengths) and mean == pytest.approx(sum(lengths) / n)
        assert {r.path: r.id for r in rows.collect()}["/r/9.png"] == 102  # a new row, so a new id
        store.compact()
    assert len(store._live_segments()) == 1


def test_search_rank_and_snippet(spark):
    rows = [(1, "/r/a.png", 10, "needle " + "x" * 200), (2, "/r/b.png", 20, "needle needle"), (3, "/q/c.png", 30, "hay")]
    index = spark.createDataFrame(rows, IDX)
    res = S.search(index, "needle").collect()
    assert [r.path for r in res] == ["/r/b.png", "/r/a.png"]
    assert res[0].snippet == "[needle] [needle]"
    assert res[1].snippet.startswith("[needle]") and res[1].snippet.endswith("..") and len(res[1].snippet) == 66 + 2 + 2
    assert S.search(index, "needle", root="/q").count() == 0
    assert S.search(index, "ne", limit=None).count() == 0


def test_postings_plan_equals_scan(spark):
    rows = [(i, f"/r/{i}.png", i, t) for i, t in enumerate(["abcabc", "xabcx", "ab c", "ABC", "zzz", "cab"])]
    index = spark.createDataFrame(rows, IDX)
    post = G.postings(index)
    for q in ["abc", "cab", "zz", "bca"]:
        a = {r.path for r in S.search(index, q, limit=None, with_snippet=False).collect()}
        b = {r.path for r in S.search(index, q, limit=None, with_snippet=False, plan="postings", postings=post, corpus_size=(6, 2.0)).collect()}
        assert a == b, q
    tf = {(r.gram, r.id): r.tf for r in post.collect()}
    assert tf[("abc", 0)] == 2 and tf[("abc", 3)] == 1


def test_result_lines(spark):
    index = spark.createDataFrame([(1, "/r/a b.png", 1, "tab\there needle")], IDX)
    line = S.result_lines(S.search(index, "needle")).first().line
    assert line == "tab\\there [needle]\t/r/a b.png"


def _words(spark):
    rows = [(1, 1, 1, 1, 1, 1, 10, 20, 30, 16, 90, "IN"), (1, 1, 1, 1, 1, 2, 50, 20, 40, 16, 80, "a&b"),
            (1, 1, 1, 1, 2, 1, 10, 40, 30, 16, 70, "x")]
    return spark.createDataFrame(rows, "image_id long, page int, block int, par int, line int, word int, left int, "
                                       "top int, width int, height int, conf int, text string")


def test_layout_shapes(spark):
    w = _words(spark)
    pages = spark.createDataFrame([(1, 1, 200, 100)], "image_id long, page int, page_width int, page_height int")
    assert L.page_text(w).first().text == "IN a&b\nx\n"
    assert L.mean_conf(w).first().mean_conf == 80
    for r in L.tsv_rows(w, pages).collect():
        assert re.fullmatch(r"([-0-9]+\t){11}.*", r.tsv)
    for r in L.symbol_boxes(w, pages).collect():
        assert re.fullmatch(r".?( [0-9]+){5}", r.box)
    alto = L.alto_pages(w, pages).first().alto
    assert re.search(r'<Page WIDTH="200" HEIGHT="100" PHYSICAL_IMG_NR="1" ID="page_1">', alto)
    assert 'CONTENT="a&amp;b"' in alto
    back = L.alto_parse(L.alto_pages(w, pages)).orderBy("line", "word").collect()
    assert [r.text for r in back] == ["IN", "a&b", "x"]
    assert [r.text for r in L.hocr_parse(L.hocr_pages(w, pages)).orderBy("line", "word").collect()] == ["IN", "a&b", "x"]


def test_word_box_region(spark):
    w = _words(spark)
    box = spark.createDataFrame([(1, 1, 1, 10, 20, 30, 16)], "image_id long, page int, r int, x int, y int, w int, h int")
    got = L.text_in_boxes(w, box, ["r"]).first()
    assert (got.text, got.mean_conf) == ("IN\n", 90)


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\x00\x00\x00"


def test_headers(spark):
    gif = b"GIF89a" + struct.pack("<HH", 7, 9)
    jpeg = bytes.fromhex("FFD8FFE000104A46494600010100000100010000FFC0001108") + struct.pack(">HH", 30, 40) + b"\x03"
    vp8x = b"RIFF" + struct.pack("<I", 22) + b"WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    rows = [("p", png(442, 852)), ("g", gif), ("j", jpeg), ("w", vp8x), ("bad", b"\x00\x01")]
    df = spark.createDataFrame(rows, "k string, content binary")
    got = {r.k: (r.width, r.height) for r in H.dimensions(df).collect()}
    assert got == {"p": (442, 852), "g": (7, 9), "j": (40, 30), "w": (100, 50), "bad": (None, None)}


def test_tiff_pages(spark):
    def ifd(w, h, nxt):
        return struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, w) + struct.pack("<HHII", 257, 4, 1, h) + struct.pack("<I", nxt)
    tif = b"II*\x00" + struct.pack("<I", 8) + ifd(165, 67, 38) + ifd(165, 67, 0)
    df = spark.createDataFrame([(1, tif)], "id long, content binary")
    got = [(r.page, r.width, r.height) for r in H.tiff_pages(df, ["id"]).collect()]
    assert got == [(0, 165, 67), (1, 165, 67)]
    assert [r for r in H.tiff_pages(df, ["id"]).where("page = 2").collect()] == []


def test_unknown_option(spark):
    names = spark.createDataFrame([("tessedit_char_blacklist",)], "name string")
    R.check_options(spark, {"tessedit_char_blacklist": "x"}, names)
    with pytest.raises(R.UnknownOption):
        R.check_options(spark, {"fail": "fail"}, names)


def test_listing_and_index_run(spark, tmp_path, text_engine):
    root = tmp_path / "imgs"
    (root / "sub dir").mkdir(parents=True)
    (root / ".cache").mkdir()
    files = {"a.png": b"alpha needle", "sub dir/b 50%.jpg": b"beta\n\n\n\nneedle", "c.JPG": b"skip", "d.txt": b"skip",
             ".cache/e.png": b"cached", "_f.png": b"hidden", "bad.gif": b"\xff\xfe\xfa"}
    for name, data in files.items():
        (root / name).write_bytes(data)
    listed = sorted(r.path for r in LS.list_files(spark, str(root)).collect())
    assert listed == [f"{root}/_f.png", f"{root}/a.png", f"{root}/bad.gif", f"{root}/sub dir/b 50%.jpg"]
    flat = sorted(r.path for r in LS.list_files(spark, f"file://{root}/", recursive=False).collect())
    assert flat == [f"{root}/_f.png", f"{root}/a.png", f"{root}/bad.gif"]
    assert LS.list_files(spark, str(tmp_path / "nowhere")).count() == 0
    assert LS.walk(spark, str(tmp_path / "nowhere")).first().error

    store = ST.IndexStore(spark, str(tmp_path / "store"))
    rep = index_folder(spark, str(root), store, text_engine, IndexOptions(cleanup=True))
    assert rep.counts["rows_written"] == 3 and rep.counts["failed"] == 1
    idx = {r.path: r.content for r in store.current().collect()}
    assert idx[f"{root}/sub dir/b 50%.jpg"] == "beta\n\nneedle"
    hits = S.search(store.current(), "needle").collect()
    assert len(hits) == 2
    # second run: nothing changed, nothing recognised
    rep2 = index_folder(spark, str(root), store, text_engine, IndexOptions(cleanup=True))
    assert rep2.counts["rows_written"] == 0 and rep2.counts["failed"] == 1
    os.remove(root / "a.png")
    rep3 = index_folder(spark, str(root), store, text_engine, IndexOptions(cleanup=True))
    assert rep3.counts["deleted"] == 1
    assert sorted(store.current().select("path").toPandas().path) == [f"{root}/_f.png", f"{root}/sub dir/b 50%.jpg"]
    one = R.recognise_one(spark, str(root / "sub dir" / "b 50%.jpg"), text_engine).first()
    assert (one.path, one.content) == (f"{root}/sub dir/b 50%.jpg", "beta\n\nneedle")
    with pytest.raises(ValueError):
        index_folder(spark, str(root), store, text_engine, IndexOptions(cleanup=True, subdirs=False))


def snippets(spark, rows, query, **kw):
    index = spark.createDataFrame([(i, f"/r/{i}.png", i, t) for i, t in enumerate(rows)], IDX)
    return {r.path: r.snippet for r in S.search(index, query, **kw).collect()}


def test_snippet_windows(spark):
    # two hits in one window beat a lone first hit; the sentence holding the hit wins (+100)
    t = "x" * 100 + "needle" + "y" * 94 + "needle" + "zzzz" + "needle" + "w" * 100
    got = snippets(spark, [t, "Start. " + "b" * 30 + ". Next needle here" + "c" * 100, "a" * 100 + " needle"], "needle")
    assert got["/r/0.png"].count("[needle]") == 2
    assert got["/r/1.png"].startswith("..Next [needle] here")
    assert got["/r/2.png"] == ".." + ("a" * 100 + " [needle]")[41:]


def test_snippet_marks(spark):
    assert snippets(spark, ["aaaaa"], "aaa") == {"/r/0.png": "[aaaaa]"}
    assert snippets(spark, ["nations"], P.any_of("tion", "ions"), kind="match") == {"/r/0.png": "na[tions]"}
    assert snippets(spark, ["abcabc abc"], "abc") == {"/r/0.png": "[abcabc] [abc]"}
    assert snippets(spark, ["see C:\\Export now"], "c:\\export") == {"/r/0.png": "see [C:\\Export] now"}
    assert snippets(spark, ["a $1 (x) a"], "$1 (x)") == {"/r/0.png": "a [$1 (x)] a"}
    # offsets in the folded text are offsets in the text; code points beyond the basic plane count once
    assert snippets(spark, ["İ" * 150 + "needle"], "needle")["/r/0.png"].endswith("İ[needle]")
    assert snippets(spark, ["😀" * 150 + "needle"], "needle")["/r/0.png"] == ".." + "😀" * 60 + "[needle]"
    # a hit that the window cuts is marked as far as it is seen
    long = "needle" * 30
    assert snippets(spark, ["x" * 5 + long], long)["/r/0.png"].count("[") == 1


def test_search_folds_one_to_one(spark):
    rows = ["ΟΔΟΣΑ", "η οδος μου", "İstanbul", "plain"]
    index = spark.createDataFrame([(i, f"/r/{i}.png", i, t) for i, t in enumerate(rows)], IDX)
    paths = lambda q, **kw: {r.path[3] for r in S.search(index, q, **kw).collect()}
    assert paths("ΟΔΟΣ") == {"0", "1"} == paths("οδοσ")
    assert paths("İSTAN") == {"2"} == paths("istan")
    post = G.postings(index)
    for q in ("ΟΔΟΣ", "οδος", "istan"):
        assert {r.path[3] for r in S.search(index, q, plan="postings", postings=post, corpus_size=(4, 5.0)).collect()} == paths(q)
    assert G.phrase_grams("ΟΔΟΣ") == ["δοσ", "οδο"]


def test_store_search_and_glob_through_postings(spark, tmp_path):
    rows = [(i, f"/r/{i}.png", i, t) for i, t in enumerate(["one needle here", "NEEDLE two", "hay", "needles three", "x*y needle"])]
    store = ST.IndexStore(spark, str(tmp_path / "s"))
    store.commit(spark.createDataFrame(rows, IDX))
    index = store.current()
    for q, kind in (("needle", "simple"), ("*needle*", "glob"), ("[a-z]*need?e*", "glob"), ("*[*]y*", "glob"), ("n[a-z]+le\\b", "regex"),
                    (P.but_not("needle", "two"), "match"), ("zzz", "simple"), ("ne", "simple")):
        a = [tuple(r) for r in search_index(store, q, kind=kind).collect()]
        b = [tuple(r) for r in S.search(index, q, kind=kind).collect()]
        assert a == b, q


def test_foreign_layout_documents_are_read(spark):
    hocr = """<div class="ocr_page" id="page_1" title='image "x"; bbox 0 0 100 100; ppageno 2'><div class='ocr_carea' id='block_1_1' title="bbox 1 1 9 9">
    <p class='ocr_par' id='par_1_1'><span class='ocr_line' id='line_1_1' title="bbox 1 1 9 9"><span class='ocrx_word' id='word_1_1' title='bbox 1 2 5 8; x_wconf 96.5'><strong>A &amp; B</strong></span>
    <span title="bbox 6 2 9 8; x_wconf 90" class="ocrx_word" id="word_1_2">c</span></span><span class='ocr_header'><span class='ocrx_word' title='bbox 1 1 2 2'>d</span></span></p></div>
    <div class='ocr_carea'><p class='ocr_par'><span class='ocr_line'><span class='ocrx_word' title='bbox 3 3 4 4; x_wconf 5'>e</span></span></p></div></div>"""
    got = L.hocr_parse(spark.createDataFrame([(1, hocr)], "image_id long, hocr string")).orderBy("block", "line", "word").collect()
    assert [tuple(r) for r in got] == [(1, 3, 1, 1, 1, 1, 1, 2, 4, 6, 96, "A & B"), (1, 3, 1, 1, 1, 2, 6, 2, 3, 6, 90, "c"),
                                       (1, 3, 1, 1, 2, 1, 1, 1, 1, 1, None, "d"), (1, 3, 2, 1, 1, 1, 3, 3, 1, 1, 5, "e")]
    alto = """<alto:Page ID="p" PHYSICAL_IMG_NR="4"><alto:TextBlock><alto:TextLine><alto:String CONTENT="x&lt;" HPOS="1.0" VPOS="2" WIDTH="3" HEIGHT="4" ID="string_0" WC="0.96"/>
    <alto:String ID="string_1" CONTENT="y" HPOS="5" VPOS="2" WIDTH="3" HEIGHT="4"/></alto:TextLine></alto:TextBlock></alto:Page>"""
    got = L.alto_parse(spark.createDataFrame([(1, alto)], "image_id long, alto string")).orderBy("word").collect()
    assert [tuple(r) for r in got] == [(1, 4, 1, 1, 1, 1, 1, 2, 3, 4, 96, "x<"), (1, 4, 1, 1, 1, 2, 5, 2, 3, 4, None, "y")]
    tsv = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t2\t3\t4\t5\t96.06\thi\nbroken line\n4\t1\t1\t1\t1\t0\t2\t3\t4\t5\t-1\t\n"
    df = spark.createDataFrame([(1, tsv)], "image_id long, tsv string")
    assert [tuple(r) for r in L.tsv_parse(df).collect()] == [(1, 1, 1, 1, 1, 1, 2, 3, 4, 5, 96, "hi")]
    assert [r.tsv for r in L.tsv_bad_lines(df).collect()] == ["broken line"]


def test_pages_without_words_stay(spark):
    w = _words(spark)
    pages = spark.createDataFrame([(1, 1, 200, 100), (2, 1, 50, 60)], "image_id long, page int, page_width int, page_height int")
    assert {r.image_id: r.text for r in L.page_text(w, pages).collect()} == {1: "IN a&b\nx\n", 2: ""}
    assert L.hocr_pages(w, pages).count() == 2 and L.alto_pages(w, pages).count() == 2
    assert [r.tsv for r in L.tsv_rows(w, pages).where("image_id = 2").collect()] == ["1\t1\t0\t0\t0\t0\t0\t0\t50\t60\t-1\t"]
    assert L.component_boxes(w, "symbol").count() == 6


def test_jpeg_with_long_leading_segments(spark, tmp_path):
    def segment(marker, n):
        return b"\xff" + bytes([marker]) + struct.pack(">H", n + 2) + b"\0" * n

    jpeg = b"\xff\xd8" + segment(0xE1, 65533) + b"\xff" + segment(0xE2, 3000) + segment(0xC4, 20) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 100, 200) + b"\x03" + b"\0" * 500
    got = H.dimensions(spark.createDataFrame([(1, jpeg)], "id long, content binary")).first()
    assert (got.width, got.height) == (200, 100)
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.png").write_bytes(png(7, 8))
    (tmp_path / "c.png").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.jpg", "b.png", "c.png", "missing.png")], "path string")
    got = {r.path[-5:]: (r.width, r.height) for r in H.file_dimensions(files).collect()}
    assert got == {"a.jpg": (200, 100), "b.png": (7, 8), "c.png": (None, None), "g.png": (None, None)}


def test_read_bytes_goes_by_budget(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 1000)
    files = spark.createDataFrame([(k, str(tmp_path / "a.bin")) for k in range(400)] + [(400, str(tmp_path / "no"))], "k int, path string").coalesce(1)
    got = LS.read_bytes(files, budget=10_000).select("k", F.length("content").alias("n")).collect()
    assert {r.k: r.n for r in got} == {**{k: 1000 for k in range(400)}, 400: None}


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_recognition_is_spread_over_tasks(spark, tmp_path, text_engine, broadcast):
    def where(options):  # the engine reports its task
        from pyspark import TaskContext
        return lambda b: f"task {TaskContext.get().partitionId()}"

    root = tmp_path / "many"
    root.mkdir()
    for k in range(120):
        (root / f"{k}.png").write_bytes(b"x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for limit in (None, 96):
            store = ST.IndexStore(spark, str(tmp_path / f"st{limit}{broadcast}"))
            index_folder(spark, str(root), store, where, IndexOptions(limit=limit, files_per_task=16))
            assert store.current().select("content").distinct().count() >= 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_run_checks_its_options(spark, tmp_path, text_engine):
    root = tmp_path / "one"
    root.mkdir()
    (root / "a.png").write_bytes("te|xt® «x»".encode())
    store = ST.IndexStore(spark, str(tmp_path / "st"))
    names = spark.createDataFrame([("tessedit_char_whitelist",)], "name string")
    for bad in (IndexOptions(lang="english"), IndexOptions(lang="e/g"), IndexOptions(engine_options={"fail": "1"}, known_options=names)):
        with pytest.raises(ValueError):
            index_folder(spark, str(root), store, text_engine, bad)
    index_folder(spark, str(root), store, text_engine, IndexOptions(lang="ENG"))
    assert [r.content for r in store.current().collect()] == ["text x"]  # the default blacklist


def test_index_run_size_filter_and_layout_refusal(spark, tmp_path):
    def _len_engine(options):  # local, so it is shipped to the workers by value
        return lambda b: f"bytes {len(b)} needle"

    root = tmp_path / "sized"
    root.mkdir()
    (root / "small.png").write_bytes(png(50, 60))
    (root / "big.png").write_bytes(png(500, 60))
    (root / "edge.png").write_bytes(png(100, 100))  # equal to the limit: kept
    store = ST.IndexStore(spark, str(tmp_path / "st"))
    index_folder(spark, str(root), store, _len_engine, IndexOptions(max_size="100x100"))
    assert sorted(p.rsplit("/", 1)[1] for p in store.current().toPandas().path) == ["edge.png", "small.png"]
    with pytest.raises(ValueError):
        index_folder(spark, str(root), store, _len_engine, IndexOptions(max_size="100"))
