"""Locators, path look-up, log states, merging, positions and regex conditions of the store."""

import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from scanlens.functions import predicates as P
from scanlens.functions.arrays import bound, floor_index, running_sums
from scanlens.functions.regex_grams import required
from scanlens.functions.text import fold_text
from scanlens.operators import grams as G
from scanlens.operators import search as S
from scanlens.operators import store as ST
from scanlens.plans.index_run import search_index

IDX = ST.INDEX_SCHEMA
NEW = "path string, modtime long, content string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def index_of(spark, n, text=lambda i: f"text {i} needle"):
    return spark.createDataFrame([(i, f"/r/{i}.png", i, text(i)) for i in range(1, n + 1)], IDX)


# ------------------------------------------------------------------ arrays and snippet

def test_running_sums_and_floor_index(spark):
    rng = random.Random(2)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate([0, 1, 5, 127, 128, 129, 300, 513])]
    df = spark.createDataFrame(rows, "k int, v array<int>").withColumn("s", running_sums(F.col("v")))
    for k, v in rows:
        s = df.where(F.col("k") == k).first().s
        assert s == [sum(v[:i]) for i in range(len(v) + 1)]
    a = spark.createDataFrame([([0, 3, 3, 8, 20],)], "a array<int>")

    def at(q):
        return bound(F.col("a"), lambda x: floor_index(x, F.lit(q))).alias(f"q{q}")

    got = a.select(*[at(q) for q in (0, 1, 2, 3, 7, 8, 19, 20, 99)]).first()
    assert list(got) == [0, 0, 0, 2, 2, 3, 3, 4, 4]


def test_snippet_scans_the_text_once_per_phrase(spark):
    df = index_of(spark, 3)
    for phrases in (["the"], ["the", "cat", "dog"]):
        plan = df.select(S.snippet(F.col("content"), phrases).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == len(phrases)
        # sentences and the window's code points
        assert plan.count("regexp_extract_all(") == 2
    long = spark.createDataFrame([(1, "/a", 1, "the cat. " * 20000)], IDX)
    assert S.with_snippet_column(long, ["the"]).first().snippet.startswith("[the] cat. ")


# ------------------------------------------------------------------ locators

def test_rows_are_read_from_blocks_that_hold_a_candidate(spark, tmp_path):
    store = ST.IndexStore(spark, str(tmp_path / "s"), block_rows=10)
    store.commit(index_of(spark, 100))
    rows = tmp_path / "s" / "segments" / store.log()[0].segment / "rows"
    assert len(list(rows.glob("block=*"))) == 10
    ids = spark.createDataFrame([(15,), (17,), (93,)], "id long")
    want = sorted(map(tuple, store.rows_of(ids, ["id", "content"]).collect()))
    assert want == [(i, f"text {i} needle") for i in (15, 17, 93)]
    width = store.log()[0].width
    for b in rows.glob("block=*"):
        if int(b.name[6:]) not in {i // width for i in (15, 17, 93)}:
            shutil.rmtree(b)
    got = store.rows_of(ids, ["id", "content"])
    assert sorted(map(tuple, got.collect())) == want and "PartitionFilters: [block" in plan_of(got)


def test_ranked_search_reads_no_text_before_the_snippet(spark, tmp_path):
    store = ST.IndexStore(spark, str(tmp_path / "s"), block_rows=10)
    store.commit(index_of(spark, 60, lambda i: "hay " * i + ("needle in" if i in (7, 33) else "")))
    res = search_index(store, "needle", with_snippet=False)
    assert [r.path for r in res.collect()] == ["/r/7.png", "/r/33.png"] and "content" not in plan_of(res)
    assert "content" not in plan_of(G.phrase_places(store.positions(None, ["needle"]), ["needle"]))


# ------------------------------------------------------------------ positions

def places(text, phrase):
    t, p = fold_text(text), fold_text(phrase)
    return [i for i in range(len(t) - len(p) + 1) if t[i:i + len(p)] == p]


def test_phrase_places_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbß😀 Σ") for _ in range(rng.choice([0, 2, 3, 10, 60, 200]))) for _ in range(120)] + [None, "aaaaaaaa"]
    index = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    pos = G.positional(index)
    flat = {(r.gram, r.id): (r.tf, r.pos) for r in pos.collect()}
    for (gram, i), (tf, steps) in flat.items():
        at = [sum(steps[:k + 1]) for k in range(tf)]
        assert at == places(texts[i], gram)
    assert {(r.gram, r.id, r.tf) for r in G.postings(index.where("content is not null")).collect()} == {(g, i, v[0]) for (g, i), v in flat.items()}
    phrases = ["aaa", "aAb", "abba", "ab ab", "aaaaaa", "😀 Σ", "zzz", " σa"]
    got = {r.id: r for r in G.phrase_places(pos, phrases).collect()}
    for i, t in enumerate(texts):
        want = [places(t or "", p) for p in phrases]
        assert any(want) == (i in got)
        if i in got:
            assert [list(got[i][f"s_{k}"]) for k in range(len(phrases))] == want


def test_stored_search_equals_scan(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "cat", "needle", "and", "THE", "on", "dogs", "a.", "then"]
    rows = [(i, f"/r/{'x' if i % 3 else 'y'}/{i}.png", i % 5, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(1, 90)]
    store = ST.IndexStore(spark, str(tmp_path / "s"), block_rows=20)
    store.commit(spark.createDataFrame(rows, IDX))
    store.commit_delta(spark.createDataFrame([("/r/x/4.png", 9, "the needle and the cat"), ("/r/z.png", 1, "needle")], NEW),
                       spark.createDataFrame([("/r/x/5.png",), ("/r/y/6.png",)], "path string"))
    index = store.current()
    size = store.corpus_size()
    queries = [("needle", "simple"), ("the cat", "simple"), (P.near("cat", "dogs", 4), "match"), (P.near("the", "the", 0), "match"),
               (P.starts_with("the"), "match"), (P.any_of(P.all_of("cat", "dogs"), "then on"), "match"), (P.but_not("needle", "and the"), "match"),
               (P.all_of("ne", "the"), "match"), ("th[ae]n? (on|dogs) a", "regex"), ("*cat*dogs*", "glob"), ("need.e", "regex"), ("(?i)NEEDLE", "regex")]
    for q, kind in queries:
        for kw in ({}, {"root": "/r/x", "limit": None, "with_snippet": False}):
            a = [tuple(r) for r in search_index(store, q, kind=kind, **kw).collect()]
            b = [tuple(r) for r in S.search(index, q, kind=kind, corpus_size=size, **kw).collect()]
            assert a == b, (q, kw)


# ------------------------------------------------------------------ regex conditions

def holds(condition, text):
    if isinstance(condition, str):
        return condition in text
    return (all if condition[0] == "and" else any)(holds(c, text) for c in condition[1:])


def test_regex_conditions_hold_for_every_match():
    rng = random.Random(3)

    def pattern(depth):
        kind = rng.choice(["lit", "lit", "lit", "class", "group", "repeat", "any"]) if depth else "lit"
        if kind == "lit":
            return "".join(rng.choice("abcX") for _ in range(rng.randint(1, 4)))
        if kind == "class":
            return rng.choice(["[ab]", "[a-c]", "[^a]", "\\w", "\\b", "^", "$"])
        if kind == "any":
            return rng.choice([".", ".*", ".+?"])
        inner = "".join(pattern(depth - 1) for _ in range(rng.randint(1, 3)))
        if kind == "repeat":
            return f"(?:{inner})" + rng.choice(["?", "*", "+", "{2}", "{2,4}", "{0,1}"])
        return "(" + inner + "|" + pattern(depth - 1) + ")"

    texts = ["".join(rng.choice("abcX \n") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    useful = 0
    for _ in range(400):
        p = "".join(pattern(2) for _ in range(rng.randint(1, 3)))
        condition = required(p)
        if condition is None:
            continue
        useful += 1
        for t in texts:
            if re.search(p, t):
                assert holds(condition, fold_text(t)), (p, t, condition)
    assert useful > 150
    assert required("(foo|bar)baz") == ("or", "barbaz", "foobaz") and required("lic[ae]nse") == ("or", "licanse", "license")
    for p in ("ab", "[a-z]+", "(?i)needle", "needle|x", r"\p{L}abc", "[[:alpha:]]abc", "a*"):
        assert required(p) is None


# ------------------------------------------------------------------ commits

def test_commit_looks_up_paths_only_where_they_may_be(spark, tmp_path):
    store = ST.IndexStore(spark, str(tmp_path / "s"), auto_merge=False)
    store.commit(index_of(spark, 400))
    store.commit_delta(spark.createDataFrame([(f"/other/{i}.png", 1, f"more {i}") for i in range(50)], NEW))
    touched = spark.createDataFrame([("/other/3.png",), ("/nowhere",)], "path string")
    found = store.locate(touched)
    plan = plan_of(found)
    assert "content" not in plan and "path:string" in plan
    # the first segment cannot hold these paths, and is not opened
    shutil.rmtree(tmp_path / "s" / "segments" / store.log()[0].segment / "paths")
    assert [r.path for r in found.collect()] == ["/other/3.png"]
    assert store._may_hold(touched, store.state().live).keys() == {2}


def test_of_results_with_one_path_the_newest_counts(spark, tmp_path):
    store = ST.IndexStore(spark, str(tmp_path / "s"))
    twice = [("/a", 1, "old"), ("/a", 3, "b"), ("/a", 3, "c"), ("/b", None, "x"), ("/b", None, "x")]
    store.commit_delta(spark.createDataFrame(twice, NEW))
    first = {r.path: r.content for r in store.current().collect()}
    other = ST.IndexStore(spark, str(tmp_path / "t"))
    other.commit_delta(spark.createDataFrame(twice[::-1], NEW))
    assert first == {r.path: r.content for r in other.current().collect()} and first["/a"] in "bc" and len(first) == 2


def test_merging_keeps_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "MERGE_RUN", 3)
    monkeypatch.setattr(ST, "STATE_EVERY", 2)
    store = ST.IndexStore(spark, str(tmp_path / "s"), block_rows=8)
    store.commit(index_of(spark, 30))
    model = {f"/r/{i}.png": f"text {i} needle" for i in range(1, 31)}
    for k in range(4):
        store.commit_delta(spark.createDataFrame([(f"/r/{k + 1}.png", 100 + k, f"changed {k}"), (f"/n/{k}.png", 1, f"new {k}")], NEW),
                           spark.createDataFrame([(f"/r/{20 + k}.png",), (f"/n/{k - 2}.png",)], "path string"))
        model[f"/r/{k + 1}.png"], model[f"/n/{k}.png"] = f"changed {k}", f"new {k}"
        for p in (f"/r/{20 + k}.png", f"/n/{k - 2}.png"):
            model.pop(p, None)
    log = store.log()
    assert any(c.upto - c.first > 0 and not c.compacted for c in log) and len(store.state().live) < 5
    rows = store.current()
    assert {r.path: r.content for r in rows.collect()} == model and store.corpus_size()[0] == len(model)
    assert {tuple(r) for r in store.postings().collect()} == {tuple(r) for r in G.postings(rows).collect()}
    # an older version is still there, also after files that no recent version names went
    assert {r.path for r in store.current(1).collect()} == {f"/r/{i}.png" for i in range(1, 31)}
    assert store.vacuum(keep_versions=len(log)) == []
    removed = store.vacuum(keep_versions=1, older_than=-1)
    named = {c.segment for c in store.state().live}
    assert removed and not set(removed) & named
    assert {r.path: r.content for r in store.current().collect()} == model


def synthetic(version, written=1):
    return ST.Commit(version, ST.LAYOUT_VERSION, f"s{version}", False, version, version, version, written, 0, version, version)


def test_many_commits_leave_few_segments_and_few_log_reads(spark, tmp_path, monkeypatch):
    state, version, most = ST.State(ST.NOTHING, ()), 0, 0
    rng = random.Random(1)
    for _ in range(1000):
        version += 1
        state = state.after(synthetic(version, rng.choice([1, 1, 1, 900])))
        while run := ST.due_for_merge(state.live):
            version += 1
            whole = ST.Commit(version, 2, f"m{version}", False, 0, 0, 0, sum(c.written for c in run), 0, run[0].first, run[-1].upto)
            state = state.after(whole)
            assert [c.first for c in state.live] == sorted(c.first for c in state.live)
        most = max(most, len(state.live))
    assert most <= 8 * 7 and state.live[0].first == 1
    store = ST.IndexStore(spark, str(tmp_path / "s"))
    now = ST.State(ST.NOTHING, ())
    for v in range(1, 101):
        now = store._done(now, synthetic(v))
    reads = []
    real = ST.IndexStore._read_json
    monkeypatch.setattr(ST.IndexStore, "_read_json", lambda self, n: reads.append(n) or real(self, n))
    assert store.state() == now and len(reads) <= 1 + ST.STATE_EVERY
    assert store.state(37).last.version == 37
    with pytest.raises(ST.LayoutError):
        store.state(101)


# ------------------------------------------------------------------ top-k by bounds

def test_top_k_leaves_out_blocks_that_cannot_reach_it(spark, tmp_path):
    store = ST.IndexStore(spark, str(tmp_path / "s"), block_rows=10)
    index = index_of(spark, 100, lambda i: "needle " * (5 if i in (33, 35, 78) else 1) + "hay " * 3)
    store.commit(index)
    full = [tuple(r) for r in S.search(index, "needle", limit=None, with_snippet=False).collect()]
    for k in (0, 1, 3, 20, 100, 500):
        got = [tuple(r) for r in search_index(store, "needle", limit=k, with_snippet=False).collect()]
        assert [g[:2] for g in got] == [f[:2] for f in full[:k]]
        assert [g[2] for g in got] == pytest.approx([f[2] for f in full[:k]])
    # a scope that the best hits are not in is reached by further waves
    scoped = [tuple(r) for r in search_index(store, "needle", root="/r/64.png", limit=2, with_snippet=False).collect()]
    assert [g[0] for g in scoped] == ["/r/64.png"]
    width, rows = store.log()[0].width, tmp_path / "s" / "segments" / store.log()[0].segment / "rows"
    for b in rows.glob("block=*"):
        if int(b.name[6:]) not in {i // width for i in (33, 35, 78)}:
            shutil.rmtree(b)
    top = search_index(store, "needle", limit=3, with_snippet=False).collect()
    assert [r.path for r in top] == [f[0] for f in full[:3]]


def test_segments_without_lengths_are_ranked_from_their_rows(spark, tmp_path, monkeypatch):
    store = ST.IndexStore(spark, str(tmp_path / "s"), block_rows=10)
    index = index_of(spark, 30, lambda i: "needle " * (i % 4) + "hay " * (i % 7))
    store.commit(index)
    want = [tuple(r) for r in search_index(store, "needle", limit=5, with_snippet=False).collect()]
    monkeypatch.setattr(ST.IndexStore, "has_lengths", lambda self, version=None: False)
    assert [tuple(r) for r in search_index(store, "needle", limit=5, with_snippet=False).collect()] == want


def test_lookups_open_partitions_by_name(spark, tmp_path, monkeypatch):
    store = ST.IndexStore(spark, str(tmp_path / "s"), block_rows=2)
    rows = [(f"/p/{i}.png", 1, f"common words {i:04d}") for i in range(7)]
    store.commit_delta(spark.createDataFrame(rows, "path string, modtime long, content string"))
    # the second segment has rows in the blocks of replaced and of new ids only
    store.commit_delta(spark.createDataFrame([("/p/2.png", 2, "changed words"), ("/p/7.png", 2, "more words")], "path string, modtime long, content string"))
    ids = {r.path: r.id for r in store.current().collect()}
    asked = spark.createDataFrame([(ids["/p/2.png"],), (ids["/p/5.png"],)], "id long")

    def go():
        got = store.rows_of(asked, ["path", "modtime", "content"])
        return sorted(map(tuple, got.collect())), got.inputFiles()

    found, files = go()
    assert found == [("/p/2.png", 2, "changed words"), ("/p/5.png", 1, "common words 0005")]
    opened = {c.segment: {int(f.split("block=")[1].split("/")[0]) for f in files if f"/{c.segment}/rows/" in f} for c in store.state().live}
    first, second = store.state().live
    wanted = [ids["/p/2.png"], ids["/p/5.png"]]
    assert opened[first.segment] == {i // first.width for i in wanted} and len(opened[first.segment]) == 2
    assert opened[second.segment] <= {i // second.width for i in wanted}
    lists = store.positions(None, ["changed"])
    assert sorted({r.gram for r in lists.collect()}) == sorted(["cha", "han", "ang", "nge", "ged"])
    assert store.positions(None, ["zzzz"]).count() == 0
    monkeypatch.setattr(ST, "FOLDERS", 0)  # more partitions than that: the table's folders are listed
    assert go()[0] == found and store.positions(None, ["changed"]).count() == lists.count()
    assert store.rows_of(asked.where("id < 0"), ["path"]).count() == 0
