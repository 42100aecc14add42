"""Divergence audit, decontamination and Merkle manifest against brute force on small literal tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanlens.llm import benchmark_clean as B
from scanlens.llm import merkle_manifest as M
from scanlens.llm import source_audit as A
from scanlens.llm import terms as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, item string, spans int, i int"


def corpus(n=260, seed=4):
    """Rows with a hot source, nulls in every column, copies, empty and long texts, and odd extra columns."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4))) for _ in range(90)]
    out = []
    for k in range(n):
        text = " ".join(rng.choice(words[:rng.choice([5, 30, 90])]) for _ in range(rng.choice([0, 1, 3, 20, 60])))
        if k % 7 == 0:
            text = text.upper() + "\n1x2\n"
        if k % 41 == 0:
            text = "".join(words) * 30 + " " + text * 20
        out.append((None if k % 53 == 0 else k // 2 * 2 if k % 31 == 0 else k, None if k % 29 == 0 else text,
                    None if k % 37 == 0 else rng.choice(["de", "de", "de", "en", ""]),
                    None if k % 23 == 0 else rng.choice(["s0", "s0", "s0", "s1", "sé", "s\U0001F600", "s3", "s4"]),
                    None if k % 19 == 0 else len(text), "keep", "x", k, -1))
    return out + [out[3]] * 3 + [out[7]]


def test_byte_words_equal_the_patterns():
    texts = ["Ab c1é", None, "", "ÀB-c", "x", "12 ab34", " \x00\x7f", "日本 go", "Z"] * 3
    for table, pattern in ((T.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (T.LETTERS_DIGITS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for cut in (0, 4):
            arr = pa.array(texts).slice(cut)
            words, offs = T.byte_words(arr, table)
            lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts[cut:]]
            want = [re.findall(pattern, t) for t in lower]
            assert [words.to_pylist()[a:b] for a, b in zip(offs, offs[1:])] == want


# ------------------------------------------------------------------ divergence

def brute_divergence(rows, top=200):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= 3]
        count = collections.Counter((d[1], t) for d in mine for t in d[2])
        sources = sorted({d[1] for d in mine})

        def shares(counts):
            total = sum(counts.values()) + len(kept)
            return {t: 1 + 1000000000 * (counts[t] + 1) // total for t in kept}

        p = {s: shares({t: count[s, t] for t in kept}) for s in sources}
        q = shares({t: sum(count[s, t] for s in sources) for t in kept})

        def f(a, b):
            return (a - b) * (a - b) // b

        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s, t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


@pytest.mark.parametrize("opt", [A.AuditOptions(), A.AuditOptions(digest_bits=5, source_block=2, chunk_bytes=600, held_rows=40, top_terms=7)])
def test_divergence_equals_brute_force(spark, opt):
    rows = corpus()
    got = A.divergence(spark.createDataFrame(rows, DOCS), opt)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_divergence(rows, opt.top_terms)


def test_divergence_of_nothing(spark):
    assert A.divergence(spark.createDataFrame([], DOCS)).collect() == []
    bare = [(1, None, "x", "a", 0, "", "", 0, 0), (2, "", "x", "b", 0, "", "", 0, 0), (3, "one two", "x", "b", 7, "", "", 0, 0)]
    assert {tuple(r) for r in A.divergence(spark.createDataFrame(bare, DOCS)).collect()} == {("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)}


# ------------------------------------------------------------------ decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def passages_table():
    rng = random.Random(9)
    vocabulary = ["w%d" % k for k in range(40)] + ["é", "日本"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 25, 60])))) for k in range(25)]
    items += [(100, "only three words"), (101, "Solo9"), (102, None), (103, "... !"), (None, items[0][1]), (104, items[1][1]), (2, items[3][1])]
    docs = []
    for k in range(160):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 40, 90]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            source = words_of(rng.choice(items[:25])[1])
            a = rng.randint(0, len(source) - 5)
            at = rng.randint(0, len(text))
            text[at:at] = source[a:a + rng.choice([8, 9, 10, 11, 14, 60])]
        if k % 20 == 0:
            text += ["ONLY", "three", "words"] * 2
        if k % 33 == 0:
            text += ["solo9"]
        docs.append((k if k % 50 else None, None if k % 47 == 0 else (", " if k % 2 else " ").join(text), "en", "s", 1, "keep", "x", k, -1))
    return docs + [docs[1], docs[1]], items


def brute_passages(docs, items, window=10):
    out = []
    for d in docs:
        w, hit, ids = words_of(d[1]), set(), set()
        for item, text in items:
            x = words_of(text)
            m = min(len(x), window)
            wins = {tuple(x[j:j + m]) for j in range(len(x) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i:i + m]) in wins:
                    hit |= set(range(i, i + m))
                    ids.add("" if item is None else str(item))
        out.append((d[0], d[7], len(w), sorted(hit), sorted(ids)))
    return sorted(out, key=lambda r: (r[1], str(r[0])))


@pytest.mark.parametrize("opt", [B.CleanOptions(), B.CleanOptions(shard_bytes=300, block_bytes=500, held_bytes=0)])
def test_passages_equal_brute_force(spark, opt):
    docs, items = passages_table()
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.i2, r.n_words, [k for s in r.spans for k in range(s["first"], s["last"])], r["items"])
           for r in B.passages(table.drop("spans", "items", "item").withColumn("i2", F.col("i") * 0 + F.coalesce("doc_id", F.lit(0))), bench, ["doc_id", "i2"], opt).collect()]
    want = brute_passages([(d[0], d[1], *d[2:7], d[0] or 0) for d in docs], items)
    assert sorted(got, key=lambda r: (r[1], str(r[0]))) == want or sorted(map(repr, got)) == sorted(map(repr, want))


def test_decontaminated_keeps_clean_rows_whatever_the_columns_are_called(spark):
    docs, items = passages_table()
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    table = table.withColumn("n_words", F.lit("mine")).withColumn("longest", F.lit(3)).withColumn("items", F.lit(True)).withColumn("c1", F.lit(0))
    clean = B.decontaminated(table, bench)
    assert clean.columns == table.columns
    want = sorted(r[1] for r in brute_passages(docs, items) if not r[3])
    got = clean.collect()
    assert sorted(r["spans"] for r in got) == want and {r["n_words"] for r in got} == {"mine"}


def test_longest_matches_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, " ".join("abcdefghijklmnop")), (2, "never seen here at all")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "x y " + " ".join("cdefghijklmno") + " z"), (8, " ".join("abcdefghijk"))], "doc_id long, text string")
    assert [tuple(r) for r in B.longest_matches(docs, bench).collect()] == [("1", 13, 2, 7, 2)]
    none = bench.where("false")
    assert {r.n_words for r in B.passages(docs, none, ["doc_id"]).where("size(spans) = 0").collect()} == {16, 11}
    assert B.passages(docs.where("false"), bench, ["doc_id"]).collect() == []


def test_suffix_order_is_the_suffix_array():
    rng = np.random.default_rng(1)
    for codes in (rng.integers(0, 3, 200), np.ones(70, np.int64), np.arange(5), np.zeros(1, np.int64), np.tile([1, 2, 0], 30)):
        order = B.suffix_order(codes.astype(np.int64), 1 << 20)
        assert [tuple(codes[i:]) for i in order] == sorted(tuple(codes[i:]) for i in range(len(codes)))


# ------------------------------------------------------------------ manifest

def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    fields = [r[0], r[3], r[2], r[4], text]
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def climb(nodes):
    """(root, per leaf: siblings with position, from the leaf up)"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            run = nodes[at[k] // 3 * 3:at[k] // 3 * 3 + 3]
            j = at[k] % 3
            paths[k].append((j, run[:j] + run[j + 1:]))
        nodes, at = [h(nodes[i:i + 3]) for i in range(0, len(nodes), 3)], [a // 3 for a in at]
    return nodes[0], paths


def brute_manifest(rows):
    def changed(r):
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        return r[1].replace("\n", "") if even and r[1] is not None else r[1]

    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, brute_leaf(r, r[1]), brute_leaf(r, changed(r))))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(by_source[s])]) for s in order]
    root, tops = climb([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(order, trees, tops):
        for x, path in zip(sorted(by_source[s]), paths):
            cur = x[3]
            for j, siblings in path + top:
                cur = h(siblings[:j] + [cur] + siblings[j:])
            out.append((x[1] if x[0] else None, x[2], subroot, root, h([y for _, ys in path + top for y in ys]), cur, cur == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [7, 2, 1])
def test_manifest_equals_brute_force(spark, levels):
    rows = corpus(200) + [(5000 + k, f"line\n{k}", "de", "alone" if k == 0 else "s0", k, "", "", 0, 0) for k in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    check = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    got = M.manifest(docs, check, M.ManifestOptions(block_levels=levels))
    got = got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = brute_manifest(rows)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {w[6] for w in want} == {True, False}


def test_manifest_of_nothing_and_of_one_row(spark):
    empty = spark.createDataFrame([], DOCS)
    assert M.manifest(empty).collect() == []
    one = [(1, "a", None, None, None, "", "", 0, 0)]
    got = M.manifest(spark.createDataFrame(one, DOCS)).collect()
    assert len(got) == 1 and got[0].leaf == got[0].subroot == got[0].root == brute_leaf(one[0], "a") and got[0].verified


def test_queue_delivers_by_label():
    q = M.TimeForwardQueue()
    for label, message in [((3, 1), "c"), ((1, 1), "a"), ((3, 1), "d"), ((3, 2), "e"), ((1, 1), "b")]:
        q.send(label, message)
    assert q.next_label() == (1, 1) and q.receive((1, 1)) == ["a", "b"] and q.receive((2, 1)) == []
    assert q.receive((3, 1)) == ["c", "d"] and q.receive((3, 2)) == ["e"] and q.next_label() is None
