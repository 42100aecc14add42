"""Text operators against brute force on small fixtures: near duplicates, language, lines, mixing."""

import collections
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanlens.llm import common, language_id, line_dedup, minhash_dedup, quality, source_mix
from scanlens.llm import queries as Q
from scanlens.llm.components import components
from scanlens.llm.subword import SubwordOptions, crc_mod

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()),
                                                     ("source", T.StringType()), ("n_chars", T.LongType()))])


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang, source]) as documents."""
    full = [(r + (None, None))[:4] for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOC)


def prose(n, seed=1, vocabulary=400):
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{x % vocabulary}")
    return " ".join(out)


def shingles(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[n + 1:]:
            inter = len(s & t)
            if s and t and 100 * inter >= percent * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def near_copies():
    """A base text, copies of it, and texts with more and more words changed, some on both sides of
    the threshold only through a third text."""
    rows = []
    for base in range(4):
        words = prose(120, seed=base + 1).split()
        rows.append((base * 100, " ".join(words)))
        rows.append((base * 100 + 1, " ".join(words).upper()))
        for n in range(2, 14):
            w = list(words)
            for c in range(n // 2):
                w[(c * 37 + n * 11) % 120] = f"changed{n}x{c}"
            rows.append((base * 100 + n, "  ".join(w)))
    return rows


@pytest.mark.parametrize("k,percent,chunk", [(3, 85, 512), (3, 85, 4), (5, 80, 512)])
def test_near_duplicates_equal_brute_force(spark, k, percent, chunk):
    rows = near_copies() + [(900, "one two"), (901, "ONE\ttwo"), (902, ""), (903, None), (904, " \n"), (905, "x " * 3000)]
    opt = minhash_dedup.MinHashOptions(shingle_words=k, percent=percent, chunk=chunk, chunk_shingles=1 << (16 if chunk > 4 else 8))
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs_of(spark, rows), opt).collect()}
    want = brute_components(rows, k, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t, k)) for i, t in rows}
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    assert len(set(want.values())) < len(want)


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A b c D"), (8, None), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in
                  minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 1, None, True), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 0, 8, True),
                          (None, 0, None, True)], key=repr)
    # one doc_id with two texts links both classes
    got = {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(docs_of(
        spark, [(1, prose(50, 1)), (2, prose(50, 1)), (2, prose(50, 2)), (3, prose(50, 2))])).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_sketch_estimates_high_similarity():
    import numpy as np

    xors, muls = minhash_dedup._sample_constants(160)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for share in (0.99, 0.95, 0.9, 0.85):
        common = int(2000 * 2 * share / (1 + share))
        b = np.r_[a[:common], rng.integers(0, 1 << 63, 2000 - common, dtype=np.uint64)]
        sig = np.stack([minhash_dedup.signature(x, xors, muls) for x in (a, b)])
        sk = minhash_dedup.odd_sketches(sig, 1024)
        flips = np.bitwise_count(sk[0] ^ sk[1]).sum()
        assert abs(minhash_dedup.sketch_similarity(flips, 160, 1024) - share) < 0.12


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 200), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 300: 200, 200: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ------------------------------------------------------------------ classifiers

def test_language_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q.op2_language(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_language_edge_rows(spark):
    rows = [(i, "the cat and the dog " * 5, "en", "s") for i in range(20)] + [(100 + i, "der hund und die katze " * 5, "de", "s") for i in range(20)]
    model = language_id.train(docs_of(spark, rows), F.lit(True))
    probe = docs_of(spark, [(1, None), (2, ""), (3, "123 !? 45"), (None, "und die katze"), (5, "the dog"), (5, "the dog"), (6, "the dog " * 50_000)])
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language_id.predict(probe.withColumn("score", F.lit("x")), model, ["doc_id"]).collect()]
    assert collections.Counter(got) == collections.Counter([(1, "und", True), (2, "und", True), (3, "und", True), (None, "de", False),
                                                            (5, "en", False), (5, "en", False), (6, "en", False)])
    empty = language_id.train(docs_of(spark, []), F.lit(True))
    assert [r.lang_pred for r in language_id.predict(probe, empty, ["doc_id"]).collect()] == ["und"] * 7
    assert language_id.predict(docs_of(spark, []), model, ["doc_id"]).count() == 0


def test_unlearnt_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, F.col("lang").isin("de", "en"))
    rows = language_id.predict(docs, model, ["doc_id", "lang"]).where("lang_pred <> 'und'").collect()
    right = [r.rejected for r in rows if r.lang == r.lang_pred]
    wrong = [r.rejected for r in rows if r.lang not in ("de", "en")]
    assert model.labels == ["de", "en"] and len(right) > 500 and len(wrong) > 200
    assert sum(right) <= 0.01 * len(right) and sum(wrong) >= 0.9 * len(wrong)


def test_rejection_threshold_is_the_quantile_of_right_scores():
    import numpy as np

    from scanlens.llm.subword import rejection_threshold

    opt, rng = SubwordOptions(), np.random.default_rng(3)
    for n, most in ((20, 0.02), (99, 0.005), (100, 0.005), (400, 0.003), (4000, 0.003)):
        lost = []
        for _ in range(100):
            odds = rng.logistic(12, 1, n)
            t = rejection_threshold(np.stack([odds, 0 * odds], 1), odds > 0, opt)
            lost.append(1 / (1 + np.exp(12 - np.log(t / (1 - t)))))
        assert 0.00005 < np.mean(lost) < most, (n, np.mean(lost))
    z = np.stack([np.full(20, 9.0), np.zeros(20)], 1)
    assert rejection_threshold(z, np.arange(20) < 1, opt) == 0.0  # one score says nothing about spread
    assert rejection_threshold(z[:, :1], np.ones(20, bool), opt) == rejection_threshold(z, np.zeros(20, bool), opt) == 0.0


def test_training_sample_is_bounded_and_repeatable(spark):
    from scanlens.llm.subword import fit, labelled_sample

    docs = docs_of(spark, [(i, prose(30, i), "ab"[i % 2], "s") for i in range(60)])
    opt = SubwordOptions(sample=20, epochs=1)
    labels = docs.select("doc_id", F.col("lang").alias("label"))
    a, b = labelled_sample(docs, labels, opt), labelled_sample(docs.repartition(7), labels, opt)
    assert a.equals(b) and len(a) == 20 and set(a.column("label").to_pylist()) == {"a", "b"}
    assert (fit(a, opt).table == fit(b, opt).table).all()


def test_one_text_of_a_repeated_id_reaches_the_driver(spark):
    from scanlens.llm.subword import labelled_sample

    rows = [(7, prose(20, i % 50), "a", "s") for i in range(600)] + [(100 + i, prose(20, i), "ab"[i % 2], "s") for i in range(20)]
    docs = docs_of(spark, rows).repartition(5)
    labels = docs.select("doc_id", F.col("lang").alias("label"))
    opt = SubwordOptions(sample=400)
    got = labelled_sample(docs, labels, opt)
    assert len(got) == len(set(got.column("h").to_pylist())) == 21
    least = docs.where("doc_id = 7").orderBy(F.xxhash64("text")).limit(1)
    own = labelled_sample(least, labels.where("doc_id = 7").distinct(), opt).to_pylist()
    assert len(own) == 1 and own[0] in got.to_pylist()


def test_quality_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = Q.op9_quality(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def plain_scores(model, text, fold, repeats):
    """Label probabilities of one text by the rule: one dictionary look-up per word and byte n-gram, in plain integers."""
    m64, seen = (1 << 64) - 1, {}

    def mixed(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m64
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m64
        return x ^ x >> 32

    def poly(b):
        return sum((byte + 1) * pow(common._BASE, k, 1 << 64) for k, byte in enumerate(b)) & m64

    def gram_bucket(g):
        if g not in seen:
            h = poly(g)
            h = (h ^ h >> 29) * (0xD6E8FEB86659FD93 + 2 * len(g)) & m64
            seen[g] = (h >> 33) % model.options.buckets
        return seen[g]

    data = (text or "").translate(LOWER if fold else {}).encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    found = [mixed(mixed((poly(w) + len(w) * int(common._ODD)) & m64) + 1 & m64) % model.options.buckets for w in words]
    if repeats:
        found += [mixed(int(k > 0 and words[k] == words[k - 1]) + 0x5EED) % model.options.buckets for k in range(len(words))]
    for n in model.options.grams:
        found += [gram_bucket(data[k:k + n]) for k in range(len(data) - n + 1)]
    z = [sum(float(row[b]) for b in found) / max(1, len(found)) + float(bias) for row, bias in zip(model.table, model.bias)]
    e = [math.exp((v - max(z)) / model.temperature) for v in z]
    return [v / sum(e) for v in e]


def test_predictions_equal_a_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = ["", None, " ", "a", "ab", "Ab AB ab ab", "\u00df\u20ac\U0001f600 x", "x" * 3000, "the the the " * 50]
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text is not None and len(r.text) < 4000][:60] + odd
    probe = docs_of(spark, list(enumerate(texts)))
    lang = language_id.train(docs, crc_mod(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r for r in language_id.predict(probe, lang, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        p = plain_scores(lang, t, True, False)
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        assert got[i].score == pytest.approx(max(p), abs=1e-6)
        if sorted(p)[-1] - sorted(p)[-2] > 1e-6:
            assert got[i].lang_pred == lang.labels[p.index(max(p))]
    good = quality.train(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    for r in quality.score(probe, good, ["doc_id"]).collect():
        want = plain_scores(good, texts[r.doc_id], False, True)[good.labels.index("1")]
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.3)


def test_quality_edge_rows(spark):
    docs = docs_of(spark, [(i, ("good plain words here " if i % 2 else "BAD!! WORDS!! ") * 6) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    probe = docs_of(spark, [(1, None), (2, ""), (None, "BAD!! WORDS!!"), (4, "good plain words"), (4, "good plain words")])
    got = quality.score(probe, model, ["doc_id"]).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[None] == 0 and by[4] == 1
    none = quality.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(probe, none, ["doc_id"]).collect()} == {0.5}


def test_crc_mod_is_that_of_the_decimal_text(spark):
    got = spark.range(50).select("id", crc_mod(F.col("id"), 3).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 3 for r in got)


# ------------------------------------------------------------------ lines

def brute_lines(rows, min_chars):
    """{(doc_id): kept text}: delete every line covered by a run that also starts earlier, straight
    from the definition (all runs of all lengths)."""
    seqs = []
    for d, t in rows:
        ls = t.split("\n")
        seqs.append((d, ls, [i for i, x in enumerate(ls) if WORDS.search(x)]))
    first, gone = {}, collections.defaultdict(set)
    runs = [(d, a, tuple(ls[i] for i in vis[a:b]), vis[a:b]) for d, ls, vis in sorted(seqs) for a in range(len(vis)) for b in range(a + 1, len(vis) + 1)]
    for d, a, run, at in runs:
        if sum(map(len, run)) < min_chars:
            continue
        if run in first and first[run] != (d, a):
            gone[d].update(at)
        first.setdefault(run, (d, a))
    return {d: "\n".join(x for i, x in enumerate(ls) if i not in gone[d]) for d, ls, _ in seqs}


def line_rows():
    import random

    rnd = random.Random(5)
    pool = ["a", "bb", "ccc", "dddd dddd", "a longer line of some twenty and more characters", "ee ee", "", "  ", "f"]
    rows = [(d, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 14)))) for d in range(40)]
    return rows + [(50, "a\nbb\nccc\na\nbb\nccc\na\nbb\nccc"), (51, "f\n" * 30)]


@pytest.mark.parametrize("min_chars", [1, 6, 20, 33])
def test_line_runs_equal_brute_force(spark, min_chars):
    rows = line_rows()
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_of(spark, rows), min_chars).collect()}
    assert got == brute_lines(rows, min_chars)


def test_line_runs_equal_the_oracle(spark):
    rows = line_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*rows, (60, None), (61, "")])
    got = line_dedup.dedup_lines(docs_of(spark, [*rows, (60, None), (61, "")])).select("doc_id", "lines_total", "lines_removed", "text").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(line_dedup.ORACLE_SQL).fetchall())


def test_short_lines_stay_under_the_minimum_and_go_without_it(spark):
    rows = [(d, f"a long line that stands only here, number {d}\nAnd so.") for d in range(30)]
    left = {m: sum("And so." in r.text for r in line_dedup.dedup_lines(docs_of(spark, rows), m).collect()) for m in (line_dedup.MIN_CHARS, 1)}
    assert left == {20: 30, 1: 1}  # README: what the minimum leaves


def test_line_runs_edge_rows(spark):
    line = "the same line with more than twenty characters"
    docs = docs_of(spark, [(None, line), (1, line), (1, line), (2, None), (3, ""), (4, f"x\n{line}\n\ny")])
    got = [(r.doc_id, r.text, r.lines_removed) for r in line_dedup.dedup_lines(docs).collect()]
    assert collections.Counter(got) == collections.Counter([
        (None, line, 0), (1, "", 1), (1, "", 1), (2, None, 0), (3, "", 0), (4, "x\n\ny", 1)])
    clash = docs.withColumn("lines_total", F.lit("x")).withColumn("th", F.lit(1)).withColumn("doc", F.lit(2))
    assert line_dedup.dedup_lines(clash).count() == 6
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_line_runs_are_native(spark, capsys):
    line_dedup.dedup_lines(docs_of(spark, [(1, "a"), (2, "a")])).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ mixing

def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    whole, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (whole - sum(2 * sizes[s] for s in capped)) / (sum(w[s] for s in free) or 1)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= over


def test_mix_meets_its_targets(spark):
    rows = [(i, prose(20 + i % 90, i), None, f"s{i % 7}" if i % 5 else "s0") for i in range(400)]
    rows += [(1000 + i, prose(30, i), None, None) for i in range(20)] + [(2000, None, None, "s1"), (2001, "", None, "zz"), (None, "a b", None, "s2")]
    docs = docs_of(spark, rows)
    got = source_mix.mixed(docs, source_mix.MixOptions(block=16)).collect()
    again = source_mix.mixed(docs.repartition(5), source_mix.MixOptions(block=16)).collect()
    assert collections.Counter(got) == collections.Counter(again)
    size = {r[0]: len(WORDS.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size[r[0]]
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_schedule_follows_the_weights_at_every_length(spark):
    rows = [(i, prose(100, i), None, "abc"[i % 3]) for i in range(300)]
    laid, sources = source_mix.placed(docs_of(spark, rows), source_mix.MixOptions(block=16))
    slots = source_mix.schedule(sources, source_mix.MixOptions(block=16)).orderBy("slot").collect()
    quota = {r.idx: r.quota for r in sources.collect()}
    assert collections.Counter(r.idx for r in slots) == quota
    total, seen = sum(quota.values()), collections.Counter()
    for n, r in enumerate(slots, 1):
        assert r.rank == seen[r.idx]  # ranks run in slot order
        seen[r.idx] += 1
        assert all(abs(seen[i] - n * q / total) < 4 for i, q in quota.items())


def test_mix_of_nothing(spark):
    assert source_mix.mixed(docs_of(spark, [])).count() == 0
    assert [(r.size, r.target, r.taken) for r in source_mix.mixed(docs_of(spark, [(1, None, None, "a")])).collect()] == [(0, 0.0, 0)]
