"""Literal cases from the reference's tests and the rules in SURVEY §2.9."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanlens.functions import checks, paths, text
from scanlens.functions import predicates as P
from scanlens.functions.globs import (
    PatternError,
    content_glob_literals,
    content_glob_to_regex,
    path_glob_to_regex,
    regex_for_java,
)


def one(spark, col, value=None, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first().r


def test_blank_lines(spark):
    assert one(spark, text.collapse_blank_lines("x"), "a\n\n\n\nb") == "a\n\nb"


def test_blacklist(spark):
    s = "We hold these truths to be self-evident, that all men"
    assert one(spark, text.strip_chars("x", "aeiou"), s) == "W hld ths trths t b slf-vdnt, tht ll mn"


def test_whitelist(spark):
    assert one(spark, text.keep_only("x", "0-9"), "a1 b2\nc3") == "1 2\n3"


def test_escape_debug(spark):
    assert one(spark, text.escape_debug("x"), "a\tb\n\"c'\\\x01") == "a\\tb\\n\\\"c\\'\\\\\\u{1}"
    assert one(spark, text.escape_debug("x"), "\u00ad\u200b\ufeff\u2028\u00a0\0 é😀") == "\\u{ad}\\u{200b}\\u{feff}\\u{2028}\\u{a0}\\0 é😀"
    assert one(spark, text.escape_debug("x"), "\u0301a\u0301") == "\\u{301}a\u0301"  # a mark is escaped at the start only


def test_grams(spark):
    df = spark.createDataFrame([("a😀bcd",), ("ab",), ("",)], "x string")
    got = [r.g for r in df.select(text.gram_array("x").alias("g")).collect()]
    assert got == [["a😀b", "😀bc", "bcd"], [], []]


def test_buffer_check(spark):
    df = spark.createDataFrame([(4, 2, 2, 1, 2), (3, 2, 2, 1, 2), (4, 2, 2, 1, 1), (4, 16, 2, 0, 2), (4, 17, 2, 0, 2),
                                (4, 2, -2, 1, 2)], "n int, w int, h int, bpp int, bpl int")
    got = [r.s for r in df.select(checks.buffer_check("n", "w", "h", "bpp", "bpl").alias("s")).collect()]
    assert got == ["ok", "exceeds image size", "exceeds line", "ok", "exceeds line", "exceeds memory"]


def test_box_valid(spark):
    df = spark.createDataFrame([(3, 4), (3, -4), (0, 0)], "w int, h int")
    assert [r.v for r in df.select(checks.box_is_valid("w", "h").alias("v")).collect()] == [True, False, True]


def test_dpi(spark):
    df = spark.createDataFrame([(0,), (70,), (2400,), (2401,), (300,)], "d int")
    assert [r.v for r in df.select(checks.dpi_or_fallback("d", 70).alias("v")).collect()] == [70, 70, 2400, 70, 300]


def test_lang(spark):
    df = spark.createDataFrame([("eng",), ("ENG",), ("en",), ("e/g",), ("éng",), ("e.g",)], "c string")
    got = [(r.ok, r.n) for r in df.select(checks.lang_ok("c").alias("ok"), checks.lang_normalised("c").alias("n")).collect()]
    assert got == [(True, "eng"), (True, "eng"), (False, None), (False, None), (False, None), (False, None)]


def test_size_spec():
    assert checks.parse_size_spec("640x480") == (640, 480)
    for bad in ("640", "640x", "ax2", "1x2x3"):
        with pytest.raises(ValueError):
            checks.parse_size_spec(bad)


def test_substring_search(spark):
    rows = [("haystack haystack haystack",), ("haystack haystack needle",), ("haystack hayneedle haystack",)]
    df = spark.createDataFrame(rows, "content string")
    assert df.where(P.phrase("needle").predicate(text.fold("content"))).count() == 2
    assert df.where(P.phrase("NEEDLE").predicate(text.fold("content"))).count() == 2


def test_short_phrase(spark):
    df = spark.createDataFrame([("ab ab",)], "content string")
    assert df.where(P.phrase("ab").predicate(text.fold("content"))).count() == 0


def test_boolean_terms(spark):
    df = spark.createDataFrame([("one two",), ("one three",), ("four",)], "content string")
    f = text.fold("content")
    assert df.where(P.all_of("one", "two").predicate(f)).count() == 1
    assert df.where(P.any_of("two", "four").predicate(f)).count() == 2
    assert df.where(P.but_not("one", "two").predicate(f)).count() == 1
    assert df.where(P.starts_with("fou").predicate(f)).count() == 1


def _near_brute(t, a, b, n):
    pa = [i for i in range(len(t)) if t.startswith(a, i)]
    pb = [i for i in range(len(t)) if t.startswith(b, i)]
    return any(-(n + len(b) - 2) <= y - x <= n + len(a) - 2 for x in pa for y in pb)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc ", min_size=0, max_size=40), st.integers(0, 6))
def test_near_matches_brute_force(spark, t, n):
    a, b = "abc", "cab"
    got = spark.createDataFrame([(t,)], "content string").where(P.near(a, b, n).predicate(text.fold("content"))).count()
    assert got == int(_near_brute(t, a, b, n))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab", min_size=0, max_size=30))
def test_overlapping_hit_count(spark, t):
    got = one(spark, P.count_hits(F.col("x"), "aba"), t)
    assert got == sum(1 for i in range(len(t)) if t.startswith("aba", i))


def test_path_scope(spark):
    df = spark.createDataFrame([("/a/bc/x.png",), ("/a/b/x.png",), ("/a/b",)], "path string")
    assert df.where(paths.in_scope("path", "/a/b")).count() == 2
    assert df.where(paths.in_scope("path", "/a/b", prefix_like=True)).count() == 3


def test_like_escape():
    assert paths.like_escape("/x_y%z#") == "/x#_y#%z##%"


def test_exclude_prunes_subtree(spark):
    df = spark.createDataFrame([("/r/.cache/a.png",), ("/r/x/.thumbnails/b.png",), ("/r/x/c.png",), ("/r/skip/d/e.png",)],
                               "path string")
    keep = df.where(~paths.excluded("path", "/r", paths.exclude_patterns(["skip"]))).collect()
    assert [r.path for r in keep] == ["/r/x/c.png"]


def test_extension_case_sensitive(spark):
    df = spark.createDataFrame([("a.png",), ("a.JPG",), ("a.txt",), ("a.webp",), ("noext",)], "path string")
    assert [r.path for r in df.where(paths.has_allowed_extension("path")).collect()] == ["a.png", "a.webp"]


def py(rx):
    """Java's end anchor \\z is \\Z in Python's re."""
    return rx.replace("\\z", "\\Z")


def _glob_brute(p, s):
    """Naive whole-string content glob: * ? [set] [^set]."""
    def m(i, j):
        if i == len(p):
            return j == len(s)
        c = p[i]
        if c == "*":
            return any(m(i + 1, k) for k in range(j, len(s) + 1))
        if j == len(s):
            return False
        if c == "?":
            return m(i + 1, j + 1)
        if c == "[":
            k = p.index("]", i + 2 if p[i + 1:i + 2] in ("]", "^") else i + 1)
            body = p[i + 1:k]
            neg = body.startswith("^")
            body = body[1:] if neg else body
            ok = any(body[q] <= s[j] <= body[q + 2] if q + 2 < len(body) and body[q + 1] == "-" else s[j] == body[q]
                     for q in range(len(body)))
            return (ok != neg) and m(k + 1, j + 1)
        return c == s[j] and m(i + 1, j + 1)
    return m(0, 0)


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(["*a?c*", "a*", "*b", "[a-b]*c", "[^a]*", "a[*]b", "?", "*", "ab"]),
       st.text(alphabet="abc*", max_size=8))
def test_content_glob_matches_naive(p, s):
    assert bool(re.search(py(content_glob_to_regex(p)), s)) == _glob_brute(p, s)


def test_path_glob():
    def g(p):
        return py(path_glob_to_regex(p))
    assert re.search(g("*/.thumb*"), "/x/.thumbs") and not re.search(g("*/.thumb*"), "/x/thumbs")
    assert re.search(g("/a/**/b.png"), "/a/b.png")
    assert re.search(g("/a/**"), "/a/x/y")
    assert re.search(g("[!a]x"), "bx") and not re.search(g("[!a]x"), "ax")
    with pytest.raises(PatternError):
        path_glob_to_regex("a**b")


REGEX_CASES = [
    (r"end$", "end\n", False), (r"end$", "end", True), (r"x.y", "x\ry", True), (r"x.y", "x\ny", False), (r"(?m)foo$", "foo\nbar", True),
    (r"(?m)^bar", "foo\nbar", True), (r"^bar", "foo\nbar", False), (r"[[:alpha:]]+9", "abc9", True), (r"[[:^alpha:]]9", "a9", False),
    (r"(?P<x>foo)(?<y>b)", "foob", True), (r"\u{e9}", "é", True), (r"\x{1F600}", "😀", True), (r"C:\\1", "C:\\1", True), (r"[(?=]", "?", True),
    (r"\p{Greek}+", "α", True), (r"\w", "é", True), (r"[a-z&&[^aeiou]]", "e", False), (r"(?i:FOO)bar", "foobar", True), (r"[]a]", "]", True),
    (r"a{2,3}", "caab", True), (r"[$]", "$", True), (r"(?i)É", "é", True), (r"(a(?m)b$)c?$", "ab\n", False),
]


@pytest.mark.parametrize("pattern,value,hit", REGEX_CASES)
def test_regex_dialect(spark, pattern, value, hit):
    assert one(spark, F.col("x").rlike(regex_for_java(pattern)), value) is hit


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(a)\1", r"\k<x>", r"a\Qb\E", r"[[:foo:]]", "(a", "a)", "[a", "a\\",
                                     r"(?R)a", r"(?U)a", "a++", r"[a--b]", r"\u{110000}"])
def test_unsupported_regex_is_refused_on_the_driver(pattern):
    with pytest.raises(PatternError):
        regex_for_java(pattern)


def test_content_glob_literals():
    assert content_glob_literals("*one?two[a-z]three*") == ["one", "two", "three"]
    assert content_glob_literals("[*]x") == ["x"] and content_glob_literals("*?") == []


def test_fold_keeps_offsets(spark):
    for t in ("ΟΔΟΣ ΟΔΟΣΑ", "İİ x", "ǅ ẞ K Å", "😀Σ"):
        assert one(spark, F.length(text.fold("x")), t) == len(t)
        assert one(spark, text.fold("x"), t) == text.fold_text(t)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abA", min_size=0, max_size=30), st.sampled_from(["aba", "aaa", "abb", "a.b"]))
def test_hit_positions_match_brute_force(spark, t, p):
    got = one(spark, P.hit_positions(text.fold("x"), p), t)
    assert got == [i for i in range(len(t)) if t.lower().startswith(p, i)]


def test_quoting_survives_any_text(spark):
    for p in ("a\\Eb", "C:\\Export", "(x)[y]{z}^$.|?*+", "a-b&&c#d e", "éa\n"):
        assert one(spark, F.col("x").rlike(text.quote_regex(p)), f"1{p}2") is True
        assert one(spark, P.near(p, p, 0).predicate(text.fold("x")), f"{p} {p}") is True
