"""Link loops, engines that hang or die, and regex forms of the reference dialect."""

import os
import time

import pytest
from pyspark.sql import functions as F

from scanlens.functions.globs import PatternError, regex_for_java
from scanlens.operators import recognise as R
from scanlens.sources import listing as LS


def test_link_loops_end_and_sibling_links_are_followed(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "c").mkdir()
    (tmp_path / "a" / "b" / "one.png").write_bytes(b"1")
    (tmp_path / "c" / "two.png").write_bytes(b"2")
    os.symlink(tmp_path / "a", tmp_path / "a" / "b" / "up")
    os.symlink(tmp_path / "c", tmp_path / "a" / "side")
    os.symlink(tmp_path / "a", tmp_path / "c" / "back")
    files = sorted(r.path[len(str(tmp_path)):] for r in LS.list_files(spark, str(tmp_path)).collect())
    assert files == ["/a/b/one.png", "/a/side/two.png", "/c/back/b/one.png", "/c/two.png"]
    errors = {r.path[len(str(tmp_path)):] for r in LS.walk(spark, str(tmp_path)).where("error is not null").collect()}
    assert errors == {"/a/b/up", "/a/side/back", "/c/back/b/up", "/c/back/side"}


def test_an_engine_that_hangs_or_dies_costs_one_file(spark, tmp_path):
    def fragile(options):  # local, so it is shipped to the workers by value
        def engine(data):
            if data == b"hang":
                time.sleep(600)
            if data == b"die":
                os.abort()
            if data == b"bad":
                raise ValueError("damaged")
            return data.decode() + "!"
        return engine

    for n, data in enumerate([b"one", b"hang", b"two", b"die", b"bad", b"three"]):
        (tmp_path / f"{n}.png").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / f"{n}.png"), 1) for n in [*range(6), 9]], "path string, modtime long").coalesce(1)
    begun = time.time()
    got = {r.path[-5]: (r.content, r.error) for r in R.recognise_files(files, fragile, seconds=3.0).collect()}
    assert time.time() - begun < 60
    assert [got[k][0] for k in "025"] == ["one!", "two!", "three!"]
    assert got["1"][1].startswith("TimeoutError") and got["3"][1].startswith("EngineDied") and got["4"][1] == "ValueError: damaged"
    assert got["9"][1].startswith("OSError")

    def unbuildable(options):
        raise RuntimeError("no data files")

    with pytest.raises(Exception, match="no data files"):
        R.recognise_files(files, unbuildable, seconds=3.0).collect()


@pytest.mark.parametrize("pattern,matching,other", [
    ("xa**y", ["xy", "xaaay"], ["xb"]), ("x(?:ab)+*y", ["xy", "xababy"], ["xaby_"[:3]]), ("^a{2}{2}$", ["aaaa"], ["aaa", "aaaaa"]),
    ("(?x) a b # a ( comment\n c", ["abc"], ["a b c"]), ("(?x)[a b]\\ c", ["a c", "b c"], ["  c"]), ("(?x: a )b c", ["ab c"], ["abc"]),
    ("a}", ["a}"], ["a"]), ("]", ["]"], ["["]), ("^*a", ["a", "ba"], ["b"]), ("a*?b", ["b", "aab"], ["a"])])
def test_regex_forms(spark, pattern, matching, other):
    df = spark.createDataFrame([(t,) for t in matching + other], "t string")
    got = {r.t for r in df.where(F.col("t").rlike(regex_for_java(pattern))).collect()}
    assert got == set(matching)


@pytest.mark.parametrize("pattern", ["a{,3}", "*a", "a|*", "(*a)", "a{", "a{x}", "(?x) ( # )", "a(", "a)", "(?=a)"])
def test_regex_forms_that_are_refused_on_the_driver(pattern):
    with pytest.raises(PatternError):
        regex_for_java(pattern)
