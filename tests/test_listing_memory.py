"""Walks that remember folders, huge folders dealt over tasks, names that are no UTF-8."""

import os
import time

from pyspark.sql import functions as F

from scanlens.plans.index_run import IndexOptions, index_folder
from scanlens.operators.store import IndexStore
from scanlens.sources import listing as LS


def _rows(df, root):
    return sorted((r.path[len(str(root)):], r.modtime, r.length, r.is_dir) for r in df.where("error is null").collect())


def test_second_walk_opens_changed_folders_only(spark, tmp_path):
    root, memory = tmp_path / "root", tmp_path / "memory"
    for f in ["a/b", "a/c", "d/e/f", "skip/g"]:
        (root / f).mkdir(parents=True)
        (root / f / "one.png").write_bytes(b"1")
    os.symlink(root / "a", root / "d" / "to_a")
    os.symlink(root, root / "a" / "c" / "up")
    time.sleep(0.2)

    def go(**kw):
        got = _rows(LS.walk(spark, str(root), memory=str(memory), settled=0.1, **kw), root)
        assert got == _rows(LS.walk(spark, str(root), **kw), root)
        return got

    def listed_anew():
        last = sorted(p for p in memory.glob("*/*") if (p / "done").exists())[-1]
        same = spark.read.schema(LS._CHECKED_SCHEMA).parquet(str(last / "checked"))
        return {r.path[len(str(root)):] for r in same.where("not same").collect()}

    go(patterns=["*/skip"])
    first = go(patterns=["*/skip"])
    assert listed_anew() == set() and "/d/to_a/b/one.png" in [r[0] for r in first]
    # edits in place are seen although no folder changed
    (root / "a" / "b" / "one.png").write_bytes(b"123")
    os.utime(root / "a" / "b" / "one.png", (5, 5))
    assert ("/a/b/one.png", 5, 3, False) in go(patterns=["*/skip"])
    assert listed_anew() == set()
    # new, renamed and deleted entries; a folder that was excluded before
    (root / "a" / "b" / "two.png").write_bytes(b"2")
    (root / "a" / "new" / "deep").mkdir(parents=True)
    (root / "a" / "new" / "deep" / "three.png").write_bytes(b"3")
    os.rename(root / "d" / "e", root / "d" / "h")
    (root / "a" / "c" / "one.png").unlink()
    time.sleep(0.2)
    got = [r[0] for r in go()]
    assert {"/a/b/two.png", "/a/new/deep/three.png", "/d/h/f/one.png", "/skip/g/one.png", "/d/to_a/new/deep/three.png"} <= set(got)
    assert "/a/c/one.png" not in got and "/d/e/f/one.png" not in got
    assert listed_anew() == {"/a", "/a/b", "/a/c", "/d", "/d/to_a", "/d/to_a/b", "/d/to_a/c"}
    # a walk that excludes more does not show what an earlier one saw
    assert not [r for r in go(patterns=["*/a"]) if r[0].startswith("/a")]
    go()
    loops = {r.path[len(str(root)):] for r in LS.walk(spark, str(root), memory=str(memory), settled=0.1).where("error is not null").collect()}
    assert loops == {"/a/c/up", "/d/to_a/c/up"}
    assert len(list(memory.glob("*/*"))) == 2  # older walks are removed


def test_a_folder_that_has_just_changed_is_opened_again(spark, tmp_path):
    root, memory = tmp_path / "root", tmp_path / "memory"
    root.mkdir()
    (root / "one.png").write_bytes(b"1")
    for n in range(3):  # far within the default of 60 seconds
        (root / f"{n}.png").write_bytes(b"2")
        assert LS.list_files(spark, str(root), memory=str(memory)).count() == n + 2
    assert LS.list_files(spark, str(root / "nowhere"), memory=str(memory)).count() == 0
    assert LS.list_files(spark, str(root), recursive=False, memory=str(memory)).count() == 4


def test_a_huge_folder_is_looked_at_by_many_tasks(spark, tmp_path):
    for n in range(3000):
        (tmp_path / f"{n}.png").touch()
    files = LS.walk(spark, str(tmp_path))
    assert files.count() == 3000
    per_file = [r["count"] for r in files.groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(per_file) < 1500


def test_names_that_are_not_utf8_and_dead_links(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(b"1")
    (tmp_path / "ü %41.png").write_bytes(b"1")
    with open(os.fsencode(str(tmp_path)) + b"/bad\xff.png", "wb"):
        pass
    os.symlink(tmp_path / "none.png", tmp_path / "dead.png")
    os.symlink(tmp_path / "self.png", tmp_path / "self.png")
    got = LS.walk(spark, str(tmp_path)).collect()
    assert sorted(os.path.basename(r.path) for r in got if r.error is None) == ["good.png", "ü %41.png"]
    assert {os.path.basename(r.path) for r in got if r.error} >= {"bad\\xff.png"}


def test_index_run_with_memory(spark, tmp_path, text_engine):
    root = tmp_path / "root"
    (root / "x").mkdir(parents=True)
    (root / "x" / "one.png").write_text("first text")
    (root / "two.png").write_text("second text")
    store = IndexStore(spark, str(tmp_path / "index"))
    opts = IndexOptions(cleanup=True, walk_memory=str(tmp_path / "memory"), seconds_per_file=None)
    assert index_folder(spark, str(root), store, text_engine, opts).counts == {"rows_written": 2, "failed": 0, "deleted": 0}
    (root / "two.png").unlink()
    (root / "x" / "three.png").write_text("third text")
    assert index_folder(spark, str(root), store, text_engine, opts).counts == {"rows_written": 1, "failed": 0, "deleted": 1}
    assert sorted(os.path.basename(r.path) for r in store.current().collect()) == ["one.png", "three.png"]
