"""The pipeline's stages: each on its own input, decisions take effect, clean documents stay."""

import collections
import re

import corpus_pipeline as P
from scanlens.llm.common import written

from .test_llm_text import brute_components, brute_lines, docs_of, prose

SF = "/root/testdata/sf0.001"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_duplicates", "mix", "pieces"]
    assert P.ORACLE_SQL is None


def test_every_stage_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}

    one = written(P.identify_language(spark, docs, SF), "t")
    assert one.columns == columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert len(kept) >= 0.99 * len(before) and kept.items() <= before.items()

    two = written(P.remove_repeated_lines(spark, one, SF), "t")
    assert two.columns == columns
    want = {d: t for d, t in brute_lines(sorted(kept.items()), 20).items() if VISIBLE.search(t) or t == kept[d]}
    got = {r.doc_id: r.text for r in two.collect()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = written(P.remove_near_duplicates(spark, two, SF), "t")
    assert three.columns == columns
    groups = brute_components(sorted(got.items()), 5, 80)
    assert {r.doc_id for r in three.collect()} == set(groups.values()) and three.count() == len(set(groups.values()))

    four = written(P.mix_sources(spark, three, SF), "t")
    assert four.columns == columns
    copies = collections.Counter(r.doc_id for r in four.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(groups.values())

    five = P.encode_pieces(spark, four, SF).collect()
    assert collections.Counter(r.doc_id for r in five) == copies
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r.ids[-1] == 2 for r in five)


def test_stages_take_odd_rows(spark):
    docs = docs_of(spark, [(None, prose(40, 1), "en", "a"), (1, prose(40, 2), "en", None), (1, prose(40, 2), "en", None), (2, None, None, "a"),
                           (3, "", "en", "a"), (4, "12 34", "de", "b"), (5, "x " * 30_000, "en", "b")])
    for start in (docs, docs.limit(0)):
        step = start
        for _, stage in P.STAGES:
            step = written(stage(spark, step, SF), "t")
        ids = collections.Counter(r.doc_id for r in step.collect())
        assert set(ids) <= {None, 1, 5}


def test_stages_leave_columns_of_any_name_alone(spark):
    """Names that operators and stages use inside come back as they were."""
    from pyspark.sql import functions as F

    names = ["rejected", "score", "_letters", "lang_pred", "lines_total", "lines_removed", "__gone", "__th", "__text", "first", "__first",
             "component_id", "kept", "n_shingles", "taken", "size", "target", "copies", "copy", "id", "__copies", "packed_columns", "c0", "u", "h",
             "source_size", "th", "_part", "a.b"]
    docs = spark.createDataFrame([(k, prose(40, k), "en", "ab"[k % 2], 9) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(F.lit("front").alias("doc"), "*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names])
    for _, stage in P.STAGES[:-1]:
        docs2 = written(stage(spark, docs, SF), "t")
        assert docs2.columns == docs.columns
        rows = docs2.collect()
        assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)
    assert P.encode_pieces(spark, docs, SF).columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]


def test_run_is_repeatable(spark):
    a = sorted(map(tuple, P.run(spark, SF).drop("ids").collect()))
    assert a == sorted(map(tuple, P.run(spark, SF).drop("ids").collect())) and a
