"""Every registered query against its DuckDB oracle on the smallest driver tables (the driver's
correctness gate, run locally)."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_callable_and_names_match():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 60


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == want


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["snippet", "path", "modtime", "rank"]
    assert df.count() > 0


def test_core_queries_stand_without_the_optional_parts():
    """Neither the training-data subpackage nor what it imports is needed for the rest."""
    import subprocess
    import sys

    code = ("import sys; sys.modules['public_tokenizers'] = None\n"
            "import __spark_entry__ as E\n"
            "assert len(E.queries()) >= 70 and not any(n.startswith('op') and n[2].isdigit() for n in E.queries()), len(E.queries())\n"
            "assert set(E.oracle_sql()) <= set(E.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(Path(__file__).resolve().parents[1]))
