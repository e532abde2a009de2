"""Every query that has SQL against DuckDB on the smallest data; the others give rows with a stable schema."""

import pytest

import __spark_entry__ as entry
from compare import connect, rows_of

ROOT = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, ROOT)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_without_sql_gives_a_stable_schema(spark, name):
    one, two = (entry.queries()[name](spark, ROOT) for _ in range(2))
    assert one.schema == two.schema and len(set(one.columns)) == len(one.columns)
    assert all(len(r) == len(one.columns) for r in one.collect())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=entry.os.path.dirname(entry.__file__))
    assert out.returncode == 0, out.stderr
