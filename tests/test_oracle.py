"""Every registered query with check SQL, compared with DuckDB on the small tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from thriftline.catalogue.registry import CASES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def text(value):
    if value is None or value != value:
        return "~"
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


def content(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(text, row)) for row in zip(*[table.column(n).to_pylist() for n in names]))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(CASES)))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = CASES[name].run(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = content(df.toArrow())
    assert got == content(con.sql(entry.oracle_sql()[name]).to_arrow_table())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"persona", "n"}


def test_unchecked_queries_return_rows(spark, sf_dir):
    for name in sorted(set(CASES) - set(entry.oracle_sql())):
        assert entry.queries()[name](spark, sf_dir).limit(1).count() == 1, name
