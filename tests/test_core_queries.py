"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import duckdb
import pytest

from mistveil.plans.queries import CRAFTED, CRAFTED_SQL, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("kind,name", [("table", n) for n in sorted(ORACLE_SQL)] + [("crafted", n) for n in sorted(CRAFTED_SQL)])
def test_same_rows_as_sql(spark, folder, duck, kind, name):
    queries, answers = (QUERIES, ORACLE_SQL) if kind == "table" else (CRAFTED, CRAFTED_SQL)
    frame = queries[name](spark, folder)
    columns = sorted(frame.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in frame.collect()), key=repr)
    cursor = duck.execute(answers[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
