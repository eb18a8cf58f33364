import math

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or hasattr(v, "to_eng_string"):
        return "nan" if math.isnan(v) else float(f"{float(v):.6g}") + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows_and_a_stable_result(spark, sf_dir, name):
    """Their values are held to plain versions in test_scans.py."""
    df = catalog.queries()[name](spark, sf_dir)
    first, again = df.collect(), catalog.queries()[name](spark, sf_dir).collect()
    assert first and rows_of(df.columns, first) == rows_of(df.columns, again)
