"""Every query with SQL is held against DuckDB on the smallest tables; the others must run."""

from __future__ import annotations

import duckdb
import pytest

from folio.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return ""
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return f"{v:.5f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE_SQL:
        return
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        found = db.execute(ORACLE_SQL[name])
        want = rows_of([d[0] for d in found.description], found.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
