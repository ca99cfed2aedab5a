"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lodeworks.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or v is pd.NaT else round(float(v), 6) if isinstance(v, float) else v
    return sorted(str(tuple(clean(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_the_report_is_one_json_document(spark, sf_dir):
    import json

    lines = [r.json for r in catalogue.QUERIES["report_json"](spark, sf_dir).collect()]
    report = json.loads("\n".join(lines))
    assert len(report["findings"]) == len(lines) - 2 and "commitSha" not in report
    tiers = [f["certainty"] for f in report["findings"]]
    assert tiers == sorted(tiers, key=["Guaranteed", "High", "Moderate", "Advisory"].index)


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries()) and set(catalogue.ORACLE) <= set(e.oracle_sql())
