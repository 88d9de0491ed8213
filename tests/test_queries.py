"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__
from veilspark.plans import catalog_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("validate_iban", "validate_finnish_hetu", "validate_norwegian_fnr", "scan_email_1", "scan_bic_2", "context_currency", "context_plate_in_compound", "labels", "json_dates", "delimited_dates", "recall_grouping_sets", "recall_matrix", "precision_by_type", "pii_rate_by_lang")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = catalog_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(map(value, r)) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog_queries.ORACLES[name]})").fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
