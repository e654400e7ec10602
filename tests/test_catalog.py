"""Every registered query gives the same rows as its SQL."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import canonical
from conftest import SF
from ledgerlens.plans.catalog import QUERIES
from ledgerlens.plans.oracle import SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    res = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(columns, res.fetchall())
    assert got == want


def test_flagship_is_the_ranked_queue(spark):
    rows = entry(spark).collect()
    assert len(rows) == 712
    assert [r.priority for r in rows] == sorted(r.priority for r in rows)


def test_rule_counts_on_the_bridge(spark):
    rows = queries()["U1_union_rules"](spark, SF).collect()
    assert {r.rule_code: r.n_rows for r in rows} == {
        "BANK_MISMATCH": 60, "DISCOUNT_WINDOW": 6, "DUPLICATE": 49, "LOW_CONFIDENCE": 110, "NO_PO": 70, "PRICE_OVER_PO": 192,
        "QTY_OVER_RECEIPT": 176, "UNKNOWN_VENDOR": 49}
