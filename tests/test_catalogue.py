"""Every catalogue query against its SQL on the same tables."""

import duckdb
import pytest

from wayfold.plans import catalogue

TABLES = "part customer supplier".split()


def rows(cursor_or_df, columns):
    return sorted(tuple(r[c] for c in columns) for r in cursor_or_df)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).fetch_arrow_table()
    got = catalogue.queries()[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(want.column_names)
    got, want = rows(got.toArrow().to_pylist(), columns), rows(want.to_pylist(), columns)
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-6) if not any(isinstance(v, str) for v in g) else g == w
