import duckdb
import pytest

from palimpsest.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*queries.ORACLE_SQL, "op2_license_scan"])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, D).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names and list(got[names].dtypes) == list(want[names].dtypes)
    rows = lambda df: sorted(repr(tuple(None if v != v else v for v in r)) for r in df[names].values.tolist())
    assert rows(got) == rows(want)
