"""Every query of the engine's own operators against its SQL oracle."""

import duckdb
import pytest

from quernstone.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_matches_oracle(spark, name):
    db = duckdb.connect()
    for table in ("pages", "events", "orders", "lineitem", "part", "customer", "nation"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = db.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    got = catalogue.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    # Rows as the engines give them: data frames would turn nullable integers to floats.
    rows = lambda cols, all_: sorted(repr([dict(zip(cols, r, strict=True))[c] for c in sorted(cols)]) for r in all_)
    assert rows(got.columns, got.collect()) == rows(names, found.fetchall())
