"""Corpus queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from sievewright.llm import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    wanted = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    found = registry.queries()[name](spark, str(DATA))
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))
