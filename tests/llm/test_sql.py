"""Queries against their SQL, as the driver compares them."""

import duckdb
import pytest

from findlight.llm import queries


@pytest.mark.parametrize("name", ["quality_statistics", "mix_targets"])
@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_queries_equal_their_sql(spark, name, at):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    want = sorted(tuple(r) for r in rel.select(", ".join(sorted(rel.columns))).fetchall())
    made = queries.QUERIES[name](spark, at)
    assert sorted(tuple(r) for r in made.select(*sorted(rel.columns)).collect()) == want and want
