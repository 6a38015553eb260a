"""Laws of the algebra over tables with nulls, and queries against DuckDB."""

import datetime

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from findlight import queries
from findlight.operators.search import Collection
from findlight.plans import query as q
from findlight.plans.compiler import compile_query
from findlight.plans.schema import Field, Schema

SCHEMA = Schema((Field("k", prefix=(1, 9), suffix=True, ngram=(1, 3), fuzzy=True), Field("t", "text", prefix=(1, 9), fuzzy=True), Field("n", "int")))
ROWS = [(i, k, t, n) for i, (k, t, n) in enumerate((k, t, n) for k in (None, "", "ab", "Abc", "x y") for t in (None, "ab cd", "b-c x. y", "") for n in (None, 0, 3))]

words = st.sampled_from(["ab", "a", "abc", "x", "y", "b-c", "cd", "zz"])
leaves = st.one_of(
    st.builds(q.Term, st.sampled_from(["k", "t", "n", "?"]), words), st.builds(q.Prefix, st.sampled_from(["k", "t"]), words), st.builds(q.Suffix, st.just("k"), words), st.builds(q.Contains, st.just("k"), words),
    st.builds(q.Fuzzy, st.sampled_from(["k", "t"]), words), st.builds(q.Exists, st.sampled_from(["k", "t", "n"])), st.builds(q.Missing, st.sampled_from(["k", "t", "n"])), st.builds(q.Range, st.just("n"), gte=st.integers(0, 3)), st.just(q.MatchAll()),
)
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(q.Not, t), st.builds(q.And, st.lists(t, max_size=3).map(tuple)), st.builds(q.Or, st.lists(t, max_size=3).map(tuple))), max_leaves=5)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, k string, t string, n int").cache()


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(a=trees, b=trees)
def test_two_valued_logic(table, a, b):
    """No predicate is null; De Morgan holds; a tree and its negation part the rows."""
    c = lambda t: compile_query(t, SCHEMA)
    got = table.select(c(a).alias("a"), c(b).alias("b"), c(q.Not(q.And((a, b)))).alias("x"), c(q.Or((q.Not(a), q.Not(b)))).alias("y"), c(q.Bool(must=(a,), must_not=(b,))).alias("z")).collect()
    for r in got:
        assert None not in r and r.x == r.y == (not (r.a and r.b)) and r.z == (r.a and not r.b)


def test_prefix_within_contains(table):
    c = Collection(table, SCHEMA)
    ids = lambda t: {r.id for r in c.matching(t).collect()}
    for w in ("a", "ab", "abc"):
        assert ids(q.Prefix("k", w)) <= ids(q.Contains("k", w)) and ids(q.Term("k", w)) <= ids(q.Prefix("k", w))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(queries.SQL[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in rel.limit(10**8).fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 20 and set(entry.oracle_sql()) <= set(entry.queries())


def test_lsh_recall(spark, sf):
    from findlight.operators import vector

    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    indexed = vector.with_signature(df, "embedding", 64).cache()
    hits = total = 0
    for r in df.filter("vec_id % 100 = 0").collect():
        exact = {x.vec_id for x in vector.top_k(df, "embedding", r.embedding, 10, tie="vec_id").collect()}
        near = {x.vec_id for x in vector.approximate_top_k(indexed, "embedding", r.embedding, 10, tie="vec_id").collect()}
        hits, total = hits + len(exact & near), total + len(exact)
    assert hits / total >= 0.9
