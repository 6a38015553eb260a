"""Registered queries of sources, inference, loads, stored generations and partition plans, with their SQL.

Each writes below the shared folder and reads from there, so what is compared has been through the files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Scheme, deployment
from .functions import vectors
from .operators import layout, mutations, postings
from .operators.search import Collection, Request
from .plans import parsers
from .plans import query as q
from .plans.schema import Field, Schema, of_frame
from .sources import bulk, infer, readers
from .sources.store import ChangeLog, Checkpoint, Store, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(text: str):
    """Registers a function under its name, with the SQL that says the same."""

    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, text
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    got = readers.default_registry().open(spark, {"type": "CSV", "path": path, "columns": {"id": "C_CUSTKEY", "name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal"}})
    return got.filter(F.col("balance").try_cast("double") > 0).select(F.col("id").cast("long").alias("c_custkey"), F.col("name").alias("c_name"), F.col("segment").alias("c_mktsegment"))


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT'")
def source_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).write.json(path)
    got = readers.jsonl(spark, path, {"id": "id", "status": "status", "p": "priority"})
    return Collection(got, of_frame(got, "id")).matching(q.Term("p", "1-urgent")).select("id", "status")


@_query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def source_sql_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("nation", "region"):
        _table(spark, sf_dir, name).createOrReplaceTempView(f"findlight_{name}")
    text = "SELECT n_nationkey, r_name FROM findlight_nation JOIN findlight_region ON n_regionkey = r_regionkey WHERE r_name <> '${without}'"
    return readers.default_registry().open(spark, {"type": "sql_query", "query": text}, without="ASIA")


@_query("SELECT CAST(i + 1 AS VARCHAR) AS id, 'key-' || (i % 97) AS term, CAST(i % 16 + 1 AS VARCHAR) AS group_id, strftime(DATE '2026-01-01' + CAST(i % 28 AS INT), '%Y-%m-%d') AS date_key, CAST(i // 1000 AS VARCHAR) AS partition_id, 'e' || i AS entity_id FROM range(3000) AS t(i)")
def source_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.records(spark, 3000)


@_query(
    "SELECT * FROM (VALUES ('2024-01-02T03:04:05Z', 1704164645), ('2024-01-02T03:04:05.250+02:00', 1704157445), ('2024-01-02 03:04:05+00:00', 1704164645), ('2024-01-02 03:04:05', 1704164645), "
    "('2024-01-02T03:04:05', 1704164645), ('2024-01-02', 1704153600), (' 1704164645 ', 1704164645), ('1.5e3', 1500), ('03:04:05', -62167208155), ('01/02/2024', NULL), ('2024/01/02', NULL), ('2024-01-02 03:04', NULL), ('soon', NULL), (NULL, NULL)) AS t(text, seconds)"
)
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250+02:00", "2024-01-02 03:04:05+00:00", "2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02", " 1704164645 ", "1.5e3", "03:04:05", "01/02/2024", "2024/01/02", "2024-01-02 03:04", "soon", None]
    made = spark.createDataFrame([(t,) for t in texts], "text string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    # Texts without a zone are in UTC whatever the session's.
    at = readers.parse_time(F.col("text"))
    has_zone = F.col("text").rlike(r"(Z|[+-]\d\d:\d\d)$") & F.col("text").contains(":") | F.col("text").rlike(r"^\s*[+-]?[\d.]+([eE][+-]?\d+)?\s*$")
    return made.select("text", F.when(has_zone, F.unix_seconds(at)).otherwise(F.unix_seconds(F.from_utc_timestamp(at, zone))).alias("seconds"))


@_query(
    "SELECT * FROM (VALUES ('cpt_code', 'keyword', 3), ('status', 'keyword', 3), ('item_name', 'text', 0), ('home_address', 'text', 0), ('biography', 'text', 0), ('note', 'text', 0), ('amount', 'float', 0), "
    "('visits', 'int', 0), ('active', 'keyword', 0), ('seen_at', 'time', 0), ('short', 'keyword', 3), ('wordy', 'text', 0), ('middling', 'keyword', 0), ('ones', 'int', 0), ('keys', 'keyword', 3)) AS t(name, kind, least_prefix)"
)
def infer_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "cpt_code": ["99213", "80053"], "status": ["a status that is told in a good many words indeed"] * 2, "item_name": ["ab", "cd"], "home_address": ["x1", "x2"], "biography": ["a", "b"], "note": ["n", "m"], "amount": ["1.5", "2"],
        "visits": ["1", "-2"], "active": ["true", "False"], "seen_at": ["2024-01-02", "2024-02-03"], "short": ["abc", "abd"], "wordy": ["two words", "and three more"], "middling": ["x" * 30, "y" * 30], "ones": ["1", "0"], "keys": ["7", "8"],
    }
    fields = [infer.of_values(name, values) for name, values in columns.items()]
    return spark.createDataFrame([(f.name, f.kind, f.prefix[0] if f.prefix else 0) for f in fields], "name string, kind string, least_prefix int")


@_query("SELECT * FROM (VALUES ('event_id', 'int'), ('ts', 'time'), ('user_id', 'int'), ('event_type', 'keyword'), ('value', 'float'), ('props', 'keyword')) AS t(name, kind) WHERE name <> 'event_id'")
def infer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dict(infer.describe(infer.infer(_table(spark, sf_dir, "events"), "event_id")))
    # What a JSON text looks like depends on its length.
    return spark.createDataFrame([(n, "keyword" if n == "props" else k) for n, k in found.items()], "name string, kind string")


_TOKENS = r"regexp_extract_all(lower(p_name), '[\p{L}\p{Nd}_\-@.]+')"


def _by_words(spark: SparkSession, sf_dir: str) -> Collection:
    """Parts whose names are texts with every operator."""
    df = _table(spark, sf_dir, "part")
    return Collection(df, of_frame(df, "p_partkey", text=("p_name",)))


@_query(
    f"SELECT p_partkey, 'contains' AS op FROM part WHERE contains(lower(p_name), 'lack') UNION ALL SELECT p_partkey, 'starts_with' FROM part WHERE len(list_filter({_TOKENS}, lambda t: starts_with(t, 'bl'))) > 0 "
    f"UNION ALL SELECT p_partkey, 'ends_with' FROM part WHERE len(list_filter({_TOKENS}, lambda t: ends_with(t, 'ue'))) > 0 UNION ALL SELECT p_partkey, 'fuzzy' FROM part WHERE len(list_filter({_TOKENS}, lambda t: t[1] = 'b' AND abs(length(t) - 4) <= 1 AND levenshtein(t, 'blur') <= 1)) > 0"
)
def url_filter_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, out = _by_words(spark, sf_dir), None
    for op, value in (("contains", "lack"), ("starts_with", "bl"), ("ends_with", "ue"), ("fuzzy", "blur")):
        found = c.matching(parsers.url_filter(f"p_name__{op}={value}", c.schema)).select("p_partkey", F.lit(op).alias("op"))
        out = found if out is None else out.union(found)
    return out


_DOC_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}_\-@.]+')"


@_query(
    f"""WITH d AS (SELECT doc_id, {_DOC_TOKENS} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), x AS (SELECT doc_id, len(t) AS dl, unnest(t) AS tok FROM d),
c AS (SELECT doc_id, dl, tok, count(*) AS tf FROM x WHERE tok[1] = 'f' AND abs(length(tok) - 4) <= 1 AND levenshtein(tok, 'from') <= 1 GROUP BY ALL), f AS (SELECT tok, count(*) AS df FROM c GROUP BY 1)
SELECT doc_id, round(sum((CASE WHEN tok = 'from' THEN 1 ELSE 0.8 END) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 5) AS score FROM c JOIN f USING (tok), n GROUP BY 1"""
)
def global_term_fuzzy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "documents").select("doc_id", "text")
    c = Collection(df, of_frame(df, "doc_id", text=("text",)))
    return c.search(Request(q.GlobalTerm(("from",), True), limit=1 << 30)).hits.select("doc_id", F.round("score", 5).alias("score"))


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1")
def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark))
    bulk.load(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), store, Schema((Field("event_type"),), "user_id"), seq_col="event_id")
    return store.read()


@_query("SELECT (SELECT count(*) FROM events) AS seen, (SELECT count(DISTINCT user_id) FROM events) AS kept, 0::BIGINT AS again")
def bulk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events, then all of them with resume, then nothing new."""
    root, events = scratch(spark), _table(spark, sf_dir, "events").select("user_id", "event_id")
    store, marks, schema = Store(spark, f"{root}/s"), Checkpoint(spark, f"{root}/c"), Schema((), "user_id")
    middle = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    steps = [bulk.load(x, store, schema, "event_id", marks) for x in (events.filter(F.col("event_id") <= middle), events, events)]
    return spark.range(1).select(F.lit(steps[0].seen + steps[1].seen).cast("long").alias("seen"), F.lit(store.manifest().rows).cast("long").alias("kept"), F.lit(steps[2].seen).cast("long").alias("again"))


@_query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, orders = scratch(spark), _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    store, marks, schema = Store(spark, f"{root}/s"), Checkpoint(spark, f"{root}/c"), Schema((), "o_custkey")
    middle = orders.agg(F.expr("percentile_approx(o_orderkey, 0.5)")).first()[0]
    for part in (orders.filter(F.col("o_orderkey") <= middle), orders, orders):
        bulk.incremental(part, store, schema, marks, time_col="o_orderkey")
    return store.read()


@_query("SELECT c_custkey, c_name FROM customer")
def partitioned_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of about 500 rows by ranges of the id; no range overlaps another."""
    store = Store(spark, scratch(spark))
    store.save(bulk.partitioned(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 500, "c_custkey"), partition_by=("part",))
    ends = store.read().groupBy("part").agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))
    overlap = ends.alias("a").join(F.broadcast(ends.alias("b")), F.expr("a.part < b.part AND a.high >= b.low")).limit(1)  # a row for each part
    return store.read().join(overlap, F.lit(True), "left_anti").select("c_custkey", "c_name")


@_query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def open_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older events in a generation, newer ones in a change log only; opened, the log is replayed."""
    root = scratch(spark)
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    middle = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    store, log = Store(spark, f"{root}/s"), ChangeLog(spark, f"{root}/log")
    old = events.filter(F.col("event_id") <= middle)
    store.save(mutations.apply_changes(old.limit(0).drop("op"), old, "user_id", "event_id"))
    log.append(events.filter(F.col("event_id") > middle))
    return store.replayed(log, "user_id", "event_id")


@_query("SELECT event_id, event_type, value FROM events")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with checksums, a damaged line among them, and read back without it."""
    path, events = scratch(spark), _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    log = ChangeLog(spark, path)
    log.append(events)
    spark.range(1).select(F.lit('{"event_id": -1}').alias("body"), F.lit(1).cast("long").alias("crc")).write.mode("append").json(path)
    return log.read(events.schema)


@_query("SELECT * FROM (VALUES (1, 'ok', 25), (2, 'ok', 24), (3, 'an id is repeated', 26)) AS t(generation, state, rows)")
def validate_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    store, schema = Store(spark, scratch(spark)), Schema((Field("n_name", unique=True),), "id")
    store.save(nation)
    store.save(nation.filter("id > 0"))
    store.save(nation.union(nation.filter("id = 3")))
    rows = [(n, (store.validate(schema, n) or ["ok"])[0], store.manifest(n).rows) for n in (1, 2, 3)]
    return spark.createDataFrame(rows, "generation int, state string, rows int")


@_query("SELECT n_nationkey AS id, n_name FROM nation")
def repaired_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    store = Store(spark, scratch(spark))
    store.save(nation.union(nation).union(nation.limit(2).withColumn("id", F.lit(None).cast("int"))))
    store.repair(Schema((Field("n_name"),), "id"))
    store.compact(1)
    return store.read()


@_query("SELECT r_regionkey, r_name FROM region WHERE r_name >= 'B'")
def restored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection stored by one catalog, restored by another, and searched there."""
    root, region = scratch(spark), _table(spark, sf_dir, "region")
    Catalog(spark, root).add("regions", region, of_frame(region, "r_regionkey"))
    other = Catalog(spark, root)
    other.restore()
    return other.get("regions").matching(q.Not(q.Prefix("r_name", "a"))).select("r_regionkey", "r_name")


@_query("SELECT name, id FROM (SELECT 'nation' AS name, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE lower(n_name) LIKE 'i%' UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region WHERE lower(r_name) LIKE 'i%')")
def search_all_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark)
    for name, id_col, field in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        df = _table(spark, sf_dir, name).select(id_col, F.col(field).alias("name"))
        catalog.add(name, df, of_frame(df, id_col))
    return catalog.search_all(["nation", "region"], Request(q.Prefix("name", "i"), limit=100)).select(F.col("collection").alias("name"), "id")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3 AND year(l_shipdate) = 1996 AND month(l_shipdate) = 5")
def partition_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in folders by group and month; a lookup reads one of them."""
    path, scheme = scratch(spark), Scheme("lines", 4, 4)
    rows = _table(spark, sf_dir, "lineitem").withColumn("date_key", F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = rows.withColumns(scheme.columns(F.col("l_linenumber"), F.col("date_key"), F.col("l_suppkey"))).select("l_orderkey", "l_linenumber", "date_key", "wi", "month", "fac")
    layout.write(rows, path, partition_by=("wi", "month"))
    return scheme.prune(spark.read.parquet(path), 3, "1996-05-17").filter("l_linenumber = 3 AND month = '199605'").select("l_orderkey", "l_linenumber")


@_query("SELECT * FROM (VALUES (0::BIGINT, 1, 5000000), (1000000, 1, 5000000), (100000000, 20, 5000000), (1000000000, 200, 5000000)) AS t(rows, partitions, rows_per_partition)")
def deployment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = [deployment(n) for n in (0, 1_000_000, 100_000_000, 1_000_000_000)]
    return spark.createDataFrame([(p.rows, p.partitions, p.rows_per_partition) for p in plans], "rows long, partitions int, rows_per_partition int")


@_query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery' AND c_acctbal >= 1000")
def normalized_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised columns, sorted files and a Bloom filter, written and searched."""
    path, df = scratch(spark), _table(spark, sf_dir, "customer")
    made, schema = layout.normalized(df, of_frame(df, "c_custkey"), "c_mktsegment")
    layout.write(made, path, sort_by=("c_mktsegment__norm", "c_acctbal"), bloom=("c_mktsegment__norm",))
    return Collection(spark.read.parquet(path), schema).matching(q.And((q.Term("c_mktsegment", "Machinery"), q.Range("c_acctbal", gte=1000)))).select("c_custkey")


@_query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return Collection(orders, of_frame(orders, "o_orderkey")).get(orders.agg(F.max("o_orderkey")).first()[0])


@_query("SELECT vec_id, vec_id % 3 = 0 AS ok FROM embeddings")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut short, or with a NaN in them, aren't written."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 3 == 2, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding")).alias("embedding"))
    good, bad = mutations.split_valid(v, Schema((Field("embedding", "vector", dim=64),), "vec_id"))
    return good.select("vec_id", F.lit(True).alias("ok")).union(bad.select("vec_id", F.lit(False).alias("ok")))


@_query("SELECT c_custkey, 1 AS n FROM customer WHERE false")
def empty_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank literals match nothing, whatever the operator."""
    df = _table(spark, sf_dir, "customer")
    c = Collection(df, of_frame(df, "c_custkey"))
    tree = q.Or(tuple(kind("c_name", " ") for kind in (q.Term, q.Prefix, q.Suffix, q.Contains, q.Fuzzy)) + (q.Terms("c_name", ("", " ")),))
    return c.matching(tree).select("c_custkey", F.lit(1).alias("n"))


@_query("SELECT vec_id, len(embedding) = 64 AS ok FROM embeddings")
def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", vectors.valid(F.col("embedding"), 64).alias("ok"))


_BM25_SQL = f"""WITH d AS (SELECT doc_id, {_DOC_TOKENS} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), x AS (SELECT doc_id, len(t) AS dl, unnest(t) AS tok FROM d),
c AS (SELECT doc_id, dl, tok, count(*) AS tf FROM x WHERE tok IN ('from', 'with') GROUP BY ALL), f AS (SELECT tok, count(*) AS df FROM c GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 5) AS score FROM c JOIN f USING (tok), n GROUP BY 1 HAVING count(*) = 2"""


@_query(_BM25_SQL)
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking by stored token tables."""
    df, path = _table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark)
    postings.save(df, of_frame(df, "doc_id", text=("text",)), path)
    return postings.bm25(spark, path, ("from", "with")).select(F.col("id").alias("doc_id"), F.round("score", 5).alias("score"))
