"""Registered queries over the test tables, one or more for each operator, with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored_queries
from .functions import analyzers, normalize, structures, vectors
from .operators import mutations, vector
from .operators.layout import dealt
from .operators.search import Collection, Request, Sort, union_shards
from .plans import parsers
from .plans import query as q
from .plans.compiler import compound_key, encode_date
from .plans.schema import Field, Schema, of_frame
from .sources import infer as inference
from .sources.store import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOKEN = r"[\p{L}\p{Nd}_\-@.]+"
TOKENS = f"regexp_extract_all(lower(text), '{TOKEN}')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def documents(spark: SparkSession, sf_dir: str) -> Collection:
    df = dealt(_table(spark, sf_dir, "documents"), "doc_id")
    return Collection(df, of_frame(df, "doc_id", text=("text",)))


def _simple(name: str, table: str, id: str) -> Callable[[SparkSession, str], Collection]:
    def made(spark: SparkSession, sf_dir: str) -> Collection:
        df = _table(spark, sf_dir, table)
        return Collection(df, of_frame(df, id))

    return made


parts, customers, orders, events, pages = (_simple(t, t, i) for t, i in (("part", "p_partkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("pages", "page_id")))


def lineitems(spark: SparkSession, sf_dir: str) -> Collection:
    df = _table(spark, sf_dir, "lineitem")
    return Collection(df, of_frame(df, "l_orderkey"))


def _ids(name: str, of: Callable[[SparkSession, str], Collection], tree: q.Query | Callable[[Collection], q.Query], keys: str, sql: str) -> None:
    """A query that returns the keys of all matches."""
    columns = [k.strip() for k in keys.split(",")]
    _register(name, lambda s, d: (c := of(s, d)).matching(tree(c) if callable(tree) else tree).select(*columns), sql)


# Terms, sets, presence.
_ids("term_keyword", customers, q.Term("c_mktsegment", " building "), "c_custkey", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
_ids("terms_in", orders, q.Terms("o_orderpriority", ("1-URGENT", "2-HIGH", "none")), "o_orderkey", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')")
_ids("term_text", documents, q.Term("text", "the"), "doc_id", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'the')")
_ids("match_all", parts, q.MatchAll(), "p_partkey", "SELECT p_partkey FROM part")


def labelled(spark: SparkSession, sf_dir: str) -> Collection:
    df = _table(spark, sf_dir, "documents").select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return Collection(df, of_frame(df, "doc_id"))


_LABELLED = "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"
_ids("exists", labelled, q.Exists("quality"), "doc_id", f"SELECT doc_id FROM ({_LABELLED}) WHERE quality IS NOT NULL")
_ids("missing", labelled, q.Missing("quality"), "doc_id", f"SELECT doc_id FROM ({_LABELLED}) WHERE quality IS NULL")

# Patterns.
_ids("prefix_keyword", parts, q.Prefix("p_name", "b"), "p_partkey", "SELECT p_partkey FROM part WHERE starts_with(lower(p_name), 'b')")
_ids("prefix_token", documents, q.Prefix("text", "ther"), "doc_id", f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda t: starts_with(t, 'ther'))) > 0")
_ids("suffix_keyword", parts, q.Suffix("p_brand", "3"), "p_partkey", "SELECT p_partkey FROM part WHERE ends_with(lower(p_brand), '3')")
_ids("suffix_token", documents, q.Suffix("text", "tion."), "doc_id", f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda t: ends_with(t, 'tion.'))) > 0")
_ids("contains_grams", documents, q.Contains("text", "thing"), "doc_id", "SELECT doc_id FROM documents WHERE contains(lower(text), 'thin') AND contains(lower(text), 'hing')")
_ids("fuzzy_token", parts, q.Fuzzy("p_brand", "brand#12", 1), "p_partkey", "SELECT p_partkey FROM part WHERE lower(p_brand)[1] = 'b' AND levenshtein(lower(p_brand), 'brand#12') <= 1")
_ids("fuzzy_text", documents, q.Fuzzy("text", "tkat", 1), "doc_id", f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda t: t[1] = 't' AND abs(length(t) - 4) <= 1 AND levenshtein(t, 'tkat') <= 1)) > 0")
_ids("source_string_filters", parts, q.Or((q.Whole("p_name", "red", "contains"), q.Whole("p_brand", "brand#5", "starts_with"), q.Whole("p_type", "steel", "ends_with"), q.Whole("p_brand", "brand#11", "fuzzy"))), "p_partkey", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR starts_with(lower(p_brand), 'brand#5') OR ends_with(lower(p_type), 'steel') OR levenshtein(lower(p_brand), 'brand#11') <= 1")

# Ranges.
_ids("range_number", lineitems, q.Range("l_quantity", gte=10, lt="20"), "l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
_ids("range_exclusive_wins", lineitems, q.Range("l_quantity", gte=1, gt=45), "l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
_ids("range_time", orders, q.Range("o_orderdate", gte="1995-01-01T00:00:00Z", lte="1995-12-31"), "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31'")
_ids("not_zero", customers, lambda c: parsers.filter_of(c.schema, "c_nationkey", "not_zero", ""), "c_custkey", "SELECT c_custkey FROM customer WHERE c_nationkey <> 0")
_ids("between", customers, lambda c: parsers.filter_of(c.schema, "c_acctbal", "between", "-100,1000"), "c_custkey", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN -100 AND 1000")

# Boolean algebra.
_QTY, _FLAG, _DISC = q.Range("l_quantity", gt=30), q.Term("l_returnflag", "r"), q.Range("l_discount", gte=0.05)
_LINE = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "
_ids("and", lineitems, q.And((_QTY, _FLAG)), "l_orderkey, l_linenumber", _LINE + "l_quantity > 30 AND lower(l_returnflag) = 'r'")
_ids("or", lineitems, q.Or((_QTY, _FLAG)), "l_orderkey, l_linenumber", _LINE + "l_quantity > 30 OR lower(l_returnflag) = 'r'")
_ids("not", labelled, q.Not(q.Range("quality", gte=1)), "doc_id", f"SELECT doc_id FROM ({_LABELLED}) WHERE NOT coalesce(quality >= 1, false)")
_ids("bool", orders, q.Bool(must=(q.Term("o_orderstatus", "f"),), should=(q.Term("o_orderpriority", "1-urgent"), q.Range("o_totalprice", gt=200_000)), must_not=(q.Range("o_totalprice", lt=50_000),)), "o_orderkey", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f' AND (lower(o_orderpriority) = '1-urgent' OR o_totalprice > 200000) AND NOT o_totalprice < 50000")
_ids("bool_msm2", lineitems, q.Bool(should=(_QTY, _FLAG, _DISC), min_should_match=2), "l_orderkey, l_linenumber", _LINE + "(l_quantity > 30)::int + (lower(l_returnflag) = 'r')::int + (l_discount >= 0.05)::int >= 2")

# Parsers.
_ids("simple_syntax", documents, parsers.simple("text", "+the -und from th* *tion"), "doc_id", f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE list_contains(t, 'the') AND NOT list_contains(t, 'und') AND (list_contains(t, 'from') OR len(list_filter(t, lambda x: starts_with(x, 'th'))) > 0 OR len(list_filter(t, lambda x: ends_with(x, 'tion'))) > 0)")
_ids("url_filter", orders, lambda c: parsers.url_filter("o_orderstatus=O&o_totalprice__gte=1000&o_totalprice__lt=90000&o_orderpriority__in=1-URGENT%2C3-MEDIUM&limit=5", c.schema), "o_orderkey", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'o' AND o_totalprice >= 1000 AND o_totalprice < 90000 AND lower(o_orderpriority) IN ('1-urgent', '3-medium')")
_ids("url_filter_patterns", parts, lambda c: parsers.url_filter("p_name__contains=re&p_brand__ne=Brand%2311&p_type__not_contains=steel&p_size__not_zero=", c.schema), "p_partkey", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 're') AND lower(p_brand) <> 'brand#11' AND NOT (contains(lower(p_type), 'stee') AND contains(lower(p_type), 'teel')) AND p_size <> 0")
_ids("url_global_term", documents, lambda c: parsers.url_filter("term=the+from&source=src1", c.schema), "doc_id", f"SELECT doc_id FROM (SELECT doc_id, source, lang, {TOKENS} AS t FROM documents) WHERE (list_contains(t, 'the') OR lang = 'the') AND (list_contains(t, 'from') OR lang = 'from') AND lower(source) = 'src1'")
_ids("wire_bool", documents, parsers.wire('{"type": "bool", "must": [{"type": "term", "field": "lang", "value": "en"}], "filter": [{"type": "range", "field": "n_chars", "gte": 500}], "must_not": [{"type": "terms", "field": "source", "values": ["src1", "src2"]}]}'), "doc_id", "SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND n_chars >= 500 AND lower(source) NOT IN ('src1', 'src2')")

# Phrases.
_JOINED = f"concat(' ', array_to_string({TOKENS}, ' '), ' ')"
_ids("phrase_slop0", documents, q.Phrase("text", "of the"), "doc_id", f"SELECT doc_id FROM documents WHERE contains({_JOINED}, ' of the ')")
_ids("phrase_slop0_long", documents, q.Phrase("text", "and the of"), "doc_id", f"SELECT doc_id FROM documents WHERE contains({_JOINED}, ' and the of ')")
_SLOP = f"""WITH t AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT doc_id, {TOKENS} AS toks FROM documents)),
a AS (SELECT doc_id, pos AS p FROM t WHERE tok = 'and'),
b AS (SELECT a.doc_id, a.p AS s, min(t.pos) AS p FROM a JOIN t ON t.doc_id = a.doc_id AND t.tok = 'the' AND t.pos > a.p AND t.pos <= a.p + 3 GROUP BY 1, 2),
c AS (SELECT b.doc_id, b.s, min(t.pos) AS p FROM b JOIN t ON t.doc_id = b.doc_id AND t.tok = 'of' AND t.pos > b.p AND t.pos <= b.p + 3 GROUP BY 1, 2)
SELECT DISTINCT doc_id FROM c"""
_ids("phrase_slop2", documents, q.Phrase("text", "and the of", 2), "doc_id", _SLOP)
_ids("proximity_ordered", documents, q.Proximity("text", ("and", "the", "of"), 2, True), "doc_id", _SLOP)
_ids("proximity_and", documents, q.Proximity("text", ("from", "with"), 1), "doc_id", f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE list_contains(t, 'from') AND list_contains(t, 'with')")


# Addresses, domains, URLs.
def hosts(spark: SparkSession, sf_dir: str) -> Collection:
    k = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("10."), k % 4, F.lit("."), k % 256, F.lit("."), k % 100).alias("ip"))
    return Collection(df, of_frame(df, "c_custkey"))


_ids("cidr", hosts, q.Cidr("ip", "10.1.64.0/18"), "c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 256 BETWEEN 64 AND 127")


def sites(spark: SparkSession, sf_dir: str) -> Collection:
    df = _table(spark, sf_dir, "pages").select("page_id", normalize.url_host(F.col("url")).alias("domain"), normalize.url(F.col("url")).alias("url"))
    return Collection(df, of_frame(df, "page_id"))


_HOST = r"regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
_ids("domain_wildcard", sites, q.DomainWildcard("domain", "*.example.com"), "page_id", f"SELECT page_id FROM pages WHERE {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com')")
_register("url_host_norm", lambda s, d: sites(s, d).live.select("page_id", "domain"), f"SELECT page_id, nullif({_HOST}, '') AS domain FROM pages")


# Composites.
def records(spark: SparkSession, sf_dir: str) -> Collection:
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("term"), F.col("l_linenumber").cast("string").alias("group_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_key"), F.col("l_linestatus").alias("source"))
    return Collection(df, of_frame(df, "l_orderkey"))


_ids("composite_lookup", lineitems, q.Compound(("l_returnflag", "l_linestatus", "l_quantity"), ("R", "F", 17)), "l_orderkey, l_linenumber", _LINE + "l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 17")
_ids("tuple_lookup", records, parsers.lookup("term=R&group_id=2&date_key=1997-01-04&source=F"), "l_orderkey, l_linenumber", _LINE + "l_returnflag = 'R' AND l_linenumber = 2 AND CAST(l_shipdate AS DATE) = DATE '1997-01-04' AND l_linestatus = 'F'")
_register("compound_key", lambda s, d: _table(s, d, "customer").select("c_custkey", compound_key(F.col("c_mktsegment"), F.col("c_nationkey")).alias("key")), "SELECT c_custkey, lower(c_mktsegment) || chr(31) || c_nationkey AS key FROM customer")
_register("tuple_date", lambda s, d: _table(s, d, "orders").select("o_orderkey", encode_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day")), "SELECT o_orderkey, (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2147483648)::BIGINT AS day FROM orders")

# Pages, orders, facets, counts.
_register("flagship_bool", lambda s, d: documents(s, d).search(Request(q.Bool(must=(q.Term("text", "the"),), filter=(q.Range("n_chars", gte=200, lt=5000),), must_not=(q.Term("lang", "de"),)), limit=20, sort=(Sort("n_chars", desc=True),))).hits.select("doc_id", "lang", "n_chars"), f"SELECT doc_id, lang, n_chars FROM documents WHERE list_contains({TOKENS}, 'the') AND n_chars >= 200 AND n_chars < 5000 AND lower(lang) <> 'de' ORDER BY n_chars DESC, doc_id LIMIT 20")
for _name, _sort, _sql in (("asc", Sort("quality"), "ASC NULLS LAST"), ("asc_first", Sort("quality", missing="first"), "ASC NULLS FIRST"), ("desc", Sort("quality", True), "DESC NULLS FIRST"), ("desc_first", Sort("quality", True, "first"), "DESC NULLS LAST")):
    _register(f"sort_missing_{_name}", lambda s, d, o=_sort: labelled(s, d).search(Request(None, limit=120, sort=(o, Sort("lang")))).hits.select("doc_id", "quality"), f"SELECT doc_id, quality FROM ({_LABELLED}) ORDER BY quality {_sql}, lang, doc_id LIMIT 120")
_register("offset_limit", lambda s, d: orders(s, d).search(Request(q.Term("o_orderstatus", "o"), limit=15, offset=30)).hits.select("o_orderkey", "score"), "SELECT o_orderkey, 1.0::DOUBLE AS score FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 15 OFFSET 30")
_register("facet_event_type", lambda s, d: events(s, d).facet(q.Range("value", gt=10), "event_type"), "SELECT event_type AS value, count(*) AS count FROM events WHERE value > 10 AND event_type IS NOT NULL GROUP BY 1")
_register("facet_multi", lambda s, d: (r := orders(s, d).search(Request(q.MatchAll(), facets=("o_orderstatus", "o_orderpriority"))).facets)["o_orderstatus"].select(F.lit("o_orderstatus").alias("facet"), "*").union(r["o_orderpriority"].select(F.lit("o_orderpriority").alias("facet"), "*")), "SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
_register("count", lambda s, d: lineitems(s, d).matching(q.And((_QTY, _FLAG))).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30 AND lower(l_returnflag) = 'r'")
_register("late_hydration", lambda s, d: (c := documents(s, d)).search(Request(q.Term("lang", "en"), limit=10, sort=(Sort("n_chars", True),), with_docs=False)).hits.drop("score").join(c.live.select("doc_id", "source", "n_chars"), "doc_id").select("doc_id", "source", "n_chars"), "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10")
_register("stats", lambda s, d: Collection(_table(s, d, "documents").select("doc_id", "text", "lang", "source"), of_frame(_table(s, d, "documents").select("doc_id", "text", "lang", "source"), "doc_id", text=("text",))).stats(), f"SELECT count(*) AS docs, count(*) AS live, 0::BIGINT AS deleted, 3 AS fields, ((SELECT count(DISTINCT t) FROM (SELECT unnest({TOKENS}) AS t FROM documents)) + (SELECT count(DISTINCT lang) + count(DISTINCT source) FROM documents))::BIGINT AS terms, 0::BIGINT AS vectors FROM documents")
_register("rerank_column", lambda s, d: orders(s, d).rerank(Request(q.Term("o_orderstatus", "o"), limit=25), F.round(F.col("o_totalprice") / 1000, 3)).select("o_orderkey", "score"), "SELECT o_orderkey, round(o_totalprice / 1000, 3) AS score FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25)")

# Ranking and score functions.
_FIELDS = [("text", True), ("lang", False), ("source", False)]


def _bm25_sql(words: tuple[str, ...]) -> str:
    tf = {w: f"len(list_filter(t, lambda x: x = '{w}'))" for w in words}
    lines = [f"WITH d AS (SELECT doc_id, lower(lang) AS lang, lower(source) AS source, {TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl, " + ", ".join(f"count(*) FILTER ({tf[w]} > 0) AS df{k}" for k, w in enumerate(words)) + " FROM d)"]
    parts = [f"CASE WHEN {tf[w]} > 0 THEN ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * {tf[w]} * 2.2 / ({tf[w]} + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) ELSE 0 END" for k, w in enumerate(words)]
    where = " AND ".join(f"{tf[w]} > 0" for w in words)
    return lines[0] + f" SELECT doc_id, round({' + '.join(parts)}, 6) AS score FROM d, s WHERE {where}"


_register("bm25_global", lambda s, d: documents(s, d).search(Request(q.GlobalTerm(("from", "with")), limit=1 << 30)).hits.select("doc_id", F.round("score", 6).alias("score")), _bm25_sql(("from", "with")))
_register("bm25_top10", lambda s, d: documents(s, d).search(Request(q.GlobalTerm(("that",)), limit=10)).hits.select("doc_id", F.round("score", 6).alias("score")), _bm25_sql(("that",)) + " ORDER BY score DESC, doc_id LIMIT 10")
_ids("global_term_fields", documents, q.GlobalTerm(("en", "src3")), "doc_id", f"SELECT doc_id FROM (SELECT doc_id, lang, source, {TOKENS} AS t FROM documents) WHERE (list_contains(t, 'en') OR lang = 'en' OR source = 'en') AND (list_contains(t, 'src3') OR lang = 'src3' OR source = 'src3')")
_register("global_term_fuzzy", lambda s, d: documents(s, d).matching(q.GlobalTerm(("fron",), True)).select("doc_id"), f"SELECT doc_id FROM (SELECT doc_id, lang, source, {TOKENS} AS t FROM documents) WHERE len(list_filter(t, lambda x: x[1] = 'f' AND levenshtein(x, 'fron') <= 1)) > 0 OR (lang[1] = 'f' AND levenshtein(lang, 'fron') <= 1)")
_register("highlight", lambda s, d: documents(s, d).highlight(q.Term("text", "from"), "text", "from", 40), f"SELECT doc_id, CASE WHEN p > 0 THEN substring(text, s, p - s) || '<mark>' || substring(text, p, 4) || '</mark>' || substring(text, p + 4, 20) ELSE '' END AS highlight FROM (SELECT doc_id, text, instr(lower(text), 'from') AS p, greatest(instr(lower(text), 'from') - 20, 1) AS s FROM documents WHERE list_contains({TOKENS}, 'from'))")
_register("decay", lambda s, d: _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(vectors.decay(F.col("l_quantity"), 25, 10), 6).alias("score")), "SELECT l_orderkey, l_linenumber, round(exp(-abs(l_quantity - 25) / 10), 6) AS score FROM lineitem")

# Vectors.
PROBE = 3


def embedded(spark: SparkSession, sf_dir: str) -> Collection:
    df = _table(spark, sf_dir, "embeddings")
    return Collection(df, Schema((Field("embedding", "vector", dim=64), Field("label", "int")), "vec_id"))


def _probe(spark: SparkSession, sf_dir: str) -> tuple[float, ...]:
    return tuple(_table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == PROBE).first().embedding)


def _nearest(metric: str, where: q.Query | None = None) -> Query:
    return lambda s, d: embedded(s, d).search(Request(q.Vector("embedding", _probe(s, d), 10, metric, where), limit=10)).hits.select("vec_id", F.round("score", 4).alias("score"))


_VEC = f"WITH p AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = {PROBE}), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, label, {{}} AS s FROM v, p) {{}} ORDER BY s DESC, vec_id LIMIT 10"
_register("vector_cosine_topk", _nearest("cos"), _VEC.format("list_cosine_similarity(x, e)", ""))
_register("vector_dot_topk", _nearest("inner_product"), _VEC.format("list_inner_product(x, e)", ""))
_register("vector_l2_topk", _nearest("euclidean"), _VEC.format("-list_distance(x, e) * list_distance(x, e)", ""))
_register("vector_filtered", _nearest("cosine", q.Range("label", gte=1, lte=3)), _VEC.format("list_cosine_similarity(x, e)", "WHERE label BETWEEN 1 AND 3"))
_register("vector_in_bool", lambda s, d: embedded(s, d).matching(q.Bool(must=(q.Vector("embedding", _probe(s, d), 50, "cosine"),), must_not=(q.Range("label", gte=5),))).select("vec_id"), f"WITH p AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = {PROBE}) SELECT vec_id FROM (SELECT vec_id, label FROM embeddings, p ORDER BY list_cosine_similarity(embedding::DOUBLE[], e) DESC, vec_id LIMIT 50) WHERE NOT coalesce(label >= 5, false)")
_register("vector_lsh", lambda s, d: vector.approximate_top_k(vector.with_signature(_table(s, d, "embeddings"), "embedding", 64), "embedding", _probe(s, d), 10, tie="vec_id").select("vec_id", F.round("score", 4).alias("score")))
def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with signatures, written, and searched by these with exact ranking of what is near."""
    path = scratch(spark)
    vector.with_codes(_table(spark, sf_dir, "embeddings"), "embedding", 64).write.parquet(path)
    return vector.coded_top_k(spark.read.parquet(path), "vec_id", "embedding", _probe(spark, sf_dir), 10).select("vec_id", F.round("score", 4).alias("score"))


_register("vector_codes", _coded)
_register("quantize", lambda s, d: _table(s, d, "embeddings").select("vec_id", F.posexplode(vectors.quantize(F.col("embedding"))).alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("int").alias("v")), "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, trunc(least(greatest(unnest(embedding)::DOUBLE, -1), 1) * 127)::INT AS v FROM embeddings")
_register("dequantize", lambda s, d: _table(s, d, "embeddings").select("vec_id", F.posexplode(vectors.dequantize(vectors.quantize(F.col("embedding")))).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v")), "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, round(trunc(least(greatest(unnest(embedding)::DOUBLE, -1), 1) * 127) / 127, 6) AS v FROM embeddings")


# Analyzers: how often each token occurs.
def _analyzer(name: str, query: Callable[[object], object], tokens: str) -> None:
    _register(f"analyzer_{name}", lambda s, d: dealt(_table(s, d, "documents"), "doc_id").select(F.explode_outer(query(F.col("text"))).alias("token")).filter("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n")), f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens}) AS token FROM documents) GROUP BY 1")


_STEM = "CASE " + " ".join(f"WHEN ends_with(t, '{x}') AND strlen(t) > {len(x) + 2} THEN t[:length(t) - {len(x)}]" + (" || 'y'" if x == "ies" else "") for x in analyzers.SUFFIXES) + " ELSE t END"
_analyzer("standard", analyzers.standard, TOKENS)
_analyzer("stop", analyzers.stop, f"list_filter({TOKENS}, lambda t: t NOT IN ('a', 'an', 'the', 'and', 'or', 'of', 'to', 'in', 'on', 'for', 'with', 'is', 'are', 'was', 'were'))")
_analyzer("stem", analyzers.stem, f"list_transform({TOKENS}, lambda t: {_STEM})")
_analyzer("nepali", analyzers.nepali, TOKENS)


def _cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places are counted before they are parted into tokens: these are twice as many, and there are few different places."""
    places = dealt(_table(spark, sf_dir, "documents"), "doc_id").select(F.explode_outer(analyzers.cjk_places(F.col("text"))).alias("place"))
    counted = places.filter("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("n"))
    return counted.select(F.explode_outer(analyzers.cjk_tokens(F.col("place"))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


# Each character but four blanks, and each two that stand side by side and are none of these.
_register("analyzer_cjk", _cjk, """WITH d AS (SELECT replace(replace(replace(lower(text), chr(9), ' '), chr(10), ' '), chr(13), ' ') AS t FROM documents),
k AS (SELECT unnest(string_split(t, '')) AS token FROM d UNION ALL SELECT unnest(list_transform(range(1, length(t)), lambda i: t[i:i + 1])) FROM d)
SELECT token, count(*) AS n FROM k WHERE token <> '' AND NOT contains(token, ' ') GROUP BY 1""")


def _nepali(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with their digits written in Devanagari, and a danda before each second word."""
    digits = F.translate(F.col("p_brand"), "0123456789", "०१२३४५६७८९")
    text = F.concat(F.regexp_replace("p_name", " ", "।"), F.lit(" "), digits)
    return _table(spark, sf_dir, "part").select("p_partkey", F.explode_outer(analyzers.nepali(text)).alias("token"))


_register("analyzer_nepali_digits", _nepali, "SELECT p_partkey, unnest(regexp_extract_all(lower(replace(p_name, ' ', '  ') || ' ' || p_brand), '[\\p{L}\\p{Nd}_\\-@.]+')) AS token FROM part")
_register("analyze_positions", lambda s, d: documents(s, d).analyze("text").filter("token = 'the'").select("doc_id", "pos"), f"SELECT doc_id, pos FROM (SELECT doc_id, unnest(t) AS token, (generate_subscripts(t, 1) - 1)::INT AS pos FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) WHERE token = 'the'")


def _synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir)
    c.schema.analyzers.synonym("from", "origin")
    return c.matching(q.Term("text", "origin")).select("doc_id")


_register("synonym_term", _synonyms, f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'from') OR list_contains({TOKENS}, 'origin')")
_register("grams", lambda s, d: _table(s, d, "part").select("p_partkey", F.explode(analyzers.grams(F.lower("p_brand"), 2, 3)).alias("gram")), "SELECT p_partkey, unnest(list_concat(list_transform(range(1, length(p_brand)), lambda i: lower(p_brand)[i:i + 1]), list_transform(range(1, length(p_brand) - 1), lambda i: lower(p_brand)[i:i + 2]))) AS gram FROM part")
_register("prefixes_suffixes", lambda s, d: _table(s, d, "part").select("p_partkey", F.explode(F.concat(analyzers.prefixes(F.lower("p_brand"), 1, 5), analyzers.suffixes(F.lower("p_brand")))).alias("x")), "SELECT p_partkey, unnest(list_concat(list_transform(range(1, least(length(p_brand), 5) + 1), lambda i: lower(p_brand)[:i]), list_transform(range(1, length(p_brand) + 1), lambda i: lower(p_brand)[i:]))) AS x FROM part")

# Helper structures.
_register("fst_complete", lambda s, d: parts_text(s, d).complete("p_name", "b", 20), "SELECT DISTINCT token AS term FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{Nd}_\\-@.]+')) AS token FROM part) WHERE starts_with(token, 'b') ORDER BY 1 LIMIT 20")


def parts_text(spark: SparkSession, sf_dir: str) -> Collection:
    df = _table(spark, sf_dir, "part")
    return Collection(df, of_frame(df, "p_partkey", text=("p_name",)))


_ids("radix_prefix", parts, q.Prefix("p_type", "standard"), "p_partkey", "SELECT p_partkey FROM part WHERE starts_with(lower(p_type), 'standard')")
_ids("reverse_suffix", parts, q.Suffix("p_type", "um"), "p_partkey", "SELECT p_partkey FROM part WHERE ends_with(lower(p_type), 'um')")
_register("perfect_hash", lambda s, d: structures.positions(_table(s, d, "nation").select("n_name"), "n_name", "n_name"), "SELECT n_name AS key, row_number() OVER (ORDER BY n_name) - 1 AS position FROM nation")


def _bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that the filter of one nation's keys lets through; what passes by chance goes by an exact look-up."""
    customer = _table(spark, sf_dir, "customer")
    wanted = customer.filter("c_nationkey = 3").select("c_custkey")
    bloom = structures.Bloom.sized(max(200_000, wanted.count()), 1e-9).of(wanted, "c_custkey")
    return bloom.keep(customer, "c_custkey").select("c_custkey").join(wanted, "c_custkey", "left_semi")


_register("bloom_filter", _bloom, "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
_register("bitmap_and_or", lambda s, d: structures.bitmap_count(structures.bitmap_and(structures.bitmap_of((o := _table(s, d, "orders")).filter("o_orderstatus = 'O'"), "o_orderkey"), structures.bitmap_or(structures.bitmap_of(o.filter("o_totalprice > 150000"), "o_orderkey"), structures.bitmap_of(o.filter("o_orderpriority = '1-URGENT'"), "o_orderkey")))), "SELECT count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice > 150000 OR o_orderpriority = '1-URGENT')")
_register("shard_set", lambda s, d: union_shards(*[(c := orders(s, d)).live.filter(structures.stable_shard(F.col("o_orderkey"), 3) == k).orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice") for k in range(3)], order=[F.col("o_totalprice").desc(), F.col("o_orderkey")], limit=15), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")

# Mutations.
_register("dedup_upsert", lambda s, d: mutations.latest(_table(s, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id"), "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
_register("upsert_batch", lambda s, d: mutations.upsert(mutations.latest((e := _table(s, d, "events").select("user_id", "event_id", "value")).filter("event_id % 3 <> 0"), "user_id", "event_id"), e.filter("event_id % 3 = 0"), "user_id", "event_id"), "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1")
_register("tombstones", lambda s, d: mutations.apply_changes((e := _table(s, d, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))).limit(0).drop("op"), e, "user_id", "event_id"), "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
_register("delete_ids", lambda s, d: mutations.delete(_table(s, d, "customer"), _table(s, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
TTL_NOW = 1_706_745_600


def _ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").withColumn("expires_at", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") + 30 * 86_400)
    return Collection(df, Schema((Field("expires_at", "int", ttl=True),), "event_id"), now=TTL_NOW).live.select("event_id")


_register("ttl_live", _ttl, f"SELECT event_id FROM events WHERE {TTL_NOW} <= floor(epoch(ts)) + 30 * 86400")
_register("unique_violations", lambda s, d: mutations.violations(_table(s, d, "part"), Schema((Field("p_brand", unique=True),), "p_partkey")), "SELECT 'p_brand' AS field, lower(p_brand) AS value, count(DISTINCT p_partkey) AS ids FROM part GROUP BY 2 HAVING count(DISTINCT p_partkey) > 1")
_register("append_only_first", lambda s, d: mutations.first_version(_table(s, d, "events").select("user_id", "event_id"), "user_id", "event_id"), "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change stream of ``events``, merged into a store below the shared folder, and what it holds then."""
    from .sources.store import Store
    from .streaming.changes import merge_stream, merged

    root = scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    changes = stream.select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    store = Store(spark, f"{root}/store")
    merge_stream(changes, store, f"{root}/progress", "user_id", "event_id").awaitTermination()
    return merged(store, "user_id", "event_id")


_register("stream_mutations", _stream, SQL["tombstones"])


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inference.describe(inference.infer(_table(spark, sf_dir, "orders"), "o_orderkey"))
    return spark.createDataFrame(found, "name string, kind string")


_register("infer_schema", _inferred, "SELECT * FROM (VALUES ('o_custkey', 'int'), ('o_orderstatus', 'keyword'), ('o_totalprice', 'float'), ('o_orderdate', 'time'), ('o_orderpriority', 'keyword')) AS t(name, kind)")

QUERIES.update(stored_queries.QUERIES)
SQL.update(stored_queries.SQL)
