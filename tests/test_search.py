"""Predicates, pages, facets, ranking and vectors over small tables with known answers."""

import math

import pytest

from findlight.operators.search import Collection, Request, Sort
from findlight.plans import parsers
from findlight.plans import query as q
from findlight.plans.schema import Field, Schema


def ids(c, tree):
    return sorted(r[c.schema.id] for r in c.matching(tree).collect())


@pytest.fixture(scope="module")
def people(spark):
    rows = [("1", "Mira Okafor", "mira@garden.example", "north", "active", 10.5, 2, "pot-1", None), ("2", "Leo Hartmann", "leo@post.example", "north", "inactive", 99.0, 1, "pot-2", None), ("3", "Lena Brook", "lena@garden.example", "south", "active", 50.0, 3, "pot-3", None)]
    df = spark.createDataFrame(rows, "id string, name string, email string, tenant string, status string, price double, rank int, sku string, expires_at double")
    schema = Schema((
        Field("name", "text", indexed=True, prefix=(1, 32), suffix=True, ngram=(2, 3), fuzzy=True), Field("email", prefix=(1, 32), suffix=True, ngram=(2, 4)), Field("tenant"), Field("status", facetable=True),
        Field("price", "float"), Field("rank", "int"), Field("sku", unique=True), Field("expires_at", "float", ttl=True),
    ))
    return Collection(df, schema)


@pytest.mark.parametrize(
    ("tree", "n"),
    [
        (q.Term("email", "mira@garden.example"), 1), (q.Prefix("name", "mi"), 1), (q.Suffix("email", "post.example"), 1), (q.Contains("email", "gard"), 2), (q.Fuzzy("name", "mirra", 1), 1),
        (q.Bool(must=(q.Prefix("name", "l"),), filter=(q.Term("tenant", "north"),), must_not=(q.Term("status", "inactive"),)), 0),
        (q.Bool(should=(q.Term("tenant", "north"), q.Term("tenant", "south")), min_should_match=1), 3),
        (q.Range("price", gte=10, lt=60), 2), (q.Terms("tenant", ("north", "missing")), 2), (q.Missing("email"), 0), (q.Exists("nothing"), 0), (q.Missing("nothing"), 3),
        (q.Term("price", "10.5"), 0), (q.Term("nothing", "x"), 0), (q.Term("tenant", ""), 0), (q.Prefix("tenant", "nor"), 0), (q.And(), 3), (q.Or(), 0), (q.Bool(), 3), (q.Bool(should=(q.MatchAll(),), min_should_match=2), 0),
        (q.Range("price", gte="no number"), 3), (q.Range("name", gte=1), 0), (q.Not(q.Term("expires_at", "1")), 3), (q.Term("name", " LEO HARTMANN "), 1), (q.Contains("email", "e"), 0),
    ],
)
def test_predicates(people, tree, n):
    assert len(ids(people, tree)) == n == people.count(tree)


def test_sort_facets_pages_and_analysis(people):
    got = people.search(Request(q.MatchAll(), sort=(Sort("price", desc=True),), facets=("status",), limit=2))
    assert [r.id for r in got.hits.collect()] == ["2", "3"] and got.total == 3
    assert [tuple(r) for r in got.facets["status"].collect()] == [("active", 2), ("inactive", 1)]
    assert [r.id for r in people.search(Request(None, limit=5, offset=2)).hits.collect()] == ["3"]
    assert [r.token for r in people.analyze("name").filter("id = '1'").orderBy("pos").collect()] == ["mira", "okafor"]
    assert people.search(Request(None, with_docs=False)).hits.columns == ["id", "score"]
    assert people.profile(q.MatchAll())["matches"] == 3 and people.stats().first().live == 3


def test_expiry(people, spark):
    more = spark.createDataFrame([("9", 100.0), ("8", 300.0), ("7", 0.0), ("6", None)], "id string, expires_at double")
    c = Collection(people.df.unionByName(more, allowMissingColumns=True), people.schema, now=200.0)
    assert ids(c, q.MatchAll()) == ["1", "2", "3", "6", "7", "8"]


@pytest.fixture(scope="module")
def advanced(spark):
    rows = [("1", "green growing garden market", "10.0.0.10", "north.garden.example", "Mira@Garden.EXAMPLE", "+49 555-010", "HTTPS://Garden.EXAMPLE/A", [1.0, 0.0, 0.0]), ("2", "old bridge crossing", "192.168.1.1", "test.local", None, None, None, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, title string, ip string, domain string, email string, phone string, url string, vec array<double>")
    return Collection(df, Schema((Field("title", "text", analyzer="stem", prefix=(1, 20), ngram=(2, 3)), Field("ip"), Field("domain"), Field("email"), Field("phone"), Field("url"), Field("vec", "vector", dim=3))))


@pytest.mark.parametrize("tree", [q.Phrase("title", "growing garden"), q.Proximity("title", ("green", "market"), 3, True), q.Cidr("ip", "10.0.0.0/24"), q.DomainWildcard("domain", "*.garden.example"), q.Term("email", "mira@garden.example"), q.Term("phone", "+49555010"), q.Term("url", "https://garden.example/A"), q.Vector("vec", (1.0, 0.0, 0.0), 1)])
def test_advanced(advanced, tree):
    assert ids(advanced, tree) == ["1"]


def test_advanced_misses(advanced):
    for tree in (q.Phrase("title", "garden growing"), q.Cidr("ip", "no"), q.Cidr("domain", "10.0.0.0/8"), q.DomainWildcard("domain", "den.example"), q.Proximity("title", ("green", "market"), 1, True)):
        assert ids(advanced, tree) == []
    assert "<mark>garden</mark>" in advanced.highlight(q.Term("ip", "10.0.0.10"), "title", "garden", 20).first().highlight


def test_the_greedy_phrase_rule(spark):
    df = spark.createDataFrame([(1, "a b x b x c"), (2, "a b b x c"), (3, "a x b c"), (4, "a b")], "id int, body string")
    c = Collection(df, Schema((Field("body", "text", phrase=True),)))
    assert ids(c, q.Phrase("body", "a b c", 2)) == [2, 3]


def test_columns_named_like_scores(spark):
    df = spark.createDataFrame([(1, "oak", 5.0), (2, "elm", 6.0)], "id int, body string, score double")
    c = Collection(df, Schema((Field("body", "text", fuzzy=True),)))
    for tree in (q.MatchAll(), q.GlobalTerm(("oak",), True)):
        hits = c.search(Request(tree)).hits
        assert hits.columns == ["id", "body", "score", "_score"] and hits.first().score == 5.0


def test_tokens_one_edit_away_are_terms_of_their_own(spark):
    df = spark.createDataFrame([(1, "form"), (2, "farm farm x"), (3, "foam farm"), (4, "other")], "id int, body string")
    c = Collection(df, Schema((Field("body", "text", fuzzy=True),)))
    got = {r.id: r.score for r in c.search(Request(q.GlobalTerm(("form",), True))).hits.collect()}
    n, avgdl = 4, (1 + 3 + 2 + 1) / 4
    weigh = lambda tf, df, dl: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    want = {1: weigh(1, 1, 1), 2: 0.8 * weigh(2, 2, 3), 3: 0.8 * (weigh(1, 1, 2) + weigh(1, 2, 2))}
    assert got == pytest.approx(want)


def test_stop_words_and_pairs_of_characters():
    from findlight.functions.analyzers import literal_tokens

    assert literal_tokens("It was to be with them, as were we", "stop") == ["it", "be", "them", "as", "we"]
    assert literal_tokens("a b\u3000c", "cjk") == ["a", "b", "b\u3000", "\u3000", "\u3000c", "c"]


def test_synonyms(spark):
    c = Collection(spark.createDataFrame([(1, "brisk walk")], "id int, body string"), Schema((Field("body", "text"),)))
    c.schema.analyzers.synonym("brisk", "swift")
    assert ids(c, q.Term("body", "swift")) == [1]


def test_multi_valued(spark):
    df = spark.createDataFrame([(1, ["red wine", "blue sea"]), (2, ["wine blue"]), (3, None)], "id int, tags array<string>")
    c = Collection(df, Schema((Field("tags", "keyword", indexed=True, multi=True, prefix=(1, 9)),)))
    assert ids(c, q.Term("tags", "red wine")) == [1] and ids(c, q.Term("tags", "blue")) == [1, 2]
    assert ids(c, q.Phrase("tags", "wine blue")) == [2] and ids(c, q.Phrase("tags", "wine blue", 1)) == [2]
    assert [r.value for r in c.facet(None, "tags").collect()] == ["red wine", "wine blue"]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 5.0), ("b", [0.0, 1.0], 15.0), ("c", [2.0, 0.0], 25.0), ("d", [1.0], 1.0), ("e", None, 1.0)], "id string, vec array<double>, price double")
    c = Collection(df, Schema((Field("vec", "vector", dim=2), Field("price", "float"))))
    top = lambda *a, **k: [(r.id, r.score) for r in c.search(Request(q.Vector("vec", *a, **k))).hits.collect()]
    assert [i for i, _ in top((1.0, 0.0), 10)] == ["a", "c", "b"]
    assert top((1.0, 0.0), 1, "dot") == [("c", 2.0)] and top((0.0, 1.0), 1, "l2") == [("b", 0.0)]
    assert [i for i, _ in top((0.0, 1.0), 10, "cosine", q.Range("price", gte=10, lte=20))] == ["b"]
    assert top((1.0,), 3) == []


@pytest.fixture(scope="module")
def urls(spark):
    df = spark.createDataFrame([("a", "Oak table", 0.0), ("b", "Elm table", 37.0), ("c", "Birch stool", 99.0), ("d", None, None)], "id string, name string, amount double")
    return Collection(df, Schema((Field("name", indexed=True), Field("amount", "float"))))


@pytest.mark.parametrize(
    ("raw", "n"),
    [
        ("name__eq=Oak+table", 1), ("name__ne=Oak+table", 3), ("name__contains=table", 2), ("name__not_contains=table", 2), ("name__starts_with=elm", 1), ("name__ends_with=stool", 1), ("name__fuzzy=Birch+stoil", 1),
        ("name__in=Oak+table%2CBirch+stool", 2), ("name__not_in=Oak+table%2CBirch+stool", 2), ("name__exists=", 3), ("name__missing=", 1), ("amount__not_zero=", 2), ("amount__gt=37", 1), ("amount__gte=37", 2), ("amount__lt=37", 1), ("amount__lte=37", 2), ("amount__between=30%2C40", 1), ("limit=1&offset=2", 4), ("name=", 4),
    ],
)
def test_url_filters(urls, raw, n):
    assert len(ids(urls, parsers.url_filter(raw, urls.schema))) == n


@pytest.mark.parametrize("raw", ["other=1", "amount__gt=x", "amount__contains=1", "name__gt=1", "amount__between=1", "name__what=1"])
def test_url_filters_that_raise(urls, raw):
    with pytest.raises(ValueError, match="."):
        parsers.url_filter(raw, urls.schema)


def test_global_terms_and_bm25(spark):
    df = spark.createDataFrame([("a", "Mend oak chair", "20417", 37), ("b", "Mend oak chair", "20417", 99), ("c", "Shop visit", "OAK-CODE", 37)], "id string, description string, code string, shelf int")
    schema = Schema((Field("description", "text", fuzzy=True), Field("code", indexed=False), Field("shelf", "int")))
    c = Collection(df, schema)
    n = lambda raw: len(ids(c, parsers.url_filter(raw, schema)))
    assert (n("term=oak"), n("term=oak+mend"), n("term=oak&shelf=37"), n("term=oac&fuzzy=true")) == (2, 2, 1, 2)
    body = spark.createDataFrame([("sparse", "oak among many other words in a far longer note about a workshop"), ("dense", "oak oak oak mend")], "id string, body string")
    hits = Collection(body, Schema((Field("body", "text"),))).search(Request(q.GlobalTerm(("oak",)))).hits.collect()
    assert [r.id for r in hits] == ["dense", "sparse"] and hits[0].score > hits[1].score > 0


def test_whole_value_patterns(spark):
    df = spark.createDataFrame([("match", 37, "OAK-MEND"), ("wrong", 99, "OAK-MELT")], "id string, shelf int, code string")
    c = Collection(df, Schema((Field("shelf", "int"), Field("code"))))
    for raw in ("code__contains=oak", "code__starts_with=oa", "code__ends_with=mend", "code__fuzzy=oak-mend"):
        assert ids(c, parsers.url_filter("shelf=37&" + raw, c.schema)) == ["match"]


def test_simple_syntax_and_wire():
    assert parsers.simple("f", "") == q.MatchAll() and parsers.simple("f", "a b") == q.And((q.Term("f", "a"), q.Term("f", "b")))
    assert parsers.simple("f", "+a -b c* *d e~2") == q.Bool(must=(q.Term("f", "a"),), should=(q.Prefix("f", "c"), q.Suffix("f", "d"), q.Fuzzy("f", "e", 2)), must_not=(q.Term("f", "b"),))
    assert parsers.wire({"type": "and", "must": [{"type": "in", "field": "a", "values": [1]}, {"type": "not", "query": {"type": "exists", "field": "b"}}]}) == q.And((q.Terms("a", (1,)), q.Not(q.Exists("b"))))
    with pytest.raises(ValueError, match="unknown"):
        parsers.wire({"type": "wat"})
    assert parsers.lookup("term=a+b&group_id=4&date_key=2026-01-01") == q.TupleLookup("a b", 4, "2026-01-01")
    assert parsers.lookup("term=a&group_id=0") == q.Bool(filter=(q.Term("term", "a"), q.Term("group_id", "0")))


def test_tuple_lookup(spark):
    df = spark.createDataFrame([("1", "key-special", "4", "2026-01-01"), ("2", "key-special", "5", "2026-01-01"), ("3", "ab9", "4", "2026-01-02")], "id string, term string, group_id string, date_key string")
    c = Collection(df, Schema((Field("term"), Field("group_id"), Field("date_key"))))
    assert ids(c, parsers.lookup("term=key-special&group_id=4&date_key=2026-01-01")) == ["1"]
    assert ids(c, q.TupleLookup("key-special", 0, "2026-01-01")) == []


def test_filters_reach_the_scan(spark, sf):
    """A range on a column is pushed down, and a count reads only the columns that it tests."""
    from findlight.queries import lineitems

    plan = lineitems(spark, sf).matching(q.And((q.Range("l_quantity", gt=30), q.Range("l_discount", gte=0.05)))).select("l_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "l_comment" not in plan and "l_shipdate" not in plan.split("ReadSchema")[-1]


def test_normalised_columns_reach_the_scan(spark, sf, tmp_path):
    from findlight.operators import layout
    from findlight.queries import orders

    c = orders(spark, sf)
    df, schema = layout.normalized(c.df, c.schema)
    layout.write(df, str(tmp_path / "t"), sort_by=("o_custkey",), bloom=("o_orderpriority__norm",), files=2)
    stored = Collection(spark.read.parquet(str(tmp_path / "t")), schema)
    tree = q.And((q.Term("o_orderpriority", "1-urgent"), q.Prefix("o_orderstatus", "f"), q.Not(q.Term("o_orderstatus", "x"))))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = stored.matching(tree)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderpriority__norm,1-urgent)" in plan and "StringStartsWith(o_orderstatus__norm,f)" in plan
    assert sorted(r.o_orderkey for r in stored.matching(tree).collect()) == sorted(r.o_orderkey for r in c.matching(tree).collect())


def test_fuzzy_looks_elsewhere_where_nothing_begins_so(spark):
    df = spark.createDataFrame([(1, "oak table"), (2, "elm stool")], "id int, body string")
    c = Collection(df, Schema((Field("body", "text", fuzzy=True),)))
    assert ids(c, q.Fuzzy("body", "bable", 2)) == [1] and ids(c, q.Fuzzy("body", "bable", 1)) == []
    # A token begins with s, so only such are looked at.
    assert ids(c, q.Fuzzy("body", "sable", 2)) == []


def test_signatures_find_nine_in_ten_neighbours(spark):
    from findlight.operators import vector

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    coded, hit = vector.with_codes(rows, "embedding", 64).cache(), 0
    probes = rows.filter("vec_id % 100 = 0").collect()
    for probe in probes:
        want = {r.vec_id for r in vector.top_k(rows, "embedding", probe.embedding, 10, tie="vec_id").collect()}
        hit += len(want & {r.vec_id for r in vector.coded_top_k(coded, "vec_id", "embedding", probe.embedding, 10, candidates=150).collect()})
    coded.unpersist()
    assert len(probes) == 20 and coded.count() == 2000 and hit >= 0.9 * 200


def test_stored_tokens_rank_as_searches_do(spark, tmp_path):
    from findlight.operators import postings

    rows = [(1, "oak elm oak", "elm"), (2, "elm", "Oak"), (3, None, "oak"), (4, "oak " * 9 + "elm", None), (5, "", "")]
    df = spark.createDataFrame(rows, "id int, body string, tag string")
    schema = Schema((Field("body", "text", lookup=False), Field("tag")))
    postings.save(df, schema, str(tmp_path))
    for words in (("oak",), ("oak", "elm"), ("oak", "oak"), ("none",)):
        want = {r.id: r.score for r in Collection(df, schema).search(Request(q.GlobalTerm(words))).hits.collect()}
        assert {r.id: r.score for r in postings.bm25(spark, str(tmp_path), words).collect()} == pytest.approx(want)
    assert [r.id for r in postings.bm25(spark, str(tmp_path), ("oak",), 1).collect()] == [max(want := {r.id: r.score for r in postings.bm25(spark, str(tmp_path), ("oak",)).collect()}, key=want.get)]


def test_cjk_places_hold_what_the_analyzer_gives(spark):
    """One string a place, by one regular expression: half as many as tokens. Blanks, line ends and characters beyond 16 bits."""
    from collections import Counter

    from pyspark.sql import functions as F

    from findlight.functions import analyzers

    texts = ["ab c", "", None, "\U0001d49c\U0001f600 日本\t語\r\n", "　X", "É b", "a" * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = df.select("t", analyzers.cjk(F.col("t")).alias("all"), analyzers.cjk_places(F.col("t")).alias("places")).collect()
    want = {t: None if t is None else analyzers.literal_tokens(t, "cjk") for t in texts}
    assert {r.t: r.all for r in rows} == want
    for r in rows:
        assert r.t is None or len(r.places) == len([c for c in r.t if c not in analyzers.CJK_BLANKS])
    placed = df.select(F.explode(analyzers.cjk_places(F.col("t"))).alias("p"))
    assert Counter(x for r in placed.select(analyzers.cjk_tokens(F.col("p")).alias("x")).collect() for x in r.x) == Counter(x for w in want.values() for x in w or ())


def test_token_lists_are_made_slice_by_slice(spark):
    """Whatever is counted at once, no occurrence is lost; nulls have no tokens, and nothing is shuffled for it."""
    from pyspark.sql import functions as F

    from findlight.operators import postings

    rows = [(f"r{i}", None if i % 7 == 0 else [f"t{k % (i % 5 + 1)}" for k in range(i % 11)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, t array<string>").coalesce(1)
    want = sorted((t, i, ts.count(t), len(ts)) for i, ts in rows if ts for t in set(ts))
    for at_once in (1, 13, 10_000):
        made = postings.lists(df, at_once)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        got = made.select("token", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("token", "p.*").collect()
        assert sorted(map(tuple, got)) == want
    assert made.count() == made.select("token").distinct().count() == 5
