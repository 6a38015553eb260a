"""Sources, inference, SQL texts, stored generations, loads, catalog and change streams."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from findlight import catalog as cat
from findlight.functions import structures
from findlight.operators import mutations
from findlight.operators.search import Collection, Request
from findlight.plans import query as q
from findlight.plans.parsers import simple
from findlight.plans.schema import Field, Schema
from findlight.sources import bulk, infer, readers, sql
from findlight.sources.store import ChangeLog, Checkpoint, Store
from findlight.streaming.changes import fold, merge_stream, merged, pending

CHARGES = """id,ld,cpt_code,effective_date,charge_amt,is_active
1,"Office or other outpatient visit, established patient",99213,2024-01-02T00:00:00Z,125.50,true
2,Comprehensive metabolic panel,80053,2024-02-15T00:00:00Z,42.00,true
3,"Chest x-ray, two views",71046,2024-03-01T00:00:00Z,88.25,false
"""


def test_csv_inference_and_search(spark, tmp_path):
    (tmp_path / "c.csv").write_text(CHARGES)
    made = cat.Catalog(spark).reload_source("charges", {"type": "CSV", "path": str(tmp_path / "c.csv")})
    assert dict(infer.describe(made.schema)) == {"ld": "text", "cpt_code": "keyword", "effective_date": "time", "charge_amt": "float", "is_active": "keyword"}
    assert made.schema.get("cpt_code").prefix == (3, 5)
    assert made.count(q.Term("cpt_code", "99213")) == 1 and made.count(simple("ld", "metabolic panel")) == 1
    assert made.count(q.Range("charge_amt", gt=50)) == 2 and made.count(q.Range("effective_date", gte="2024-02-01")) == 2


def test_jsonl_and_times(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"ID": 7, "when": "2024-01-02 03:04:05", "n": ""}\n{"ID": 8, "when": "1704164645"}\n')
    df = readers.jsonl(spark, str(tmp_path / "r.jsonl"), {"id": "id", "t": "WHEN", "n": "n"}, id="ID")
    got = {r.id: r for r in df.withColumn("t", F.unix_seconds(readers.parse_time(F.col("t")))).collect()}
    assert got["7"].t == got["8"].t == 1704164645 and got["7"].n is None
    with pytest.raises(ValueError, match="no column"):
        readers.jsonl(spark, str(tmp_path / "r.jsonl"), ["nope"])


def test_registry(spark, tmp_path):
    made = readers.default_registry()
    assert set(made.kinds()) >= {"sql_table", "sql_view", "sql_query", "sql_file", "csv", "jsonl", "parquet", "http"}
    readers.records(spark, 300).createOrReplaceTempView("recs")
    (tmp_path / "q.sql").write_text("SELECT * FROM recs WHERE group_id = '${group}'")
    assert made.open(spark, {"type": "sql_file", "path": str(tmp_path / "q.sql")}, group=4).count() == 19
    assert made.open(spark, {"type": "SQL_TABLE", "table": "recs", "columns": ["ID", "term"]}).columns == ["ID", "term"]
    with pytest.raises(ValueError, match="no value"):
        made.open(spark, {"type": "sql_query", "query": "SELECT ${x}"})
    with pytest.raises(ValueError, match="unknown source"):
        made.open(spark, {"type": "nope"})


def test_http_source(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            page = int(self.path.split("page=")[1].split("&")[0]) if "page=" in self.path else 1
            rows = [{"id": f"{page}-{i}", "n": i + 0.5, "ok": True} for i in range(3)] if page <= 3 and self.headers["Authorization"] == "Bearer t" else []
            body = json.dumps({"results": rows}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = {"type": "http", "url": f"http://127.0.0.1:{server.server_port}/x", "token": "t"}
    try:
        assert readers.default_registry().open(spark, config, page_param="page").count() == 9
        assert readers.default_registry().open(spark, config).select("n").agg(F.sum("n")).first()[0] == 4.5
    finally:
        server.shutdown()


@pytest.mark.parametrize(("name", "values", "kind"), [("n", ["1", "0"], "int"), ("ok", ["true", "False"], "keyword"), ("x", ["1.5", "2"], "float"), ("when", ["2024-01-02"], "time"), ("sku", ["12", "13"], "keyword"), ("notes", ["1"], "text"), ("c", ["ab", "cd"], "keyword"), ("c", ["some words in a row", "and more of them"], "text"), ("e", [], "keyword")])
def test_heuristics(name, values, kind):
    assert infer.of_values(name, values).kind == kind


def test_sql_texts():
    assert sql.tuple_query("record_lookup", 4, "2026-01-01") == ("SELECT id, term, group_id, date_key FROM record_lookup WHERE group_id = $1 AND date_key = $2 ORDER BY id ASC LIMIT 1000", [4, "2026-01-01"])
    text, args = sql.tuple_page("record_lookup", 12, 100)
    assert "partition_id = $1" in text and "id > $2" in text and "LIMIT 1000" in text and args == [12, 100]
    text, args = sql.incremental_page("SELECT * FROM t where a = 1", "2026", 5, 10, dialect="oracle")
    assert text.endswith("where a = 1 AND (updated_at > :p1 OR (updated_at = :p2 AND id > :p3)) ORDER BY updated_at, id LIMIT 10") and args == ["2026", "2026", 5]
    with pytest.raises(ValueError, match="table"):
        sql.Select("").build()


def test_generations(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path / "s")), Schema((Field("v", unique=True),))
    with pytest.raises(FileNotFoundError):
        store.read()
    for n in range(3):
        store.save(spark.createDataFrame([(str(i), f"v{i}") for i in range(n + 2)], "id string, v string"), sort_by=("id",))
    assert store.generations() == [3, 2, 1] and store.current() == 3 and store.read().count() == 4 and store.validate(schema) == []
    assert store.compact(2) == [1] and store.generations() == [3, 2]
    store.save(spark.createDataFrame([("1", "a"), ("1", "A"), (None, "b"), ("2", "a")], "id string, v string"))
    assert set(store.validate(schema)) == {"a row has no id", "an id is repeated", "a unique value is repeated"}
    store.repair(schema)
    assert store.read().count() == 2
    part = next((tmp_path / "s" / f"gen={store.current()}").glob("part-*"))
    spark.createDataFrame([("7", "x")], "id string, v string").coalesce(1).write.parquet(str(tmp_path / "other"))
    part.write_bytes(next((tmp_path / "other").glob("part-*")).read_bytes())
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert store.validate()


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("1", 5), ("2", 6)], "id string, n long"))
    (tmp_path / "log" / "part-bad.json").write_text('{"body": "{}", "crc": 1}\nnot json\n')
    schema = "id string, n long"
    assert sorted(map(tuple, log.read(schema).collect())) == [("1", 5), ("2", 6)]
    with pytest.raises(ValueError, match="damaged"):
        log.read(schema, strict=True)


def test_loads(spark, tmp_path):
    store, progress, schema = Store(spark, str(tmp_path / "s")), Checkpoint(spark, str(tmp_path / "c")), Schema((Field("vec", "vector", dim=2),))
    rows = [(str(i % 7), i, [1.0, 2.0]) for i in range(20)] + [(None, 20, None), ("x", 21, [1.0]), ("y", 22, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id string, seq long, vec array<double>")
    stats = bulk.load(df, store, schema, "seq", progress)
    assert stats.seen == 23 and store.read().count() == 7 and progress.load("load") == {"seq": 22}
    more = spark.createDataFrame([("0", 3, None), ("new", 30, None)], df.schema)
    bulk.load(more, store, schema, "seq", progress)
    assert store.read().count() == 8 and {r.seq for r in store.read().filter("id = '0'").collect()} == {14}
    with pytest.raises(bulk.MissingId):
        bulk.load(df, Store(spark, str(tmp_path / "t")), schema, skip_bad=False)


def test_incremental(spark, tmp_path):
    store, progress, schema = Store(spark, str(tmp_path / "s")), Checkpoint(spark, str(tmp_path / "c")), Schema((Field("v"),))
    at = lambda rows: spark.createDataFrame(rows, "id long, updated_at long, v string")
    assert bulk.incremental(at([(1, 10, "a"), (2, 10, "b")]), store, schema, progress) == 2
    assert bulk.incremental(at([(1, 10, "late"), (3, 10, "c"), (1, 11, "d")]), store, schema, progress) == 2
    assert {(r.id, r.v) for r in store.read().collect()} == {(1, "d"), (2, "b"), (3, "c")}
    assert bulk.incremental(at([(1, 11, "d")]), store, schema, progress) == 0


def test_partitions(spark):
    df = bulk.partitioned(readers.records(spark, 3000).withColumn("id", F.col("id").cast("int")), 1000, "id")
    assert {r.part for r in df.select("part").distinct().collect()} == {"p-p000000", "p-p000001", "p-p000002"}
    assert cat.recommended_partitions(12_000_001) == 3 and cat.deployment(1_000_000, low_memory=True).partitions == 4
    scheme = cat.Scheme("base")
    assert scheme.name(18, "2026-03-09", 17) == "base-wi02-202603-fac01"
    assert cat.route({"base-wi02-202603-fac01"}, scheme, 18, "2026-03-09", 17) != "base" == cat.route(set(), scheme, 18, "2026-03-09")


def test_schemes_and_their_manifests(spark, tmp_path):
    assert cat.Scheme("b", 0, 0, False).name(18, "2026-03-09", 17) == "b-wi18" and cat.Scheme("", 4, 0).name(5, "soon") == "lookup-wi01"
    rows = readers.records(spark, 400).selectExpr("id", "CAST(group_id AS INT) AS g", "date_key")
    scheme = cat.Scheme("b", 4, 0)
    made = rows.withColumns(scheme.columns(F.col("g"), F.col("date_key"), F.col("g")))
    assert made.columns == ["id", "g", "date_key", "wi", "month"]
    cat.Dataset.of(scheme, made).save(spark, str(tmp_path))
    got = cat.Dataset.load(spark, str(tmp_path))
    assert got.scheme == scheme and got.partitions == [{"wi": k, "month": "202601", "rows": 100} for k in range(4)]
    assert scheme.prune(made, 7, "2026-01-30").count() == 100
    with pytest.raises(FileNotFoundError):
        cat.Dataset.load(spark, str(tmp_path), "none.json")


def test_catalog_swaps_restores_and_tasks(spark, tmp_path):
    made, schema = cat.Catalog(spark, str(tmp_path)), Schema((Field("v"),))
    df = spark.createDataFrame([("1", "a")], "id string, v string")
    made.add("one", df, schema)
    with pytest.raises(ValueError, match="already"):
        made.add("one", df, schema)

    def fail():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        made.reload("one", fail, schema)
    assert made.generation("one") == 1 and made.get("one").count(None) == 1
    made.reload("one", lambda: df.union(df.selectExpr("'2'", "'b'")), schema)
    assert made.generation("one") == 2 and made.get("one").count(None) == 2
    again = cat.Catalog(spark, str(tmp_path))
    assert again.restore() == ["one"] and again.get("one").count(q.Term("v", "b")) == 1
    tasks = cat.Tasks(again)
    assert tasks.wait(tasks.start("two", lambda: df, schema).id, 60).status == "done" and again.list() == ["one", "two"]
    assert tasks.wait(tasks.start("two", fail, schema).id, 60).status == "failed"
    slow = tasks.start("three", lambda: (time.sleep(1), df)[1], schema)
    tasks.cancel(slow.id)
    assert tasks.wait(slow.id, 60).status == "cancelled"
    assert [r.id for r in again.search_all(["one", "two"], Request(None, limit=3)).collect()] == ["1", "1", "2"]
    again.remove("two")
    with pytest.raises(KeyError):
        again.get("two")


def test_config(spark, tmp_path):
    (tmp_path / "c.csv").write_text(CHARGES)
    config = {"datasources": {"d": {"type": "csv", "path": str(tmp_path / "c.csv")}}, "indexes": {"x": {"datasource": "d", "fields": [{"name": "cpt_code", "kind": "int"}]}}}
    made = cat.Catalog.from_config(spark, json.dumps(config))
    assert made.get("x").schema.get("cpt_code").kind == "int" and made.get("x").count(q.Range("cpt_code", gt=80_000)) == 2
    with pytest.raises(ValueError, match="no datasource"):
        cat.Catalog.from_config(spark, {"indexes": {"x": {"datasource": "nope"}}})


def test_mutations(spark):
    schema = Schema((Field("sku", unique=True), Field("vec", "vector", dim=2)))
    df = spark.createDataFrame([("1", "S-1", 1, [1.0, 0.0]), ("2", "s-2", 1, None)], "id string, sku string, seq int, vec array<double>")
    more = spark.createDataFrame([("2", "s-1", 2, [1.0, 1.0]), ("3", "s-3", 2, [1.0]), (None, "s-4", 2, None)], df.schema)
    good, bad = mutations.split_valid(more, schema)
    assert {r.sku for r in bad.collect()} == {"s-3", "s-4"}
    after = mutations.upsert(df, good, "id", "seq")
    assert after.count() == 2
    with pytest.raises(mutations.ConstraintError, match="s-1"):
        mutations.require_unique(after, schema)
    assert mutations.require_unique(df, schema) is df
    gone = mutations.delete(df, spark.createDataFrame([("1",), ("77",)], "id string"), "id")
    assert [r.id for r in gone.collect()] == ["2"] and Collection(gone, schema).get("1").count() == 0


def test_change_stream(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    schema = "id string, seq long, v string, op string"
    run = lambda every=16: merge_stream(spark.readStream.schema(schema).json(source), store, str(tmp_path / "p"), "id", "seq", every=every).awaitTermination()
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    now = lambda: {(r.id, r.v) for r in merged(store, "id", "seq").collect()}
    put(("a", 1, "x", "upsert"), ("b", 1, "y", "upsert"), ("a", 3, "z", "upsert"), (None, 4, "n", "upsert"))
    run()
    assert now() == {("a", "z"), ("b", "y")} and store.current() is None
    put(("a", 2, "late", "upsert"), ("b", 5, None, "delete"), ("c", 1, "w", "upsert"))
    run(2)
    assert now() == {("a", "z"), ("c", "w")} and store.current() == 1 and pending(store) == []
    put(("c", 0, "late", "upsert"), ("a", 4, "q", "upsert"))
    run()
    assert now() == {("a", "q"), ("c", "w")} and store.current() == 1 and len(pending(store)) == 1
    fold(store, "id", "seq")
    assert {(r.id, r.v) for r in store.read().collect()} == now() and pending(store) == []


def test_structures(spark):
    df = spark.range(0, 2000)
    bloom = structures.Bloom.sized(1000).of(df.filter("id < 1000"), "id")
    assert bloom.keep(df.filter("id < 1000"), "id").count() == 1000
    assert bloom.keep(df.filter("id >= 1000"), "id").count() < 50
    placed = structures.positions(df.select((F.col("id") * 7 % 2000).alias("k")), "k", "k")
    assert all(r.key == r.position for r in placed.collect()) and placed.count() == 2000
    shards = df.groupBy(structures.stable_shard(F.col("id"), 4).alias("s")).count().collect()
    assert {r.s for r in shards} == {0, 1, 2, 3} and min(r["count"] for r in shards) > 400


def test_command_line(spark, tmp_path, capsys):
    from findlight.__main__ import main

    (tmp_path / "c.csv").write_text(CHARGES)
    assert main(["search", str(tmp_path / "c.csv"), "charge_amt__gt=50", "--type", "csv"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"total": 2}
    cat.Catalog(spark, str(tmp_path / "store")).reload_source("one", {"type": "csv", "path": str(tmp_path / "c.csv")})
    assert main(["restore-search", str(tmp_path / "store"), "one", '{"type": "term", "field": "cpt_code", "value": "99213"}']) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"total": 1}
    root = str(tmp_path / "store" / "one")
    assert main(["generations", root]) == 0 and main(["validate", root]) == 0 and main(["compact", root]) == 0 and main(["repair", root]) == 0
    assert main(["plan", "12000000"]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["partitions"] == 3


def test_a_small_batch_does_not_move_the_table(spark):
    table = spark.range(0, 5000).selectExpr("id", "1L AS seq", "'old' AS v")
    after = mutations.upsert(table, spark.createDataFrame([(7, 2, "new"), (7, 3, "newer"), (9000, 1, "more"), (8, 0, "late"), (None, 9, "none")], "id long, seq long, v string"), "id", "seq")
    got = {r.id: r.v for r in after.collect()}
    assert len(got) == after.count() == 5001 and (got[7], got[8], got[9000]) == ("newer", "old", "more")
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_damage_is_found_and_changes_are_replayed(spark, tmp_path):
    store, log = Store(spark, str(tmp_path / "s")), ChangeLog(spark, str(tmp_path / "log"))
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, seq long, v string")
    store.save(df.repartition(2))
    log.append(spark.createDataFrame([(2, 2, None, "delete"), (3, 2, "c", "upsert"), (1, 3, "d", "upsert")], "id long, seq long, v string, op string"))
    assert sorted((r.id, r.v) for r in store.replayed(log, "id", "seq").collect()) == [(1, "d"), (3, "c")]
    assert store.validate() == [] and store.save(df, partition_by=("v",)).files.keys() and store.validate() == []
    part = next((tmp_path / "s" / "gen=2").rglob("part-*"))
    part.write_bytes(part.read_bytes()[:-1])
    assert "files differ" in store.validate()[0] and store.validate(generation=1) == []
    assert store.files.claim("claims/9") and not store.files.claim("claims/9")


def test_a_database_is_read_over_jdbc(spark):
    """An embedded database in this process, written and read, whole, by ranges of a key and by predicates."""
    url = "jdbc:derby:memory:findlight;create=true"
    rows = spark.range(0, 100).selectExpr("CAST(id AS INT) AS ID", "concat('k', id % 7) AS NAME", "id / 4.0D AS PRICE")
    rows.write.format("jdbc").options(url=url, dbtable="GOODS", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="NAME VARCHAR(20)").mode("overwrite").save()
    drive = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    want = sorted(tuple(r) for r in rows.collect())
    whole = readers.jdbc(spark, url, table="GOODS", **drive)
    ranged = readers.jdbc(spark, url, table="GOODS", key="ID", bounds=(0, 100), partitions=4, **drive)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in ranged.collect()) == want and ranged.rdd.getNumPartitions() == 4
    some = readers.jdbc(spark, url, query="SELECT ID, NAME FROM GOODS WHERE PRICE < 10", columns={"id": "ID", "name": "NAME"}, **drive)
    assert some.columns == ["id", "name"] and some.count() == 40
    opened = readers.default_registry().open(spark, {"type": "sql_query", "url": url, "query": "SELECT ID FROM GOODS WHERE NAME = '${name}'", "options": drive}, name="k3")
    assert sorted(r.ID for r in opened.collect()) == [i for i in range(100) if i % 7 == 3]
    parts = readers.jdbc(spark, url, table="GOODS", predicates=["ID < 50", "ID >= 50"], **drive)
    assert parts.count() == 100 and parts.rdd.getNumPartitions() == 2


def test_a_bloom_filter_takes_any_hash(spark):
    """Many keys: some of their hashes lie near the ends of the longs, where sums overflow. Several blocks, and no key twice."""
    df = spark.range(0, 3_000_000)
    bloom = structures.Bloom.sized(20_000, 1e-9).of(df.filter("id % 150 = 3"), "id")
    assert bloom.blocks > 1 and bloom.table.count() == bloom.blocks
    kept = bloom.keep(df.unionByName(spark.createDataFrame([(None,)], "id long")), "id").agg(F.count("*"), F.count_if(F.col("id") % 150 == 3)).first()
    assert tuple(kept) == (20_000, 20_000)


def test_a_large_bloom_filter_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(structures, "BROADCAST_BITS", 0)
    df = spark.range(0, 2000)
    kept = structures.Bloom.sized(1000, 1e-6).of(df.filter("id < 1000"), "id").keep(df, "id")
    assert "NestedLoop" not in kept._jdf.queryExecution().toString() and sorted(r.id for r in kept.collect()) == list(range(1000))
