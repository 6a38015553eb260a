import zlib

import pytest

from findlight.llm import virtual_slots as vs


def test_all_rows_get_a_gapless_place_and_near_equal_shards(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = vs.op10_virtual_slots(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    load = [0] * 8
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r.shard] += r.size
    for s in range(8):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))
    assert max(load) - min(load) <= max(r.size for r in got)


def test_edges(spark):
    rows = [(None, "x"), (None, None), (5, "é"), (5, "é"), (6, ""), (7, "y" * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, slot int, shard string")
    got = vs.sharded(docs, 2).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == [(-1, 1), (-1, 2), (5, 3), (5, 3), (6, 1), (7, 300_001)]
    assert len({(r.shard, r.slot) for r in got}) == 6
    assert vs.sharded(docs.limit(0), 2).collect() == []


def test_map_is_versioned_and_rebalancing_moves_little(spark, tmp_path):
    sizes = [(s, 1, 100 + s % 7) for s in range(512)]
    first = vs.build(sizes, 4, 512)
    grown = vs.rebalance(first, sizes, 5)
    moved = sum(a != b for a, b in zip(first.shard_of, grown.shard_of, strict=True))
    load = [sum(z for s, _, z in sizes if grown.shard_of[s] == k) for k in range(5)]
    assert max(load) - min(load) <= 106 and moved <= 512 // 5 + 5
    assert all(b == 4 for a, b in zip(first.shard_of, grown.shard_of, strict=True) if a != b)
    shrunk = vs.rebalance(grown, sizes, 4)
    assert set(shrunk.shard_of) == set(range(4))
    first.save(spark, str(tmp_path / "map"))
    grown.save(spark, str(tmp_path / "map"))
    assert vs.SlotMap.load(spark, str(tmp_path / "map")) == grown
    assert vs.SlotMap.load(spark, str(tmp_path / "map"), 1) == first
    with pytest.raises(Exception, match="exists"):
        first.save(spark, str(tmp_path / "map"))


def test_a_stored_map_is_kept_and_edited(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50), "s") for i in range(3000)], "doc_id long, text string, shard string")
    path = str(tmp_path / "map")
    first = vs.stored(docs, path, 4, slots=64)
    assert (first.version, first.shards) == (1, 4) and vs.stored(docs, path, 4, slots=64) == first
    grown = vs.stored(docs, path, 5, slots=64)
    moved = [b for a, b in zip(first.shard_of, grown.shard_of, strict=True) if a != b]
    assert (grown.version, grown.shards) == (2, 5) and 4 in moved and len(moved) < 32
    assert vs.SlotMap.load(spark, path, 1) == first
    at = {r.doc_id: r.shard for r in vs.sharded(docs, slot_map=grown).collect()}
    before = {r.doc_id: r.shard for r in vs.sharded(docs, slot_map=first).collect()}
    assert len(at) == 3000 and sum(at[i] != before[i] for i in at) < 1500 and {at[i] for i in at} == set(range(5))
