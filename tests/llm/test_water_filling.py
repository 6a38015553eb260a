import re
from collections import Counter

from findlight.llm import water_filling as wf


def brute_targets(sizes, weights, epochs=3.0):
    """sizes: {source: words}; clamp, share anew, until none is above its cap."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped and sizes[s]]
        left = total - sum(capped.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s] * (1 + 1e-12)]
        if not over:
            return {s: capped.get(s, share.get(s, 0.0)) for s in sizes}
        capped |= {s: epochs * sizes[s] for s in over}


def check(docs, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.mixed.size for r in got) == sorted(size(d.text) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d.source] += size(d.text)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = brute_targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)})
    taken, largest = Counter(), Counter()
    for r in got:
        m = r.mixed
        assert m.source_size == sizes[r.source] and abs(m.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert m.taken == m.size * m.repetitions and m.taken <= 3 * m.size
        taken[r.source] += m.taken
        largest[r.source] = max(largest[r.source], m.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest[s], 1), (s, taken[s], want[s])
    return taken


def test_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = wf.mix(docs).collect()
    check(docs.collect(), got)
    again = wf.mix(docs.repartition(3)).collect()
    assert {r.doc_id: r.mixed for r in got} == {r.doc_id: r.mixed for r in again}


def test_caps_bind_and_excess_is_shared(spark):
    rows = [(i, "w " * (1 + i % 5), "abc"[0 if i < 400 else 1 if i < 420 else 2]) for i in range(440)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = wf.mix(docs).collect()
    check(docs.collect(), got)
    assert {r.mixed.repetitions for r in got if r.source == "c"} == {3}


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "x", None), (4, "x", "b"), (4, "x", "b"), (5, "z " * 90_000, "c")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mixed int, size int")
    got = wf.mix(docs).collect()
    assert len(got) == 7 and got[0].asDict().keys() >= {"mixed", "_mixed", "size"}
    assert all(r._mixed.target == 0 and r._mixed.taken == 0 for r in got if r.source == "a")
    assert wf.mix(docs.limit(0)).collect() == []
