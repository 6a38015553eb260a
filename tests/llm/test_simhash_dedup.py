import random

import xxhash

from findlight.llm import simhash_dedup as sh
from findlight.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_print(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints):
    """prints: {node: fp}; the least node that each reaches."""
    root = {n: n for n in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(prints)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_classes_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    want = brute_classes(prints)
    got = sh.op3_simhash_dedup(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_links_of_long_and_short_lists_reach_the_same(spark):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:40]:
        for _ in range(6):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 64, 7) for b in range(0, 64, 9) for c in (0, 13, 63)}
    want = brute_classes({signed(p): p for p in prints})
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for cap in (2, 10, 10_000):
        got = {r.node: r.root for r in components(sh.links(df, cap)).collect()}
        assert {p: got.get(p, p) for p in want} == want


def test_nulls_empty_ties_repeats_long_and_other_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, " \t\n", "b", 0), (4, "One two three", "b", 0), (4, "one\ttwo THREE", "c", 0), (9, long, None, 0), (8, long, None, 0), (8, long, None, 0), (None, "one two three", None, 0)]
    docs = spark.createDataFrame([(i, t, s, t) for i, t, s, _ in rows], "doc_id long, text string, fp string, root string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in sh.near_duplicates(docs).collect())
    assert got == sorted([(False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 4), (False, 4, 4), (True, 0, 4), (False, 9, 8), (False, 8, 8), (False, 8, 8)])
    kept = sh.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 8]
    assert sh.near_duplicates(docs.limit(0)).collect() == [] and sh.one_of_each(docs.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.range(0, 300).selectExpr("id as u", "id + 1 as v")
    got = components(edges).collect()
    assert {r.root for r in got} == {0} and len(got) == 300
