import random
import zlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline as cp
from findlight.llm.sorted_tables import tokenizer_path


def test_stages_over_a_table(spark, sf, tmp_path):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        made = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert made.columns == columns, name
            ids = [r.doc_id for r in made.select("doc_id").collect()]
            assert set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()} and ids, name
            assert k == 3 or len(set(ids)) == len(ids), name
        seen.append(made.count())
        docs = made
    assert seen[0] >= seen[1] >= seen[2] and seen[3] == seen[4]
    again = cp.run(spark, sf)
    row = lambda r: (r.doc_id, r.start, r.n_tokens, r.ids_crc32)
    assert sorted(map(row, again.collect())) == sorted(map(row, docs.collect()))


def test_stages_against_plain_python(spark, tmp_path):
    """Planted rejects, copies, near copies, leaks and clean documents; each stage against loops over its own input."""
    rng, rows = random.Random(12), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(25)) for k in range(4)]
    for k in range(60):
        base = text(rng.randrange(25, 120))
        rows.append((base, f"s{k % 4}"))
        words = base.split()
        if k % 5 == 0:
            rows.append((base, "s0"))
        if k % 5 == 1 and len(words) > 60:
            rows.append((" ".join([*words[:30], "changed", *words[31:]]), "s1"))
        if k % 5 == 2:
            rows.append((f"{text(30)} {items[k % 4][1]} {text(5)}", "s2"))
        if k % 5 == 3:
            rows += [(text(10), None), (f"{text(12)} " * 9, "s3"), (None, "s3")]
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(rows)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    def repeated(words):
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        return len({i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)})

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def one_of_each(docs):
        kept, sets, root = [], [shingles(r[1]) for r in docs], list(range(len(docs)))
        for i in range(len(docs)):
            for j in range(i):
                n = len(sets[i] & sets[j])
                if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = root[i], root[j]
                    root = [min(a, b) if x in (a, b) else x for x in root]
        for i, r in enumerate(docs):
            if root[i] == i:
                kept.append(r)
        return kept

    good = [r for r in rows if len(w := (r[1] or "").split()) >= 20 and 100 * repeated(w) <= 30 * len(w)]
    single = one_of_each(sorted(good))
    clean = [r for r in single if not any(f" {t} " in f" {r[1]} " for _, t in items)]
    assert len(rows) > len(good) > len(single) > len(clean) > 30

    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(sorted(tuple(r) for r in docs.collect()))
    assert seen[:3] == [sorted(good), sorted(single), sorted(clean)]

    # Sources weigh 1, 2, 3 in turn; levels rise until the targets, capped at three times the size, add up.
    size = Counter()
    for r in clean:
        size[r[3]] += len(r[1].split())
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(size))}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * size[s], mid * weight[s]) for s in size) < sum(size.values()) else (low, mid)
    times, taken = Counter(r[0] for r in seen[3]), Counter()
    assert {r[:5] for r in seen[3]} <= {r[:5] for r in clean}
    for r in clean:
        target = min(3 * size[r[3]], low * weight[r[3]])
        assert int(target / size[r[3]] + 1e-9) <= times[r[0]] <= int(target / size[r[3]] + 1e-9) + 1 <= 4
        taken[r[3]] += times[r[0]] * len(r[1].split())
    assert all(abs(taken[s] - min(3 * size[s], low * weight[s])) <= 25 for s in size)

    made = Tokenizer.from_file(tokenizer_path())
    made.encode_special_tokens = True
    at, want = 0, []
    for r in seen[3]:
        ids = [*made.encode(r[1], add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert sorted((r[0], r[2], r[3]) for r in seen[4]) == sorted((d, n, c) for d, _, n, c in want)
    assert sorted(r[1] for r in seen[4]) == [s for _, s, _, _ in want]
