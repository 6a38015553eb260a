import random

from findlight.llm import similar_texts as st

DOC = "doc_id long, text string, root string"


def jaccard(a, b, k=5):
    s = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def texts():
    """Originals, near copies and less near ones, by their similarity."""
    rng, out, near, far = random.Random(4), [], [], []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for _ in range(60):
        base = [word() for _ in range(rng.choice([60, 200, 700]))]
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 12, 30])):
            copy[rng.randrange(len(copy))] = word()
        a, b = " ".join(base), " ".join(copy)
        out += [a, b]
        j = jaccard(a, b)
        if j >= 0.83:
            near.append((a, b))
        elif j < 0.75:
            far.append((a, b))
    return out, near, far


def test_near_copies_are_found_and_others_left(spark):
    made, near, far = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], DOC)
    ids = {t: i for i, t in enumerate(made)}
    root = {r.doc_id: r.root for r in st.labelled(docs).collect()}
    hit = sum(root[ids[a]] == root[ids[b]] for a, b in near)
    assert hit >= 0.97 * len(near) > 0
    assert not any(root[ids[a]] == root[ids[b]] for a, b in far) and far
    assert len(set(root.values())) >= len(made) // 2


def test_edges(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    group = []
    for i in range(300):
        t = list(base)
        t[i] = "changed"
        group.append((100 + i, " ".join(t)))
    long = " ".join(f"v{i % 5003}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (7, long), (8, long + " end"), *group]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC)
    kept = st.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 100]
    assert st.one_of_each(docs.limit(0)).collect() == [] and st.labelled(docs.limit(0)).collect() == []


def brute(made):
    """Roots of texts by all pairs."""
    root = list(range(len(made)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in made)]

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n >= 0.8 * (len(a) + len(sets[j]) - n):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(made))]


def groups(roots):
    out = {}
    for i, r in roots:
        out.setdefault(r, set()).add(i)
    return sorted(map(sorted, out.values()))


def edited(rng, base, n):
    out = list(base)
    for at in rng.sample(range(len(base) // 10), n):
        out[10 * at + 5] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_a_star_of_1000_is_one_group(spark):
    """Each copy is 0.82 like the original, and copies are 0.69 like one another."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    made = [" ".join(base), *(edited(rng, base, 4) for _ in range(1000))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], DOC)
    assert 0.8 <= jaccard(made[0], made[1]) < 0.83 and len({r.root for r in st.labelled(docs).collect()}) == 1
    # Parted: 250 texts to a part.
    assert len({r.root for r in st.labelled(docs, at_once=49_000).collect()}) == 1


def test_pairs_at_the_threshold_against_all_pairs(spark):
    """Similarities from 0.75 to 0.9, short and long texts, chains, and a common passage."""
    rng, made = random.Random(8), []
    passage = " ".join(f"p{k}" for k in range(12))
    for k in range(150):
        base = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([8, 9, 12, 30, 60, 210, 400]))]
        made.append(" ".join(base))
        made.append(" ".join([*base[: len(base) - max(1, len(base) // 8)], *(["z"] * (k % 3))]))
        if len(base) >= 60:
            made += [edited(rng, base, max(1, round(len(base) * f / 5))) for f in (0.1, 0.11, 0.12)]
    made = [f"{t} {passage}" if k % 3 == 0 else t for k, t in enumerate(made)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], DOC)
    want = groups(enumerate(brute(made)))
    assert groups((r.doc_id, r.root) for r in st.labelled(docs, at_once=900, list_at_once=3).collect()) == want
    assert groups((r.doc_id, r.root) for r in st.labelled(docs).collect()) == want and any(len(g) > 1 for g in want)


def test_prefixes_meet_whatever_is_frequent():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 4, 5, 9, 10, 33, 300):
        for _ in range(40):
            a = rng.choice(10**6, n, replace=False)
            common = a[: -(-8 * n // 10)]
            seen = np.sort(rng.choice(a, rng.integers(1, n + 1), replace=False))
            frequent = (seen, rng.permutation(len(seen)) + 1)
            assert np.intersect1d(st.prefix(a, 0.8, frequent), st.prefix(common, 0.8, frequent)).size


def test_forest_goes_across_labels_only():
    import numpy as np

    label, seen = np.array([7, 7, 3, 3, 9]), []

    def near(x, rest):
        seen.append((x, rest.tolist()))
        return np.isin(rest, [2]) if x == 1 else np.zeros(len(rest), bool)

    assert st.forest(label, near) == [(7, 3)]
    assert all(len(set(label[rest]) & {label[x]}) == 0 for x, rest in seen)


def test_the_byte_index_links_what_it_lists_and_no_other(spark, monkeypatch):
    """Close copies are united by the inverted index of byte positions alone, each link verified; a tally out of reach unites none."""
    from pyspark.sql import functions as F

    made, _, far = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], DOC).select("doc_id", "text")
    sketched = st._sketches(docs, "doc_id", "text", 5, 0.8).withColumnRenamed("text_hash", "node")
    by_bytes = sketched.withColumn("least", F.array().cast("array<long>"))
    node = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    pairs = [(a, b) for a, b in zip(made[::2], made[1::2], strict=True) if jaccard(a, b) >= 0.93]
    found = {frozenset((r.u, r.v)) for r in st._index_links(docs, by_bytes, "text", 5, 0.8).collect()}
    assert sum(frozenset((node[a], node[b])) in found for a, b in pairs) >= 0.9 * len(pairs) > 0
    assert not any(frozenset((node[a], node[b])) in found for a, b in far)
    monkeypatch.setattr(st, "LEAST_BYTES", 33)
    assert st._index_links(docs, by_bytes, "text", 5, 0.8).collect() == []
