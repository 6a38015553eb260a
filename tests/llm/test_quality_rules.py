import random
import re
from collections import Counter

from pyspark.sql import functions as F

from findlight.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dups = Counter(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += lines[line] > 0
            lines[line] += 1
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_counts_of_a_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = qr.op5_quality_rules(spark, sf).collect()
    assert {r.doc_id: counts(r) for r in got} == {i: brute(t) for i, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in got)


def test_counts_of_odd_texts(spark):
    rng = random.Random(11)
    texts = [None, "", " \n\t", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "x\r\ny\r\nx\r\n\nx", "\x0bé\U0001f600\x0c|<>", "a\xa0b \x1c", "w " * 100_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "j") for i, t in enumerate(texts)], "doc_id long, text string, judged string")
    got = qr.judged(docs, []).collect()
    assert [counts(r._judged) for r in sorted(got, key=lambda r: r.doc_id)] == [brute(t) for t in texts]
    assert qr.judged(docs.limit(0), []).collect() == []


def test_rules_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rules = qr.train(docs, labels.filter(seen))
    assert rules and all(len(r) <= 5 for r in rules)
    judged = qr.judged(docs, rules).join(labels.filter(~seen), "doc_id").filter("NOT judged.base_failed")
    got = judged.groupBy("quality", "judged.kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * (n[1, True] + n.get((1, False), 0)), n
    assert n.get((0, False), 0) >= 0.85 * (n.get((0, True), 0) + n.get((0, False), 0)), (n, rules)


def test_learning_without_or_with_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 3 + " ".join(f"v{k}" for k in range(30)) + "###" * (i % 2)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)] + [(None, 0), (3, None), (5, 7)], "doc_id long, quality int")
    assert qr.train(docs, labels.limit(0)) == [] and qr.train(docs.limit(0), labels) == []
    rules = qr.train(docs, labels)
    assert {r.doc_id % 2 for r in qr.accepted(docs, labels).collect()} == {0}, rules
    assert qr.learn([([1.0], False)] * 20, ("a",)) == []
