import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from findlight.llm import lattice_lm as lm


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def toy():
    weight = {"▁": 3.0, "▁a": 2.0, "a": 1.0, "b": 1.5, "ab": 2.5, "▁ab": 0.5, "ba": 0.25}
    return lm._model(weight, [0.01] * 256, 2.0)


def brute(pieces, word):
    s = "▁" + word

    def rest(i):
        if i == len(s):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(s) + 1):
            p = pieces.piece.get(s[i:j])
            if p is None and j == i + 1:
                p = sum(pieces.byte[b] for b in s[i].encode())
            if p is not None:
                total += math.exp(p) * rest(j)
        return total

    return rest(0)


@pytest.mark.parametrize("word", ["", "a", "ab", "abba", "aabbab", "xab", "é", "a▁b"])
def test_the_forward_sum_is_over_all_segmentations(word):
    assert math.exp(toy().log_probability(word)) == pytest.approx(brute(toy(), word), rel=1e-12)


def test_expected_counts_spell_each_word():
    into, in_bytes = {}, [0.0] * 256
    lm.expected(toy(), "abxab", 3.0, into, in_bytes)
    assert sum(len(p) * n for p, n in into.items()) + in_bytes[ord("x")] == pytest.approx(3.0 * len("▁abxab"))


@pytest.mark.parametrize("word", ["", "a", "abba", "xéab", "aabbab" * 5])
def test_products_and_logarithms_expect_the_same(word):
    one, other = ({}, [0.0] * 256), ({}, [0.0] * 256)
    lm.expected(toy(), word, 2.0, *one)
    lm._expected_by_logs(toy(), word, 2.0, *other)
    assert one[0] == pytest.approx(other[0]) and one[1] == pytest.approx(other[1])
    into, in_bytes = {}, [0.0] * 256
    lm.expected(toy(), "ab" * 5000, 1.0, into, in_bytes)
    assert sum(len(p) * n for p, n in into.items()) == pytest.approx(10_001.0)


def test_very_long_words_and_a_real_vocabulary():
    weight, byte = lm.vocabulary(lm.vocabulary_path())
    pieces = lm._model(weight, byte, 1.0)
    assert -1e7 < pieces.log_probability("ab" * 20_000) < -1e4
    assert sum(map(math.exp, pieces.piece.values())) + sum(map(math.exp, pieces.byte)) + math.exp(pieces.end) == pytest.approx(1.0)


def test_shares_add_up_and_stand_in_the_lattice():
    pieces, shares = toy(), lm.Shares(10, 4, 3)
    assert sum(math.exp(shares.whole(c)) for c in (3, 3, 2, 2)) + math.exp(shares.spelled) + math.exp(shares.end) == pytest.approx(1.0)
    for word, c in (("ab", 3), ("abba", 0), ("", 2)):
        want = math.exp(shares.spelled) * brute(pieces, word) + (math.exp(shares.whole(c)) if c else 0.0)
        assert math.exp(pieces.log_probability(word, shares.whole(c), shares.spelled)) == pytest.approx(want, rel=1e-12)


def test_scores_of_whole_texts_against_all_segmentations(spark):
    texts = ["ab abc ab", "the cat", "xy zé the", "", "A the\tcat\u3000x the"]
    rows = [(i, t, i == 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    counts = Counter(w for i, t in enumerate(texts) if i != 2 for w in words_of(t))
    pieces = lm.fit(spark.createDataFrame(list(counts.items()), "word string, c long"), lm.vocabulary_path(), 2)
    shares = lm.Shares(sum(counts.values()), len(counts), 4)
    # Few rows to a chunk, so that several chunks meet.
    got = {r.doc_id: r.score for r in lm.score(docs, lm.vocabulary_path(), 2, chunk_bytes=8).collect()}
    for i, t in enumerate(texts):
        p = math.exp(shares.end)
        for w in words_of(t):
            p *= math.exp(shares.spelled) * brute(pieces, w) + (math.exp(shares.whole(counts[w])) if counts[w] else 0.0)
        assert got[i] == pytest.approx(math.log10(p), rel=1e-9)


def test_a_table_against_plain_counts(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts, ends = Counter(), 0
    for i, t in docs.items():
        if not held[i]:
            counts.update(words_of(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = {r.doc_id: r for r in lm.op4_lattice_lm(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        w, r = words_of(t), got[i]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and -1e6 < r.score < 0
    # Held-out texts are told apart from noise: their words spelled backwards are less likely.
    odd = spark.createDataFrame([(i, t if not held[i] else " ".join(x[::-1] for x in words_of(t)), held[i]) for i, t in docs.items()], "doc_id long, text string, held_out boolean")
    back = {r.doc_id: r.score for r in lm.score(odd, lm.vocabulary_path()).collect()}
    worse = [back[i] < got[i].score for i in docs if held[i] and len(docs[i]) > 200]
    assert sum(worse) >= 0.95 * len(worse)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "one two"), (5, "one"), (5, "one"), (6, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, "s", None if i == 5 else "x") for i, t in rows], "doc_id long, text string, score string, lang string")
    got = lm.score(lm.held_out(docs), lm.vocabulary_path(), rounds=1).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 2, 3, 50_001]
    assert len({(r.doc_id, r.score) for r in got if r.doc_id == 5}) == 1 and all(math.isfinite(r.score) for r in got)
    none = lm.score(docs.selectExpr("doc_id", "text", "true as held_out"), lm.vocabulary_path(), rounds=1).collect()
    assert {(r.train_tokens, r.n_known) for r in none} == {(0, 0)} and all(r.base_score == 0 for r in none)
    assert lm.score(lm.held_out(docs.limit(0)), lm.vocabulary_path(), rounds=1).collect() == []
