"""Each operator over a table that has columns of all names that are used inside."""

import re
from pathlib import Path

import pytest

import findlight.llm
from findlight.llm import chat_tokens, lattice_lm, quality_rules, secret_forest, simhash_dedup, sorted_tables, template_decontam, token_counts, virtual_slots, water_filling

OWN = ("doc_id", "text", "source")


def inner_names():
    found = set()
    for path in Path(findlight.llm.__file__).parent.glob("*.py"):
        found |= set(re.findall(r'"(_?[a-zA-Z][a-zA-Z_0-9]{0,20})"', path.read_text()))
    return sorted({x.lower() for x in found} - set(OWN))


@pytest.fixture(scope="module")
def docs(spark):
    names = inner_names()
    assert {"_id", "_hash", "hash", "size", "mixed", "kept", "score", "root", "shard"} <= set(names)
    rows = [(i, f"One two three {i} four five six seven, eight nine ten {'eleven twelve ' * 8}", f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in (1, 2, 3, 4, 4)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in (*OWN, *names)))


def test_rows_come_back_as_they_were(spark, docs):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y")], "doc_id long, quality int, text string")
    bench = spark.createDataFrame([(7, "nothing of this stands anywhere in these texts", "z")], "item_id long, text string, doc_id string")
    whole = {tuple(r) for r in docs.collect()}
    for made in (simhash_dedup.one_of_each(docs), simhash_dedup.one_of_each(docs, words=5, similarity=0.8), template_decontam.clean(docs, bench), quality_rules.accepted(docs, labels)):
        assert made.columns == docs.columns and {tuple(r) for r in made.collect()} <= whole
    mixed = water_filling.mix(docs)
    assert mixed.columns[:-1] == docs.columns and {tuple(r)[:-1] for r in mixed.collect()} == whole
    judged = quality_rules.judged(docs, [])
    assert judged.columns[:-1] == docs.columns and {tuple(r)[:-1] for r in judged.collect()} == whole


def test_other_operators_look_at_their_own_columns(spark, docs):
    bench = docs.withColumnRenamed("item_id", "other").withColumnRenamed("doc_id", "item_id")
    bench = bench.limit(1)
    assert template_decontam.leaks(docs, bench).count() >= 1
    assert simhash_dedup.near_duplicates(docs).count() == 5
    assert virtual_slots.sharded(docs, 2).count() == 5
    assert sorted_tables.packed(docs).count() == 5
    assert lattice_lm.score(lattice_lm.held_out(docs), lattice_lm.vocabulary_path(), 1).count() == 5
    assert secret_forest.scan(docs, None).count() == 0
    assert token_counts is not None and chat_tokens is not None


def test_ids_that_are_texts_make_shard_files(spark):
    docs = spark.createDataFrame([("b", "two words", 1), ("a", None, 1), (None, "x", 1), ("a", "one", 1)], "doc_id string, text string, start int")
    rows = sorted_tables.packed(docs).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, "a", "a", "b"] and rows[0].start == 0 and rows[-1].start == sum(r.n_tokens for r in rows[:-1])
