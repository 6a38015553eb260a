import re

from findlight.llm import template_decontam as td

ITEM = "Tom has 5 apples and Tom gives Anna 2 apples after 30 minutes, so how many apples has Tom left at the end of the day?"
DOC, BENCH = "doc_id long, text string, item_id long, shift int", "item_id long, text string, doc_id string"


def found(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 7, 7) for i, t in texts], DOC)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], BENCH)
    return sorted((r.doc_id, r.item_id, r.changed_slots) for r in td.leaks(docs, bench).collect())


def test_exact_and_reparameterised_questions(spark):
    pad = "something quite else stands here before it. "
    other = ITEM.replace("Anna", "Maria").replace("5", "12.5").replace("2 apples", "7 apples").replace("30 minutes", "4 hours")
    mixed = other.replace("how many apples has Tom", "how many apples has Eve")
    texts = [(1, pad + ITEM + " And on it goes"), (2, pad + other), (3, pad + mixed), (4, pad * 30), (5, pad + ITEM.upper()), (6, None), (7, ""), (8, ITEM[: len(ITEM) // 4])]
    got = found(spark, texts, [(100, ITEM)])
    assert got[0] == (1, 100, 0) and got[1][:2] == (2, 100) and got[1][2] >= 4
    ids = {i for i, _, _ in got}
    assert {1, 2} <= ids and not ids & {3, 4, 6, 7, 8}


def test_edges(spark):
    long = "filler word " * 60_000
    texts = [(1, "x y " + "short item here" + " z"), (1, "x y " + "short item here" + " z"), (None, ITEM), (2, long + ITEM)]
    items = [(1, "Short item here"), (1, "Short item here"), (2, None), (3, " "), (4, ITEM), (5, "12 13")]
    got = found(spark, [(i if i is not None else 99, t) for i, t in texts], items)
    assert [(a, b) for a, b, _ in got] == [(1, 1), (2, 4), (99, 4)]
    docs = spark.createDataFrame([(i, t, 7, 7) for i, t in texts], DOC)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], BENCH)
    assert {(r.doc_id, r.item_id) for r in td.leaks(docs, bench).collect()} == {(1, 1), (2, 4), (None, 4)}
    assert td.clean(docs, bench).collect() == []
    assert td.clean(docs, bench.limit(0)).count() == 4 and td.leaks(docs.limit(0), bench).collect() == []


def test_a_table_against_plain_search(spark):
    """Every document that holds an item's words in a row is found, and no other."""
    sf = "/root/testdata/sf0.01"
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in td.op8_template_decontam(spark, sf).collect()}
    assert want and got == want


def test_part_of_one_of_many_items_of_a_template(spark):
    """Words 10 to 40 of one of 20 items that differ in numbers only, and a row of numbers out of an item."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(50)]
    item = lambda i: " ".join([*words[:15], str(i), *words[15:30], str(i + 7), *words[30:]])
    numbers = "sum these now please " + " ".join(str(3 * k + 11) for k in range(20)) + " and say what comes out of it"
    items = [*((i, item(i)) for i in range(20)), (50, numbers)]
    part = " ".join(item(4).split()[10:40])
    got = found(spark, [(1, f"something else {part} goes on"), (2, "given " + " ".join(numbers.split()[5:22])), (3, " ".join(item(4).split()[10:20]))], items)
    assert [(d, i) for d, i, _ in got] == [(1, i) for i in range(20)] + [(2, 50)]
    assert [c for d, i, c in got if (d, i) == (1, 4)] == [0]


def test_copies_whose_words_are_names_elsewhere(spark):
    """Short items after a lower-case word, and in lower case."""
    names = "They say that Tom met Anna Smith and Bob Jones near Oxford"
    items = [(1, "Short item here"), (2, names), (3, "Cups of tea for nine old men were sold")]
    texts = [(1, "x y Short item here z"), (2, "so " + names.lower() + " then"), (3, "so " + names + " then"), (4, "and 5 Cups of tea for nine old men were sold"), (5, "x y Short item there")]
    assert [(d, i) for d, i, _ in found(spark, texts, items)] == [(1, 1), (2, 2), (3, 2), (4, 3)]
