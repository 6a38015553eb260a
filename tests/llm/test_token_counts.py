import random
import re

from findlight.llm import token_counts as tc
from findlight.llm.chat_tokens import encoding, tokenizer_path


def brute(fields, values):
    """[(field, line, char_start, char_end, n_tokens)] of one document, token by token."""
    sections = []
    for i, (f, v) in enumerate(zip(fields, values, strict=True)):
        v = (v or "") + ("\n" if i < len(fields) - 1 else "")
        if f == "text" and v:
            sections += [(f, k, x) for k, x in enumerate(re.findall(r"[^\n]*\n|[^\n]+", v))]
        else:
            sections.append((f, None, v))
    own, counts, at = encoding(tokenizer_path()), [0] * len(sections), 0
    bounds = [0]
    for _, _, x in sections:
        bounds.append(bounds[-1] + len(x.encode()))
    for token in own.encode_ordinary("".join(x for _, _, x in sections)):
        end = at + len(own.decode_single_token_bytes(token))
        held = [min(end, bounds[s + 1]) - max(at, bounds[s]) for s in range(len(sections))]
        counts[max(range(len(held)), key=lambda s: (held[s], -s))] += 1
        at = end
    out, char = [], 0
    for (f, k, x), n in zip(sections, counts, strict=True):
        out.append((f, k, char, char + len(x), n))
        char += len(x)
    return out


def rows_of(got):
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.section)):
        by.setdefault(r.doc_id, []).append((r.field, r.line, r.char_start, r.char_end, r.n_tokens))
    return by


def test_a_table_token_by_token(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 3000")
    got = rows_of(tc.section_tokens(docs).collect())
    fields = ("source", "lang", "text")
    assert got == {r.doc_id: brute(fields, (r.source, r.lang, r.text)) for r in docs.collect()}


def test_the_query_covers_all_documents(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    own = encoding(tokenizer_path())
    sums = {r.doc_id: r.n for r in tc.op2_token_counts(spark, sf).groupBy("doc_id").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert sums == {i: len(own.encode_ordinary(f"{r.source}\n{r.lang}\n{r.text}")) for i, r in docs.items()}


def test_edges(spark):
    rng = random.Random(2)
    texts = [None, "", "\n", "\n\n\na", "é中\n\n", "a" * 60_000 + "\nz", "<|endoftext|>"] + ["".join(rng.choice("ab\n é中") for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, None, "x\ny", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_tokens int")
    got = rows_of(tc.section_tokens(docs).collect())
    assert got == {i: brute(("source", "lang", "text"), (None, "x\ny", t)) for i, t in enumerate(texts) if not (t in (None, ""))} | {i: [s for s in got[i]] for i in (0, 1)}
    assert [s[:2] for s in got[0]] == [("source", None), ("lang", None), ("text", None)] and got[0] == got[1]
    twice = docs.limit(3).union(docs.limit(3))
    assert tc.section_tokens(twice).count() == 2 * tc.section_tokens(docs.limit(3)).count()
    assert tc.section_tokens(docs.limit(0)).collect() == []


def test_a_token_goes_where_most_of_it_lies():
    import numpy as np

    counts, crossing = tc.attribute(np.array([0, 3, 5, 9]), np.array([3, 5, 9, 10]), np.array([0, 4, 4, 6, 10]))
    assert counts.tolist() == [2, 0, 0, 2] and crossing.tolist() == [1, 0, 1, 0]
