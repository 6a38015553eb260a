"""BM25 over several fields."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzers import TOKEN_CLASS
from ..plans import compiler as c
from ..plans import query as q
from ..plans.schema import Field, Schema

# The formula's constants, what a word at distance 1 weighs, and the score of a match that has none.
K1, B, FUZZY_WEIGHT, LEAST = 1.2, 0.75, 0.8, 0.1


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25(live: DataFrame, schema: Schema, words: tuple[str, ...], where: Column, fuzzy: bool = False, score: str = "score") -> DataFrame:
    """The rows of ``live`` that pass ``where``, with a column ``score``: over words and string fields, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)).

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and the mean length come from one aggregation over
    all live rows, which returns a single row, joined without a shuffle. Words of a keyword field have tf,
    length and mean 1. Where ``fuzzy`` is on and the field offers it, each token at distance 1 that begins like the
    word is a term of its own, with its own df and tf, and weighs 0.8; a match without a score has 0.1.
    """
    compiler = c._Compiler(schema)
    fields = [f for f in schema.fields if f.strings]
    tallies, stats = {}, [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        if f.words:
            tallies[f"_l{i}"] = _length(compiler, f)
            stats += [F.sum(f"_l{i}").alias(f"_sum{i}"), F.count(F.col(f.source)).alias(f"_n{i}")]
        for j, w in enumerate(words):
            tallies[f"_e{i}_{j}"] = _frequency(compiler, f, w)
            stats.append(F.count(F.when(F.col(f"_e{i}_{j}") > 0, 1)).alias(f"_d{i}_{j}"))
            if fuzzy and f.fuzzy:
                tallies[f"_z{i}_{j}"] = _near(compiler, f, w)
    counted = live.withColumns(tallies)
    near = [z for z in tallies if z.startswith("_z")]
    hits = counted.filter(where).crossJoin(F.broadcast(counted.agg(*stats)))  # one row on the right
    if near:
        hits = hits.crossJoin(F.broadcast(_expansions(counted, near)))  # one row, of the tokens at distance 1
    parts = []
    for i, f in enumerate(fields):
        norm = 1.0 - B + B * F.col(f"_l{i}") / F.greatest(F.col(f"_sum{i}") / F.greatest(F.col(f"_n{i}"), F.lit(1)), F.lit(1e-9)) if f.words else F.lit(1.0)
        weigh = lambda tf, df, norm=norm: idf(F.col("n"), df) * tf * (K1 + 1) / (tf + K1 * norm)
        for j in range(len(words)):
            tf = F.col(f"_e{i}_{j}").cast("double")
            parts.append(F.when(tf > 0, weigh(tf, F.col(f"_d{i}_{j}"))).otherwise(0.0))
            if f"_z{i}_{j}" in near:
                parts.append(FUZZY_WEIGHT * _sum_over(f"_z{i}_{j}", weigh))
    total = reduce(lambda a, b: a + b, parts)
    return hits.select(*live.columns, (F.when(total == 0, LEAST).otherwise(total) if fuzzy else total).alias(score))


def _sum_over(z: str, weigh) -> Column:
    """The sum of what the distinct tokens of an array column weigh, by their tf and df."""
    def more(total: Column, t: Column) -> Column:
        return total + weigh(F.size(F.filter(z, lambda x: x == t)).cast("double"), F.try_element_at("_df", F.concat(F.lit(f"{z} "), t)))

    return F.aggregate(F.array_distinct(z), F.lit(0.0), more)


def _expansions(counted: DataFrame, near: list[str]) -> DataFrame:
    """One row ``_df``: for each token of the arrays ``near``, in how many rows it is. Only tokens one edit from a word sought are among them."""
    named = lambda z: F.transform(F.array_distinct(z), lambda t: F.concat(F.lit(f"{z} "), t))
    each = F.flatten(F.array(*map(named, near)))
    found = counted.select(F.explode_outer(each).alias("t")).filter("t IS NOT NULL").groupBy("t").agg(F.count("*").alias("df"))
    return found.agg(F.map_from_entries(F.collect_list(F.struct("t", "df"))).alias("_df"))


def _length(compiler: c._Compiler, f: Field) -> Column:
    """How many tokens a field has."""
    s = compiler._searchable(f)
    if s is not None:
        return F.coalesce(F.regexp_count(s, F.lit(f"[{TOKEN_CLASS}]+")), F.lit(0))
    return F.coalesce(F.size(compiler._tokens(f)), F.lit(0))


def _frequency(compiler: c._Compiler, f: Field, word: str) -> Column:
    """How often a field has a word; texts that don't hold it aren't parted into tokens."""
    if not f.words:
        return compiler.of(q.Term(f.name, word)).cast("int")
    s = compiler._searchable(f)
    if s is None:
        return F.coalesce(F.size(F.filter(compiler._tokens(f), lambda x: x == word)), F.lit(0))
    if not re.fullmatch(r"[\w\-@.]+", word):
        return F.lit(0)
    return F.when(F.contains(s, F.lit(word)), F.regexp_count(s, F.lit(c._EDGE_L + c._quote(word) + c._EDGE_R))).otherwise(0)


def _near(compiler: c._Compiler, f: Field, word: str) -> Column:
    """The tokens of a field, repeats included, that begin like the word and are one edit from it."""
    values = compiler._tokens(f) if f.words else F.array(compiler._value(f, compiler._col(f)))
    near = lambda x: (x != word) & x.startswith(word[0]) & (F.abs(F.length(x) - len(word)) <= 1) & (F.levenshtein(x, F.lit(word), 1) >= 0)
    return F.coalesce(F.filter(values, near), F.array().cast("array<string>")) if word else F.array().cast("array<string>")
