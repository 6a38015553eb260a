"""Quality filter by a learned decision list: ordered threshold conjunctions, emitted as one Spark conditional expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, dealt, fresh, let, table, words_of

#: Labelled rows that the list is learned from, at most: those with the least seeded hash of their id.
TRAIN_ROWS = 6000
SEED = "rules-1"
WINDOW = 8
#: What a rule may test.
STATISTICS = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "distinct_share", "mean_line")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more; linear but for a sort, which only texts with repeats pay."""

    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)

        def again(e: Column, i: Column) -> Column:
            twin = lambda at: F.coalesce(F.get(sorted_windows, at)["h"] == e["h"], F.lit(False))
            return ((i > 0) & twin(i - 1)) | ((i < n - 1) & twin(i + 1))

        places = F.sort_array(F.transform(F.filter(sorted_windows, again), lambda e: e["at"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        fold = F.aggregate(places, start, lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n")))
        return fold["n"]

    def repeats(windows: Column) -> Column:
        numbered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(numbered, covered))

    def windows(hashes: Column) -> Column:
        # A window of eight words is hashed as two of four, and these as two of two.
        doubled = lambda h, k: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + k)))
        eight = let(doubled(hashes, 1), lambda two: let(doubled(two, 2), lambda four: doubled(four, 4)))
        return F.when(F.size(hashes) < WINDOW, 0).otherwise(let(F.slice(eight, F.lit(1), F.size(hashes) - (WINDOW - 1)), repeats))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def statistics(text: Column) -> Column:
    """A struct of counts over a whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (contract), and n_lines, n_upper, n_digits, n_distinct. Null has none of anything."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    long = lambda c: c.cast("long")
    without = lambda pattern: long(F.length(text) - F.length(F.regexp_replace(text, pattern, "")))
    by_word = let(words_of(text), lambda w: F.struct(long(F.size(w)).alias("n"), long(F.length(F.array_join(w, ""))).alias("chars"), long(F.size(F.array_distinct(w))).alias("kinds"), long(_repeat_words(w)).alias("repeats")))
    by_line = let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dups")))
    made = F.struct(by_word.alias("w"), by_line.alias("l"), without("[#*$%&|<>]+").alias("symbols"), without(r"\p{Lu}+").alias("upper"), without("[0-9]+").alias("digits"))
    return let(
        made,
        lambda s: F.struct(
            s["w"]["n"].alias("n_words"), s["w"]["chars"].alias("word_chars"), s["symbols"].alias("n_symbols"), s["l"]["dups"].alias("n_dup_lines"), s["w"]["repeats"].alias("n_repeat_words"),
            s["l"]["n"].alias("n_lines"), s["upper"].alias("n_upper"), s["digits"].alias("n_digits"), s["w"]["kinds"].alias("n_distinct"),
        ),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def shares(s: Column) -> dict[str, Column]:
    """The statistics that rules test, by name; 0 where there is nothing to divide by."""
    per = lambda a, b: F.when(s[b] > 0, s[a] / s[b]).otherwise(0.0)
    made = (s["n_words"].cast("double"), per("word_chars", "n_words"), per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_upper", "word_chars"), per("n_digits", "word_chars"), per("n_distinct", "n_words"), per("n_words", "n_lines"))
    return dict(zip(STATISTICS, made, strict=True))


@dataclass(frozen=True)
class Condition:
    """``name > bound``, or ``name <= bound``."""

    name: str
    above: bool
    bound: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.name] > F.lit(self.bound) if self.above else values[self.name] <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.bound:.6g}"


#: A rule: all its conditions must hold. A list of rules: the first that holds rejects.
Rule = tuple[Condition, ...]


def learn(rows: list[tuple[list[float], bool]], names: tuple[str, ...] = STATISTICS, precision: float = 0.9, least: int = 5, cuts: int = 48, max_rules: int = 24) -> list[Rule]:
    """Rules that reject, by sequential covering of ``rows`` (values, is it bad), most worthy first.

    Each rule is grown on two thirds of what is left, by the condition with the highest FOIL gain, until it
    covers no good row; conditions are pruned from its end while that doesn't lower its worth on the other
    third; covered rows go. It stops at a rule that covers under ``least`` bad rows, or whose share of bad
    rows on the held-out third is under ``precision``. Rows of one class, or none, give no rules.
    """
    import numpy as np

    if not rows:
        return []
    x, bad = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], bool)
    held = np.arange(len(rows)) % 3 == 2
    bounds = []
    for k in range(x.shape[1]):
        distinct = np.unique(np.concatenate([np.quantile(x[bad, k] if bad.any() else x[:, k], np.linspace(0, 1, cuts)), np.quantile(x[:, k], np.linspace(0, 1, cuts))]))
        bounds.append((distinct[1:] + distinct[:-1]) / 2)

    def holds(conditions: list[tuple[int, bool, float]]):
        return reduce(lambda a, c: a & ((x[:, c[0]] > c[2]) == c[1]), conditions, np.ones(len(x), bool))

    left, out = np.ones(len(x), bool), []
    while len(out) < max_rules and (left & bad & ~held).sum() >= least:
        grow, conditions = left & ~held, []
        while True:
            now = grow & holds(conditions)
            p, n = (now & bad).sum(), (now & ~bad).sum()
            if not n or len(conditions) >= 5:
                break
            best, worth = None, 1e-9
            for k, at in enumerate(bounds):
                above = x[now, k][:, None] > at[None, :]
                for up, side in ((True, above), (False, ~above)):
                    ps, ns = side[bad[now]].sum(0), side[~bad[now]].sum(0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - np.log2(p / (p + n))), -np.inf)
                    i = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[i] > worth:
                        best, worth = (k, up, float(at[i])), gain[i]
            if best is None:
                break
            conditions.append(best)

        def value(c):
            at = left & held & holds(c)
            return ((at & bad).sum() + 1) / (at.sum() + 2)

        while len(conditions) > 1 and value(conditions[:-1]) >= value(conditions):
            conditions = conditions[:-1]
        covered = left & holds(conditions)
        tested, caught = covered & held, covered & bad
        if not conditions or caught.sum() < least or (tested & bad).sum() < precision * max(1, tested.sum()) or caught.sum() < precision * covered.sum():
            break
        out.append(tuple(Condition(names[k], up, bound) for k, up, bound in conditions))
        left &= ~covered
    return out


def verdict(rules: list[Rule], values: dict[str, Column]) -> Column:
    """The 1-based number of the first rule that holds; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        hit = reduce(lambda a, b: a & b, (c.column(values) for c in rule))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(0) if out is None else out.otherwise(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules learned from up to ``train_rows`` rows of ``labels (id, quality 0/1)``; their texts' statistics, a few numbers each, come to the driver.

    Labels of null id or other quality are passed over, and so are texts that fail the base rules already. An
    id that is labelled or appears twice counts once.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    hashed = F.xxhash64(F.lit(SEED), id_col)
    chosen = known.select(F.col(id_col).alias("_id"), "quality", hashed.alias("_h")).orderBy("_h", "_id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    one = texts.select("_id", "_h", "quality", statistics(F.col("_text")).alias("s")).groupBy("_id").agg(F.first("_h").alias("_h"), F.first("quality").alias("quality"), F.min("s").alias("s"))
    s = F.col("s")
    rows = one.filter(~base_failed(s)).select("_h", "_id", (F.col("quality") == 0).alias("bad"), F.array(*shares(s).values()).alias("x")).collect()
    return learn([(r.x, r.bad) for r in sorted(rows, key=lambda r: (r._h, r._id))])


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with one more column ``judged`` (``_judged`` if there is one): a struct of the statistics, base_failed, rule and kept.

    Works on whole texts, row by row. A null, empty or blank text has no words and fails the base rules.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    name = fresh(docs, "judged")[0]

    def all_of(s: Column) -> Column:
        parts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        failed, rule = base_failed(s), verdict(rules, shares(s))
        return F.struct(*[s[p].alias(p) for p in parts], failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept"))

    return docs.withColumn(name, let(statistics(F.col(text_col)), all_of))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the list learned from ``labels`` keep."""
    made = judged(docs, train(docs, labels))
    return made.filter(F.col(f"{made.columns[-1]}.kept")).select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    return judged(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "judged.*")
