"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, so that a question with other values is still found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, cut, dealt, each, fresh, let, table, words_of

#: Words to a window, and words that a match covers at least (of a shorter item: all).
WINDOW, COVERED = 8, 13
#: Rows of benchmark windows up to which they are broadcast (some 60 MB).
BROADCAST_WINDOWS = 2_000_000

# The placeholders' marks, and what they stand for.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
_NUMBER = r"(?<![\p{L}\p{N}])[0-9][0-9.,:/]*"
_NAME = r"(?<=[\p{Ll}\p{N},;] )\p{Lu}[\p{L}\p{M}'’-]*"
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "ounce", "ounces", "oz", "pound", "pounds", "lb", "lbs",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "mph", "kph", "percent", "degree", "degrees", "dollar", "dollars", "cent", "cents", "euro", "euros",
)
_UNIT = rf"(?<=[0-9] ?)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"


def marked(text: Column) -> Column:
    """The text lowered and without punctuation, each number, name and unit behind its mark. White space stays as it is.

    A name is a capitalised word that doesn't begin a sentence or a line; a unit is one of UNITS after a digit.
    """
    text = F.coalesce(text, F.lit(""))

    def lowered(t: Column) -> Column:
        return F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{N}}\s{NUMBER}-{UNIT}]+", "")

    def named(t: Column) -> Column:
        return F.regexp_replace(t, _NAME, f"{NAME}$0")

    # Passes over the text that most texts can do without stand behind cheaper tests.
    bare = F.when(F.contains(text, F.lit(NUMBER)) | F.contains(text, F.lit(NAME)) | F.contains(text, F.lit(UNIT)), F.regexp_replace(text, f"[{NUMBER}-{UNIT}]", "")).otherwise(text)
    counted = lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(named(F.regexp_replace(t, _UNIT, f"{UNIT}$0")), _NUMBER, f"{NUMBER}$0")).otherwise(named(t))
    return lowered(let(bare, counted))


def template(marked_text: Column) -> Column:
    """A marked text with only the marks left of what is behind them; it has the same words in the same places."""
    return F.regexp_replace(marked_text, rf"([{NUMBER}-{UNIT}])[^\s{NUMBER}-{UNIT}]*", "$1")


def plain(marked_text: Column) -> Column:
    """A marked text without the marks; it has the same words in the same places."""
    return F.translate(marked_text, NUMBER + NAME + UNIT, "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window(h: Column, at: Column, size: int) -> Column:
    """The hash of the ``size`` hashed words of ``h`` from place ``at`` on (from 0), or null where they aren't there."""
    return F.when(at + size <= F.size(h), F.xxhash64(*[F.get(h, at + k) for k in range(size)]))


def _seeds(classes: DataFrame, size: int, window: int) -> DataFrame:
    """``(h, class, n, ipos)``: all windows of ``classes (class, words, n)``; those under ``window`` words have one of their own ``size``."""
    mine = classes.filter(F.col("n") == size if size < window else F.col("n") >= window)
    placed = mine.select("class", "n", _hashes(F.col("words")).alias("w"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("ipos"))
    return placed.select(_window(F.col("w"), F.col("ipos"), size).alias("h"), "class", "n", "ipos")


def _all_windows(keyed: DataFrame, sizes: list[int]) -> DataFrame:
    """``(doc_id, text_hash, h, at)`` of all windows of the texts of ``keyed``: of their templates, and of their plain words where these differ.

    Windows are hashed and looked up one by one behind the explode, in generated code; no array of them is made.
    """
    both = lambda m: F.struct(_hashes(words_of(template(m))).alias("t"), _hashes(words_of(plain(m))).alias("p"))
    hashed = keyed.select("doc_id", "text_hash", let(marked(F.col("text")), both).alias("w")).select("doc_id", "text_hash", "w.t", "w.p")
    last = F.size("t") - min(sizes)
    placed = hashed.select("doc_id", "text_hash", "t", "p", each(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    found = [_window(F.col(c), F.col("at"), s).alias(f"{c}{s}") for s in sizes for c in ("t", "p")]
    made = placed.select("doc_id", "text_hash", "at", *found)
    differing = [F.when(F.col(f"p{s}") != F.col(f"t{s}"), F.col(f"p{s}")) for s in sizes]
    return made.select("doc_id", "text_hash", "at", F.explode(F.array(*[F.col(f"t{s}") for s in sizes], *differing)).alias("h")).filter("h IS NOT NULL")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col), F.lit(1)).alias("text_hash"), F.col(text_col).alias("text"))


def _aligned(doc: Column, item: Column, shift: Column, size: Column) -> Column:
    """Of a document's marked words beside an item's, ``shift`` places on: words covered by equal runs of ``size`` or more, with and without equal values, and whether slots contradict one another."""
    bare = lambda w: F.regexp_replace(w, rf"([{NUMBER}-{UNIT}])[^{NUMBER}-{UNIT}]*", "$1")
    pairs = F.transform(item, lambda w, k: F.struct(w.alias("i"), F.when(k + shift >= 0, F.get(doc, F.greatest(k + shift, F.lit(0)))).alias("d")))

    def run(equal: Column) -> Column:
        zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("sum"))

        def step(acc: Column, e: Column) -> Column:
            longer = acc["run"] + 1
            gain = F.when(longer == size, size).when(longer > size, 1).otherwise(0)
            return F.struct(F.when(e, longer).otherwise(0).alias("run"), (acc["sum"] + F.when(e, gain).otherwise(0)).alias("sum"))

        return F.aggregate(equal, zero, step)["sum"]

    def judge(p: Column) -> Column:
        same = F.transform(p, lambda x: F.coalesce(bare(x["i"]) == bare(x["d"]), F.lit(False)))
        equal = F.transform(p, lambda x: F.coalesce(plain(x["i"]) == plain(x["d"]), F.lit(False)))
        slots = F.array_distinct(F.filter(p, lambda x: x["i"].rlike(f"[{NUMBER}-{UNIT}]") & F.coalesce(bare(x["i"]) == bare(x["d"]), F.lit(False))))
        clash = let(slots, lambda s: F.size(F.array_distinct(F.transform(s, lambda x: x["i"]))) < F.size(s))
        changed = let(slots, lambda s: F.size(F.filter(s, lambda x: x["i"] != x["d"])))
        return F.struct(run(same).alias("matched_words"), run(equal).alias("equal_words"), clash.alias("clash"), changed.alias("changed_slots"))

    return let(pairs, judge)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, covered: int = COVERED) -> DataFrame:
    """``(doc_id, text_hash, item_id, n_words, matched_words, equal_words, changed_slots)`` for each document row and item that it holds.

    All windows of whole texts are hash-joined with all those of the items (broadcast while they are few, shuffled
    otherwise), by template and by plain words; items of one template, or of the same words, are looked for once.
    Where a document holds windows enough of a template or text, it is compared with each of its items word by
    word. It is a match if runs of ``window`` template words or more cover ``covered`` of the item's words (a
    shorter item: all) and each of its values stands for one value throughout, or if runs of equal lower-case
    words cover as many, whatever is a name or a unit where they stand.

    A null or blank text matches nothing, nor does a null or blank item; rows of a null id are found like others;
    repeated rows and items give repeated results once each. Empty tables give no rows.
    """
    m = marked(F.col(item_text_col))
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(m).alias("marked_words"), words_of(template(m)).alias("words"), words_of(plain(m)).alias("plain_words"))
    items = cut(items.filter(F.size("words") > 0).dropDuplicates().withColumn("n", F.size("words")))
    kinds = F.array(*[F.struct(F.xxhash64(F.col(name), F.lit(k)).alias("class"), F.col(name).alias("words")) for k, name in enumerate(("words", "plain_words"))])
    classed = items.select("item_id", "n", F.explode(kinds).alias("k")).select("item_id", "n", "k.class", "k.words")
    classes = classed.select("class", "words", "n").dropDuplicates(["class"])
    sizes = sorted({min(r.n, window) for r in items.select(F.least("n", F.lit(window)).alias("n")).distinct().collect()})
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema[id_col].dataType.simpleString()}, text_hash long, item_id {benchmark.schema[item_col].dataType.simpleString()}, n_words int, matched_words int, equal_words int, changed_slots int")
    seeds = _seeds(classes, sizes[0], window)
    for size in sizes[1:]:
        seeds = seeds.union(_seeds(classes, size, window))
    seeds = cut(seeds)
    by_hash = F.broadcast(seeds) if seeds.count() <= BROADCAST_WINDOWS else seeds

    keyed = _keyed(docs, id_col, text_col)
    placed = _all_windows(keyed, sizes).join(by_hash, "h").groupBy("doc_id", "text_hash", "class", "n", (F.col("at") - F.col("ipos")).alias("shift")).agg(F.sort_array(F.collect_set("ipos")).alias("places"))
    # Windows side by side cover what an alignment can match at most.
    size = F.least("n", F.lit(window))
    gained = F.aggregate(F.transform("places", lambda x, k: F.when(k == 0, size).otherwise(F.least(x - F.get("places", F.greatest(k - 1, F.lit(0))), size))), F.lit(0), lambda x, y: x + y)
    placed = placed.filter(gained >= F.least("n", F.lit(covered))).select("doc_id", "text_hash", "class", "shift")
    found = placed.join(classed.select("class", "item_id"), "class").groupBy("doc_id", "text_hash", "item_id").agg(F.collect_set("shift").alias("shifts"))
    found = cut(found)

    wanted = cut(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    same = keyed["doc_id"].eqNullSafe(wanted["_id"]) & (keyed["text_hash"] == wanted["_hash"])
    texts = beside(keyed, wanted, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), words_of(marked(F.col("text"))).alias("doc_words"))
    rows = found.join(texts, found["doc_id"].eqNullSafe(texts["_id"]) & (found["text_hash"] == texts["_hash"])).drop("_id", "_hash")
    item = items.select(F.col("item_id").alias("_item"), "marked_words", F.col("n").alias("n_words"))
    rows = rows.join(item, F.col("item_id").eqNullSafe(F.col("_item")))
    need = F.least("n_words", F.lit(covered))
    judged = F.transform("shifts", lambda x: _aligned(F.col("doc_words"), F.col("marked_words"), x, F.least("n_words", F.lit(window))))
    hits = F.filter(judged, lambda j: ((j["matched_words"] >= need) & ~j["clash"]) | (j["equal_words"] >= need))
    best = F.array_max(F.transform(hits, lambda j: F.struct(j["equal_words"].alias("equal_words"), j["matched_words"].alias("matched_words"), j["changed_slots"].alias("changed_slots"))))
    found = rows.select("doc_id", "text_hash", "item_id", "n_words", each(F.array(best)).alias("b")).filter("b IS NOT NULL")
    # An item's text may stand under its id twice.
    found = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("b", "n_words")).alias("m"))
    return found.select("doc_id", "text_hash", "item_id", "m.n_words", "m.b.matched_words", "m.b.equal_words", "m.b.changed_slots")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, whatever their names."""
    i, h = fresh(docs, "id", "hash")
    bad = cut(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct())
    same = docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col], F.lit(1)) == F.col(h))
    return beside(docs, bad, same, "left_anti")


def op8_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).drop("text_hash")
