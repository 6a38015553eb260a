"""Secret scan: candidates by pattern, false positives removed by a random forest trained from labelled findings."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, dealt, each, let, table, words_of

#: Labelled findings that the forest is trained from, at most (those with the least hash), and its size.
TRAIN_ROWS, TREES, DEPTH, SEED = 4000, 24, 7, 17
THRESHOLD = 0.5
#: A word can be a finding from this length on.
SHORTEST = 8

# What a candidate looks like, and words that speak for or against a secret when they stand near.
_RUN = r"[A-Za-z0-9+/_=-]{16,}"
_ASSIGNED = r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s*[:=]+>?\s*[\"']?[^\s\"']{8,}"
_PROVIDER = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
#: A telling name before a value that stands apart, and such a pair in a text.
_TELLING = r"(?:passw(?:or)?d|pwd|secret|token|key|auth|credential)s?[\"']?"
_APART = rf"(?iu){_TELLING}(?:[{SPACE}]+[=:]+>?|[=:]+)[{SPACE}]+[^{SPACE}]{{8,}}"
#: What parts a word into its own assignments and values, and a run without what it may be assigned to.
_PARTS = r"[{}\[\](),;&?|<>@#]+"
_LONE_RUN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
FOR = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access", "auth", "authorization", "bearer", "credential", "credentials", "private")
AGAINST = ("sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "commit", "revision", "uuid", "guid", "id", "example", "sample", "dummy", "placeholder", "changeme", "test", "fake", "redacted", "isbn", "order", "invoice", "card", "phone", "ip", "version")
PATHS_AGAINST = r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|fixtures?|docs?|mocks?|vendor|node_modules)(?:[/_.-]|$)"
DICTIONARY = (
    "the", "and", "for", "that", "with", "this", "from", "have", "your", "name", "user", "data", "file", "path", "home", "http", "https", "www", "com", "org", "html", "index", "page", "value", "test", "example", "sample", "default", "config", "number", "string", "function", "class", "return", "import", "public", "static",
    "password", "secret", "token", "access", "change", "placeholder", "here", "insert", "enter", "dummy", "redacted", "xxxx", "abcd", "1234", "tion", "ing", "ment", "ness", "able", "ous", "ent", "heit", "keit", "ung", "lich", "sch", "cion", "ción", "mente", "que", "eau", "eux", "oir", "elle", "ado", "ere", "tha", "thi", "ion",
)
FEATURES = ("length", "digit_share", "upper_share", "symbol_share", "class_changes", "vowel_pairs", "letter_pairs", "hex_only", "digits_only", "kinds_share", "dictionary_share", "repeat_share", "provider", "assigned", "quoted", "near_for", "near_against", "path_against")


def _is_candidate(word: Column) -> Column:
    """A word with a long run of key characters that has digits, or of a provider's form; with what is assigned to a telling name as well."""
    run = word.rlike(_RUN) & word.rlike(r"[0-9]") & (word.rlike(r"[A-Za-z]") | word.rlike(r"[0-9]{16,}"))
    return run | word.rlike(_ASSIGNED) | word.rlike(_PROVIDER)


def _value(word: Column) -> Column:
    """What is left of a word without a name assigned to, quotes and punctuation around."""
    bare = F.regexp_replace(word, r"^[^=:]*[A-Za-z_]['\"]?[=:]+>?(?=.)", "")
    bare = F.regexp_replace(bare, r"^[\"'`]([^\"'`]+)[\"'`].*$", "$1")
    return F.regexp_replace(bare, r"^[\"'`(<\[{,;]+|[\"'`)>\]},;.!?#*$%&|]+$", "")


def _within(word: Column) -> Column:
    """``(value, order, word)`` of each value in a word that is a candidate: the word's own, those of its parts with their names, provider keys, and runs. Equal ones count once."""
    parts = F.filter(F.split(word, _PARTS), _is_candidate)
    runs = F.filter(F.regexp_extract_all(word, F.lit(_LONE_RUN), F.lit(0)), _is_candidate)
    kinds = F.array(F.array(word), parts, F.regexp_extract_all(word, F.lit(_PROVIDER), F.lit(0)), runs)
    all_ = F.flatten(F.transform(kinds, lambda ws, k: F.transform(ws, lambda w: F.struct(_value(w).alias("value"), k.alias("order"), w.alias("word")))))
    once = let(F.array_sort(all_), lambda v: F.filter(v, lambda x, k: (k == 0) | (F.get(v, F.greatest(k - 1, F.lit(0)))["value"] != x["value"])))
    return F.when(word.rlike(_PARTS), once).otherwise(F.array(F.struct(_value(word).alias("value"), F.lit(0).alias("order"), word.alias("word"))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", filtered: bool = True) -> DataFrame:
    """``(doc_id, path, at, word, value, before, after)`` of each candidate in whole texts: the place of its word, the part of the word that it is, and the words beside it (three before, two after, lowered).

    Texts that can have none go first, if ``filtered``; the result is the same.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    hot = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    # Most texts have none; they are told by four searches each, before any is parted into words.
    if filtered:
        hot = hot.filter(F.col("text").rlike(r"[0-9]") & (F.col("text").rlike(_RUN) | F.col("text").rlike(_PROVIDER)) | F.col("text").rlike(_ASSIGNED) | F.col("text").rlike(_APART))
    telling = f"(?i){_TELLING}"

    def pick(words: Column) -> Column:
        near = lambda i, d: F.coalesce(F.lower(F.get(words, i + d)), F.lit(""))
        rows = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))

        def wanted(r: Column) -> Column:
            i = r["at"]
            value_of = (near(i, F.lit(-1)).rlike(r"^[=:]+>?$") & near(i, F.lit(-2)).rlike(telling + "$")) | near(i, F.lit(-1)).rlike(telling + "[=:]+$")
            return _is_candidate(r["word"]) | ((F.length(r["word"]) >= SHORTEST) & value_of & r["word"].rlike(r"[0-9!@#$%^&*]"))

        return F.transform(
            F.filter(rows, wanted),
            lambda r: F.struct(r["at"], r["word"], F.array(*[near(r["at"], F.lit(-d)) for d in (1, 2, 3)]).alias("before"), F.array(near(r["at"], F.lit(1)), near(r["at"], F.lit(2))).alias("after")),
        )

    found = hot.select("doc_id", "path", each(let(words_of(F.col("text")), pick)).alias("c")).filter("c IS NOT NULL")
    found = found.select("doc_id", "path", "c", each(_within(F.col("c.word"))).alias("v")).filter("v IS NOT NULL")
    return found.select("doc_id", "path", "c.at", "v.word", "v.value", "c.before", "c.after").filter(F.length("value") >= SHORTEST)


def features(found: DataFrame) -> DataFrame:
    """``found`` with one column for each of FEATURES, all of built-in functions."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    share = lambda pattern: 1.0 - F.length(F.regexp_replace(v, pattern, "")) / n
    pairs = lambda pattern: F.size(F.regexp_extract_all(v, F.lit(f"(?={pattern})."), F.lit(0))) / n
    near = F.concat("before", F.slice("after", 1, 1))
    words = F.transform(near, lambda w: F.regexp_replace(w, r"[^a-z0-9_]+", ""))
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(x) for x in names])) | F.exists(near, lambda w: w.rlike("(?:^|[^a-z0-9])(?:" + "|".join(names) + ")[\"']?[=:]"))
    own = F.lower(F.regexp_extract("word", r"^([^=:]*[A-Za-z_])['\"]?[=:]", 1))
    own_is = lambda names: own.rlike("(?:^|[^a-z0-9])(?:" + "|".join(names) + ")$")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "length": F.length("value").cast("double"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "symbol_share": share("[A-Za-z0-9]"),
        "class_changes": pairs("[a-z][A-Z0-9]|[A-Z][a-z0-9]|[0-9][A-Za-z]"),
        "vowel_pairs": pairs("(?i:[aeiou][bcdfghjklmnpqrstvwxyz]|[bcdfghjklmnpqrstvwxyz][aeiou])"),
        "letter_pairs": pairs("[A-Za-z][A-Za-z]"),
        "hex_only": flag(v.rlike("^(?:0x)?[0-9a-fA-F]+$")),
        "digits_only": flag(v.rlike("^[0-9.+-]+$")),
        "kinds_share": F.size(F.array_distinct(F.split(v, ""))) / n,
        "dictionary_share": share("(?i)" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))),
        "repeat_share": share(r"(.)\1{2,}"),
        "provider": flag(F.col("word").rlike(_PROVIDER)),
        "assigned": flag(F.col("word").rlike(_ASSIGNED) | F.get("before", F.lit(0)).rlike("[=:]$")),
        "quoted": flag(F.col("word").rlike("^[\"'`]|[\"'`]$|[=:][\"'`]")),
        "near_for": flag(has(FOR) | own_is(FOR)),
        "near_against": flag(has(AGAINST) | own_is(AGAINST)),
        "path_against": flag(F.col("path").rlike(PATHS_AGAINST)),
    }
    made["symbol_share"] = 1.0 - made["symbol_share"]
    return found.withColumns({k: made[k].cast("double") for k in FEATURES})


def synthetic_findings(spark: SparkSession, rows: int = 2400) -> DataFrame:
    """Labelled findings by rule, where a project has none of its own: ``(path, word, value, before, after, is_secret)``.

    Values are made from SHA-512 of the row's number. A third are keys after telling names; the others are what
    scanners mistake for them: checksums and commits, identifiers, card and order numbers, placeholders, long
    words, paths, and keys in tests and examples.
    """
    h, i = F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")), 512), F.col("id")
    b64 = F.regexp_replace(F.base64(F.unhex(h)), r"[\s=]", "")
    pick = lambda names, salt: F.get(F.array(*[F.lit(x) for x in names]), F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(names))).cast("int"))
    long = lambda c, lo, hi: F.substring(c, F.lit(1), (F.pmod(F.xxhash64(F.lit("n"), i), F.lit(hi - lo + 1)) + lo).cast("int"))
    digits = lambda n: F.substring(F.translate(h, "abcdef", "123456"), 1, n)
    syllables = ("tion", "er", "the", "ing", "con", "ment", "al", "pre", "ver", "lich", "ado", "eau", "is", "re")
    word = F.concat(*[pick(syllables, f"s{k}") for k in range(9)])
    plain, kind = ("and", "of", "in", "it", "le", "der", "que", "with"), F.pmod(i, F.lit(18))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    calm, near_for, near_against = pick(plain, "p"), pick(FOR, "f"), pick(AGAINST, "a")
    cases = [
        (F.substring(h, 1, 40), near_for, 1, "="), (F.substring(h, 1, 64), near_for, 1, ":"), (long(b64, 20, 60), near_for, 1, "="), (F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), calm, 1, ""),
        (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "x"), 1, 36)), calm, 1, ""), (long(F.regexp_replace(b64, "[+/]", "!"), 10, 18), near_for, 1, "="), (F.substring(h, 1, 32), near_for, 1, "="),
        (F.substring(h, 1, 40), near_against, 0, ""), (F.substring(h, 1, 64), near_against, 0, ":"), (F.substring(h, 1, 32), near_against, 0, "="), (uuid, pick((*plain, "id", "uuid"), "u"), 0, ""), (digits(16), pick((*plain, "card", "order"), "c"), 0, ""),
        (F.concat(F.lit("your_"), pick(("api_key", "secret", "token", "password"), "y"), F.lit("_here_"), F.substring(i.cast("string"), 1, 2)), near_for, 0, "="), (F.concat(F.repeat(pick(("x", "0", "a", "1234"), "r"), 12), F.lit("1")), near_for, 0, "="),
        (F.concat(word, F.substring(i.cast("string"), 1, 2)), calm, 0, ""), (F.concat(F.lit("src/"), pick(syllables, "d"), F.lit("/main/"), word, F.lit("2.html")), calm, 0, ""), (F.concat(word, F.lit("@mail"), F.substring(i.cast("string"), 1, 1), F.lit(".example.com")), calm, 0, ""), (F.substring(h, 1, 40), calm, 0, ""),
    ]
    choose = lambda at: reduce(lambda acc, k: acc.when(kind == k, F.lit(cases[k][at]) if isinstance(cases[k][at], int | str) else cases[k][at]), range(1, len(cases)), F.when(kind == 0, F.lit(cases[0][at]) if isinstance(cases[0][at], int | str) else cases[0][at]))
    value, name, sign = choose(0), choose(1), choose(3)
    shape = F.pmod(F.xxhash64(F.lit("shape"), i), F.lit(3))
    quote = F.when(F.pmod(F.xxhash64(F.lit("q"), i), F.lit(2)) == 0, F.lit('"')).otherwise("")
    joined = F.when((sign != "") & (shape == 0), F.concat(name, sign, quote, value, quote)).otherwise(F.concat(quote, value, quote))
    before = F.when(sign == "", F.array(name, calm, calm)).when(shape == 0, F.array(calm, calm, calm)).when(shape == 1, F.array(F.concat(name, sign), calm, calm)).otherwise(F.array(sign, name, calm))
    in_tests = F.pmod(F.xxhash64(F.lit("t"), i), F.lit(12)) == 0
    path = F.when(in_tests, "tests/fixtures/case.py").otherwise(pick(("src0", "src7", "app/config.py", "deploy/env", ""), "path"))
    made = spark.range(0, rows, 1, 4).select(path.alias("path"), joined.alias("word"), value.alias("value"), before.alias("before"), F.array(calm, calm).alias("after"), ((choose(2) == 1) & ~in_tests).cast("double").alias("is_secret"))
    return made


def train(findings: DataFrame, train_rows: int = TRAIN_ROWS) -> RandomForestClassificationModel | None:
    """A forest from ``findings (path, word, value, before, after, is_secret 0/1)``, up to ``train_rows`` of them; None if they aren't of two kinds."""
    known = findings.filter("is_secret IN (0, 1) AND value IS NOT NULL AND word IS NOT NULL").fillna({"path": ""})
    known = known.withColumn("_h", F.xxhash64("value", "word", "path")).orderBy("_h", "value", "word").limit(train_rows)
    known = features(known).select("is_secret", *FEATURES).cache()
    if known.select("is_secret").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="is_secret", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32)
    model = forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known))
    known.unpersist()
    return model


def scan(docs: DataFrame, model: RandomForestClassificationModel | None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, at, value, score, is_secret)`` of each candidate of ``docs``; without a model each candidate counts.

    ``at`` is the place of the word in the text, from 0; a word may hold several. A null or empty text has none, a null id or path is
    found like any other, repeated rows give repeated findings, other columns don't matter, and an empty table
    gives no rows.
    """
    found = features(candidates(docs, id_col, text_col, path_col))
    if model is None:
        return found.select("doc_id", "at", "value", F.lit(1.0).alias("score"), F.lit(True).alias("is_secret"))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    score = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return scored.select("doc_id", "at", "value", score.alias("score"), (score >= threshold).alias("is_secret"))


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(synthetic_findings(spark))
    return scan(dealt(table(spark, sf_dir, "documents")), model).select("doc_id", "at", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "score", "is_secret")
