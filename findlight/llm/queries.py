"""The queries of the ten operators, and their SQL where SQL can express them.

What is learned, hashed by Spark's own functions or encoded by a tokenizer isn't SQL; ``quality_statistics`` and
``mix_targets`` are the parts of op5 and op6 that are, by the same code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_tokens import OP7_SQL, op7_chat_tokens
from .common import dealt, table
from .lattice_lm import op4_lattice_lm
from .quality_rules import judged, op5_quality_rules
from .secret_forest import op1_secret_forest
from .simhash_dedup import op3_simhash_dedup
from .sorted_tables import op9_sorted_tables
from .template_decontam import op8_template_decontam
from .token_counts import op2_token_counts
from .virtual_slots import op10_virtual_slots
from .water_filling import mix, op6_water_filling


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 counts in each document, without its verdict."""
    made = judged(dealt(table(spark, sf_dir, "documents")), [])
    return made.select("doc_id", *[f"judged.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
STATISTICS_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS pos, w FROM d WHERE len(w) >= 8),
h AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 7], ' ') AS win FROM v),
r AS (SELECT doc_id, pos FROM h WHERE (doc_id, win) IN (SELECT doc_id, win FROM h GROUP BY 1, 2 HAVING count(*) > 1)),
c AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, range(8) AS t(k) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op6."""
    made = mix(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "mixed.size", "mixed.source_size", F.round("mixed.target", 3).alias("target"))


#: The level at which the targets add up: above those capped, in the order of the levels at which they are.
TARGETS_SQL = rf"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM d GROUP BY 1),
w AS (SELECT *, ((k - 1) % 3 + 1)::DOUBLE AS weight, 3.0 * source_size / ((k - 1) % 3 + 1) AS full_at FROM s),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY full_at, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WHERE source_size > 0),
x AS (SELECT arg_min(level, full_at) AS level FROM o WHERE level <= full_at)
SELECT doc_id, size, source_size, round(CASE WHEN source_size = 0 THEN 0 ELSE least(3.0 * source_size, weight * coalesce(x.level, 1e300)) END, 3)::DOUBLE AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, x"""

QUERIES = {
    "op1_secret_forest": op1_secret_forest,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_quality_rules": op5_quality_rules,
    "op6_water_filling": op6_water_filling,
    "op7_chat_tokens": op7_chat_tokens,
    "op8_template_decontam": op8_template_decontam,
    "op9_sorted_tables": op9_sorted_tables,
    "op10_virtual_slots": op10_virtual_slots,
    "quality_statistics": quality_statistics,
    "mix_targets": mix_targets,
}

ORACLE_SQL: dict[str, str] = {"op7_chat_tokens": OP7_SQL, "quality_statistics": STATISTICS_SQL, "mix_targets": TARGETS_SQL}
