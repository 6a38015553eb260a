"""SimHash near-duplicates over an inverted index of byte positions."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, cut, dealt, first_of, table
from .components import components
from .similar_texts import labelled

#: Four blocks of two byte positions. Two differing bits spoil two blocks at most, so two blocks of every linked pair are whole.
BLOCKS = ((0, 1), (2, 3), (4, 5), (6, 7))
KEYS = tuple(sorted((*a, *b)) for a, b in combinations(BLOCKS, 2))
#: Bytes that two fingerprints with at most MAX_BITS differing bits share at least.
MAX_BITS = 2
LEAST_BYTES = 8 - MAX_BITS
#: Fingerprints under one key up to which they are paired. Longer lists are linked through shared midpoints instead.
PAIRED_LIST = 48


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text, signed: bit b is set if over half of its shingles' hashes have it."""
    import numpy as np
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for each row of ``docs``, whole texts, in Arrow batches; text_hash tells rows that repeat an id apart."""

    def work(batches):
        for batch in batches:
            made = pa.array([fingerprint(t.as_py(), words) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _byte(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255))


def _posting_keys(fp: Column) -> Column:
    """The keys under which a fingerprint is listed: which four positions, and the bytes there."""
    made = []
    for k, at in enumerate(KEYS):
        value = F.lit(k).cast("long")
        for p in at:
            value = F.shiftleft(value, 8).bitwiseOR(_byte(fp, p))
        made.append(value)
    return F.array(*made)


def _shared_bytes(a: Column, b: Column) -> Column:
    """The tally of byte positions at which two fingerprints agree."""
    return sum((F.when(_byte(a.bitwiseXOR(b), p) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _midpoints(key: Column, fp: Column) -> Column:
    """``fp``, and ``fp`` with one bit changed outside the key's positions. Two fingerprints of one list share one of these iff they differ in two bits or fewer."""
    flips = []
    for k, at in enumerate(KEYS):
        free = [8 * p + b for p in range(8) if p not in at for b in range(8)]
        masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in free])
        flips.append((k, masks))
    which = F.shiftrightunsigned(key, 32)
    chosen = F.when(which == 0, flips[0][1])
    for k, masks in flips[1:]:
        chosen = chosen.when(which == k, masks)
    return F.transform(chosen, lambda m: m.bitwiseXOR(fp))


def links(distinct: DataFrame, paired_list: int = PAIRED_LIST) -> DataFrame:
    """Edges ``(u, v)`` between the distinct fingerprints of ``distinct (fp)`` that connect whatever two differing bits or fewer link.

    Each fingerprint is listed under six keys of four positional bytes. Within a list of up to ``paired_list``
    the shared positional bytes of each pair are tallied, pairs below the guaranteed minimum go, and the bits
    of the rest are counted. A longer list is never paired: its members are grouped by shared midpoints, 33 at
    most to a midpoint, and each group is tied to its least member. That loses no link and adds none between
    fingerprints that aren't connected by links.
    """
    listed = distinct.select("fp", F.explode(_posting_keys(F.col("fp"))).alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    kept = listed.join(sizes, "key")
    short = kept.filter(F.col("n") <= paired_list).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    a, b = F.col("a"), F.col("b")
    pairs = (
        short.select("fps", F.posexplode("fps").alias("at", "a"))
        .select("a", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("b"))
        .filter(_shared_bytes(a, b) >= LEAST_BYTES)
        .filter(F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)
        .select(a.alias("u"), b.alias("v"))
    )
    long = kept.filter(F.col("n") > paired_list)
    stars = (
        long.select("key", "fp", F.explode(_midpoints(F.col("key"), F.col("fp"))).alias("mid"))
        .groupBy("key", "mid")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
        .filter("u <> v")
    )
    return pairs.union(stars).distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, paired_list: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_hash, fp)`` of all rows, and ``(_fp, root, component_id)`` of their distinct fingerprints: those of one component have one root.

    Ids are reduced to the least of a fingerprint where the rows lie, so components meet with one row a fingerprint.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), paired_list))
    rooted = cut(beside(distinct, roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    return prints, cut(rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, paired_list: int = PAIRED_LIST) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row: component_id is the least doc_id among the texts that links reach.

    A null text has no words and the fingerprint zero, as an empty one has, and links like any other. A row
    whose doc_id is null gets its component's least doc_id (null if the component has none). Repeated rows
    stay repeated. Other columns of ``docs`` don't matter. An empty table gives no rows.
    """
    rows, rooted = _labelled(docs, id_col, text_col, words, paired_list)
    return beside(rows, rooted, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float | None = None, paired_list: int = PAIRED_LIST) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: the one with the least id (null comes last), then the least text hash.

    Texts are linked by MAX_BITS differing bits or, if ``similarity`` is given, by that share of equal shingles (see
    ``similar_texts``). Of rows that repeat both id and text one stays. All columns stay as they are, whatever their
    names.
    """
    if similarity is not None:
        return first_of(docs, labelled(docs, id_col, text_col, words, similarity), id_col, text_col)
    rows, rooted = _labelled(docs, id_col, text_col, words, paired_list)
    return first_of(docs, beside(rows, rooted, F.col("fp") == F.col("_fp")).select("doc_id", "text_hash", "root"), id_col, text_col)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(dealt(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
