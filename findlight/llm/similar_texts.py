"""Near copies of a given similarity: wide SimHash fingerprints tell which texts may be alike, and their shingles decide.

Two texts of similarity t (Jaccard, of sets of shingles) have t of their shingles in common. So whatever order all
shingles are put in, the first shingle that they share is among the first n - t*n + 1 of each. Texts are listed under
these, and no pair is missed. (A list by byte positions of fingerprints can't promise that: at similarity 0.8 each
byte is equal with a chance of 0.27 only.) The order puts shingles last that a sample shows to be frequent, which
keeps lists short.

The work goes from what is cheap to what is left. First comes the inverted index of byte positions of the fingerprints,
with count filtering: each text is compared with two texts, the hubs, of the lists under three of its fingerprint's bytes
at once and under its least shingle hashes, if enough bytes of the two are equal; these links, each verified, unite nearly
all of a large group without pairing it. What the index misses, the lists by shingles find.
Then only lists whose texts aren't united yet are searched by fingerprints, and what these connect is searched
shingle by shingle. Both searches look from each text reached at those not reached yet, and only across what isn't
united, so all links count, and only a forest of them is returned.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, cut, first_of
from .components import components

WORDS, SIMILARITY = 5, 0.8
#: Bytes of a fingerprint, and bits beyond the expected ones (39 of 256, give or take 5.7, at similarity 0.8) up to which texts are looked at shingle by shingle: five deviations. Unrelated ones differ in 128, give or take 8.
BYTES, MORE_BITS = 32, 29
#: Texts of fewer shingles differ in some more bits (48 at most), so these are added to the limit.
FEW, FEW_BITS = 16, 12
#: One text of so many is sampled for frequent shingles: those in as many sampled texts, and so many of them at most. They decide the order of shingles only.
SAMPLED, FREQUENT, FREQUENT_MOST = 64, 8, 100_000
#: Byte positions of a fingerprint whose values together are a key of the inverted index. Any two positions meet in few keys.
KEYS = tuple((k, (k + 11) % BYTES, (k + 18) % BYTES) for k in range(0, BYTES, 2))
#: Equal bytes up from which a pair of the index is counted shingle by shingle (8.5 of 32 are expected at similarity 0.8, 0.1 of unrelated texts), and hubs that a text is compared with at most, those of most equal bytes. The lists by shingles see to the rest.
LEAST_BYTES, HUBS = 4, 8
#: Shingles up to which what fingerprints connect is searched at once. More are parted, and each two parts are searched together.
AT_ONCE = 1_000_000
#: Texts up to which a list is searched at once; a longer one is parted likewise.
LIST_AT_ONCE = 50_000


def most_bits(similarity: float) -> int:
    """Differing bits up to which a pair may have ``similarity``, but for texts of FEW shingles."""
    return math.ceil(8 * BYTES * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi) + MORE_BITS


def may_be_alike(prints, size, x: int, rest, similarity: float):
    """Which of ``rest`` may have ``similarity`` with x, by fingerprints (rows of four unsigned longs) and tallies of shingles."""
    import numpy as np

    low, high = np.minimum(size[rest], size[x]), np.maximum(size[rest], size[x])
    bits = np.bitwise_count(prints[rest] ^ prints[x]).sum(axis=-1, dtype=np.int64)
    return (bits <= most_bits(similarity) + FEW_BITS * (low < FEW)) & (low >= similarity * high - 1e-9)


def shingle_hashes(text: str | None, words: int = WORDS):
    """Distinct shingles of a text (A-Z lowered) as rows of 32 hash bytes; one of fewer words is a shingle itself, none for no words."""
    import numpy as np
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros((0, BYTES), np.uint8)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    spans = {joined[a:b] for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)}
    one, digest = xxhash.xxh3_128_digest, bytearray()
    for s in spans:
        digest += one(s, 1) + one(s, 2)
    return np.frombuffer(bytes(digest), np.uint8).reshape(-1, BYTES)


def wide_fingerprint(hashes) -> bytes:
    """Bit b is set if more than half of the shingles have it."""
    import numpy as np

    counts = np.zeros(8 * BYTES, np.int64)
    for at in range(0, len(hashes), 255):
        counts += np.unpackbits(hashes[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def ranks(shingles, frequent=()):
    """0 for each shingle that isn't among the frequent ones (values sorted, and their ranks), else its rank."""
    import numpy as np

    if not len(frequent):
        return np.zeros(len(shingles), np.int64)
    values, rank = frequent
    at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
    return np.where(values[at] == shingles, rank[at], 0)


def prefix(shingles, similarity: float, frequent=()):
    """The shingles that a text is listed under: the first n - similarity * n + 1 of them, frequent ones last, the least frequent of these first."""
    import numpy as np

    n = len(shingles)
    take = min(n, n - math.ceil(similarity * n - 1e-9) + 1)
    return shingles[np.lexsort((shingles, ranks(shingles, frequent)))[:take]]


def _slices(batches, rows: int = 256):
    """The batches in slices, so that a task holds the shingles of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(parts):
    """Arrays of longs as a list array."""
    import numpy as np

    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _longs(hashes):
    """A long for each shingle; a text without words has the one of zero."""
    import numpy as np

    return hashes[:, :8].copy().view("<i8").ravel() if len(hashes) else np.zeros(1, np.int64)


def _frequent(docs: DataFrame, text_col: str, words: int):
    """The frequent shingles of a sample of texts, sorted, and their ranks by frequency; nothing if there are none."""
    import numpy as np

    sample = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).filter(F.pmod("h", F.lit(SAMPLED)) == 0).dropDuplicates(["h"]).select("text")

    def work(batches):
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_longs(shingle_hashes(t.as_py(), words)) for t in batch.column(0)] or [np.zeros(0, np.int64)]))], names=["s"])

    seen = sample.mapInArrow(work, "s long").groupBy("s").count().filter(F.col("count") >= FREQUENT)
    rows = seen.orderBy(F.desc("count"), "s").limit(FREQUENT_MOST).collect()
    values = np.array([r.s for r in rows], np.int64)
    order = np.argsort(values)
    return (values[order], (len(rows) - order).astype(np.int64)) if rows else ()


PRINT = ("f0", "f1", "f2", "f3", "size")


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """``(doc_id, text_hash, f0..f3, size, rare, least, keys)`` of each row.

    The fingerprint, the tally of shingles, the share of them that isn't frequent, the least shingle by each of four
    hashes, and the shingles that it is listed under.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    names = ["doc_id", "text_hash", *PRINT, "rare", "least", "keys"]
    frequent = _frequent(docs, text_col, words)

    def work(batches):
        import numpy as np

        for batch in _slices(batches):
            hashes = [shingle_hashes(t.as_py(), words) for t in batch.column(2)]
            longs = np.frombuffer(b"".join(map(wide_fingerprint, hashes)), "<i8").reshape(-1, 4)
            sets = [_longs(h) for h in hashes]
            least = [h.view("<i8").min(axis=0) if len(h) else np.zeros(4, np.int64) for h in hashes]
            rare = [float((ranks(x, frequent) == 0).mean()) for x in sets]
            keys = [prefix(x, similarity, frequent) for x in sets]
            prints = [pa.array(longs[:, k].copy()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *prints, pa.array([len(x) for x in sets], pa.int32()), pa.array(rare, pa.float64()), _lists(least), _lists(keys)], names=names)

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, f0 long, f1 long, f2 long, f3 long, size int, rare double, least array<bigint>, keys array<bigint>")


def _may_be_alike(a: str, b: str, similarity: float) -> Column:
    """Whether two structs of PRINT may have ``similarity``, by fingerprints and sizes."""
    bits = sum((F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in PRINT[:4]), F.lit(0))
    sizes = F.col(f"{a}.size"), F.col(f"{b}.size")
    few = F.when(F.least(*sizes) < FEW, FEW_BITS).otherwise(0)
    return (bits <= most_bits(similarity) + few) & (F.least(*sizes) >= similarity * F.greatest(*sizes) - 1e-9)


def _posting_keys(prints: tuple[str, ...] = PRINT[:4]) -> Column:
    """The keys under which a fingerprint is listed: which three positions, and the bytes there."""
    from .simhash_dedup import _byte

    return F.array(*[F.xxhash64(F.lit(n), *[_byte(F.col(prints[p // 8]), p % 8) for p in at]) for n, at in enumerate(KEYS)])


def _shared_bytes(a: str, b: str) -> Column:
    """The tally of byte positions at which the fingerprints of two structs of PRINT agree."""
    from .simhash_dedup import _shared_bytes

    return sum((_shared_bytes(F.col(f"{a}.{f}"), F.col(f"{b}.{f}")) for f in PRINT[:4]), F.lit(0))


def _index_links(docs: DataFrame, texts: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """``(u, v)``: verified links of texts with the hubs of their lists: the text with the fewest rare shingles, and the first.

    Lists are by byte positions of fingerprints and by least shingle hashes; the equal bytes of each pair are tallied,
    and only pairs with enough of them are verified.
    """
    member = F.struct("node", *PRINT)
    listed = texts.select("node", "rare", member.alias("m"), F.explode_outer(F.concat("least", _posting_keys())).alias("key"))
    firsts = listed.groupBy("key").agg(F.min(F.struct("rare", "node")).alias("centre"), F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    named = firsts.select(F.col("key").alias("_key"), F.explode_outer(F.array_distinct(F.array("centre.node", "first"))).alias("_hub"))
    hubs = cut(named.join(texts.select(F.col("node").alias("_hub"), member.alias("hub")), "_hub").groupBy("_key").agg(F.collect_list("hub").alias("hubs")))
    pairs = beside(listed.select("m", "key"), hubs, F.col("key") == F.col("_key")).select("m", F.explode("hubs").alias("hub"))
    pairs = pairs.filter((F.col("m.node") != F.col("hub.node")) & _may_be_alike("m", "hub", similarity)).withColumn("shared", _shared_bytes("m", "hub"))
    best = pairs.filter(F.col("shared") >= LEAST_BYTES).groupBy(F.col("m.node").alias("v")).agg(F.collect_set(F.struct("shared", F.col("hub.node").alias("u"))).alias("hubs"))
    pairs = cut(best.select(F.explode_outer(F.slice(F.sort_array("hubs", False), 1, HUBS)).alias("h"), "v").select("h.u", "v"))
    sets = cut(_shingles(docs, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), text_col, words))
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def forest(label, near) -> list[tuple[int, int]]:
    """Pairs of labels that connect what links connect. Things of one label are united already; ``near(x, rest)`` tells which of ``rest`` are linked with x."""
    import numpy as np

    rest, out = np.arange(len(label)), []

    def take(hit):
        nonlocal rest
        got, rest = rest[hit].tolist(), rest[~hit]
        return got

    while len(rest):
        start = label[rest[0]]
        queue = take(label[rest] == start)
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            if hit.any():
                found = np.unique(label[rest[hit]])
                out += [(int(start), int(x)) for x in found]
                queue += take(np.isin(label[rest], found))
    return out


def _batch(pairs):
    """A batch ``(u, v)``."""
    import numpy as np

    at = np.array(pairs, np.int64).reshape(-1, 2)
    return [pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())]


def _coarse(texts: DataFrame, similarity: float, list_at_once: int) -> DataFrame:
    """``(u, v)``: pairs of roots that connect what is listed together and may have ``similarity`` by size and fingerprint. ``texts (node, root, f0..f3, size, keys)``."""
    listed = texts.select("node", "root", F.explode("keys").alias("key"))
    by_key = listed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("nodes"))
    # Lists of united texts tell nothing new, and of those with the same texts one is enough.
    lists = cut(by_key.filter("low <> high").groupBy("n", "nodes", "low", "high").agg(F.min("key").alias("_key")).select("_key", F.col("n").alias("_n")))
    members = beside(texts.select("node", "root", *PRINT, F.explode("keys").alias("key")), lists, F.col("key") == F.col("_key"))
    parts = F.ceil(F.col("_n") / list_at_once).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(2)), parts.cast("long")).cast("int")
    dealt = members.withColumn("part", part).withColumn("other", F.explode(F.when(parts == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), parts - 1), lambda k: k != F.col("part")))))
    filled = dealt.groupBy("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(F.struct("root", *PRINT)).alias("m"))

    def work(batches):
        import numpy as np

        for batch in batches:
            column = batch.column(0)
            flat = column.flatten()
            root, size = flat.field(0).to_numpy(), flat.field(5).to_numpy()
            prints = np.stack([flat.field(k).to_numpy() for k in range(1, 5)], axis=1).view(np.uint64)
            ends, found = np.cumsum([0, *column.value_lengths().to_pylist()]), []

            def near(x, rest, prints=prints, size=size):
                return may_be_alike(prints, size, x, rest, similarity)

            starts, lengths = ends[:-1], np.diff(ends)
            two = starts[lengths == 2]
            hit = two[near(two, two + 1) & (root[two] != root[two + 1])] if len(two) else two
            found += zip(root[hit].tolist(), root[hit + 1].tolist(), strict=True)
            for a, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                found += forest(root[a : a + n], lambda x, rest, a=a, near=near: near(a + x, a + rest))
            yield pa.RecordBatch.from_arrays(_batch(found), names=["u", "v"])

    return filled.select("m").mapInArrow(work, "u long, v long").distinct()


def _shingles(docs: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """``(node, shingles)`` of the texts that are wanted, one row each."""
    rows = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    rows = beside(rows, wanted.select(F.col("node").alias("_node")), F.col("node") == F.col("_node"), "left_semi").dropDuplicates(["node"])

    def work(batches):
        for batch in _slices(batches):
            sets = [_longs(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["node", "shingles"])

    return rows.mapInArrow(work, "node long, shingles array<bigint>")


def linked(root, sets, prints, similarity: float) -> list[tuple[int, int]]:
    """Pairs of roots that connect what pairs of ``similarity`` connect, of texts by their sets of shingles (arrays of longs). Only pairs whose fingerprints allow it are counted shingle by shingle."""
    import numpy as np

    lengths = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    own = np.split(ids, np.cumsum(lengths)[:-1])
    mark = np.zeros(ids.max() + 1, np.int32)

    def near(x, rest):
        hit = may_be_alike(prints, lengths, x, rest, similarity)
        some = rest[hit]
        if len(some):
            mark[own[x]] = 1
            ends = np.cumsum(lengths[some])
            common = np.add.reduceat(mark[np.concatenate([own[y] for y in some])], ends - lengths[some])
            mark[own[x]] = 0
            hit[hit] = common >= similarity * (lengths[some] + lengths[x] - common)
        return hit

    return forest(root, near)


def _verified(grouped: DataFrame, sets: DataFrame, similarity: float, at_once: int) -> DataFrame:
    """``(u, v)``: pairs of roots that connect the pairs of ``similarity`` within each group of ``grouped (node, root, group, f0..f3, size)``.

    Groups are parted by their roots in turn, and parts are searched two by two, but for two that hold one root only.
    """
    so_far = F.sum("size").over(Window.partitionBy("group").orderBy("root", "node"))
    parts = grouped.withColumn("part", F.floor((so_far - 1) / at_once))
    held = parts.groupBy("group", "part").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    held = held.groupBy(F.col("group").alias("_group")).agg(F.collect_list(F.struct("part", "low", "high")).alias("held"))
    both = parts.join(held, F.col("group") == F.col("_group"))
    mine = lambda k: (k["low"] == k["high"]) & (k["low"] == F.col("root"))
    pure = F.exists("held", lambda k: (k["part"] == F.col("part")) & mine(k))
    others = F.transform(F.filter("held", lambda k: (k["part"] != F.col("part")) & ~(pure & mine(k))), lambda k: k["part"])
    dealt = both.select("node", "root", "group", *PRINT[:4], "part", F.explode(F.when(F.size("held") == 1, F.array("part")).otherwise(others)).alias("other")).join(sets, "node")
    dealt = dealt.select("group", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "root", *PRINT[:4], "shingles")

    def work(table):
        import numpy as np

        prints = np.stack([table.column(f).to_numpy() for f in PRINT[:4]], axis=1).view(np.uint64)
        sets = [x.values.to_numpy() for x in table.column("shingles").combine_chunks()]
        return pa.table(_batch(linked(table.column("root").to_numpy(), sets, prints, similarity)), names=["u", "v"])

    return dealt.groupBy("group", "i", "j").applyInArrow(work, "u long, v long")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, at_once: int = AT_ONCE, list_at_once: int = LIST_AT_ONCE) -> DataFrame:
    """``(doc_id, text_hash, root)``: rows that equal texts and links of ``similarity`` (Jaccard, of sets of shingles) or more connect have one root.

    All links count, however many texts resemble one another. Texts without words are alike. A null text is an empty
    one. Columns of ``docs`` but these two don't matter.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = cut(_sketches(docs, "doc_id", "text", words, similarity))
    texts = cut(rows.drop("doc_id").withColumnRenamed("text_hash", "node").dropDuplicates(["node"]))
    united = components(_index_links(docs, texts, "text", words, similarity))
    texts = texts.drop("least", "rare")
    texts = cut(beside(texts, united.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node"))
    groups = components(_coarse(texts, similarity, list_at_once)).select(F.col("node").alias("_root"), F.col("root").alias("group"))
    groups = cut(groups.union(groups.select(F.col("group").alias("_root"), "group").distinct()).distinct())
    grouped = cut(beside(texts.select("node", "root", *PRINT), groups, F.col("root") == F.col("_root")).drop("_root"))
    more = components(_verified(grouped, _shingles(docs, grouped.select("node"), "text", words), similarity, at_once))
    top = beside(texts.select(F.col("node").alias("_node"), F.col("root").alias("_one")), more, F.col("_one") == F.col("node"), "left")
    roots = cut(top.select("_node", F.coalesce("root", "_one").alias("root")).filter("_node <> root"))
    out = beside(rows.select("doc_id", "text_hash"), roots, F.col("text_hash") == F.col("_node"), "left")
    return out.select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near copies: the one with the least id (null comes last), then the least text hash.

    Of rows that repeat both id and text one stays. All columns stay as they are, whatever their names. An empty table gives no rows.
    """
    rows = labelled(docs, id_col, text_col, words, similarity)
    return first_of(docs, rows, id_col, text_col)
