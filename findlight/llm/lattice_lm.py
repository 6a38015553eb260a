"""Subword lattice likelihood: the probability of a text over all its segmentations into pieces of an existing vocabulary."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_table, table

START = "▁"
#: Half of the text that one chunk's dictionary is made of (or the rest of a partition); a chunk is what one task holds of texts.
CHUNK_BYTES = 16 << 20
#: Rounds of expectation-maximization over the distinct training words, and the weight, in pieces, of the vocabulary's own scores.
ROUNDS = 2
PRIOR_PIECES = 500.0
#: Taken off each training word's count, as a piece of its own, and given to the vocabulary's pieces, to spell words.
DISCOUNT = 0.65


@dataclass(frozen=True)
class Pieces:
    """Natural log probabilities of pieces, of the 256 bytes that stand in for characters without a piece, and of the end."""

    piece: Mapping[str, float]
    byte: tuple[float, ...]
    end: float

    @cached_property
    def begun(self) -> dict[str, float | None]:
        """Every beginning of a piece: its log probability if it is a piece itself, else None."""
        out: dict[str, float | None] = {p[:k]: None for p in self.piece for k in range(1, len(p))}
        return out | dict(self.piece)

    @cached_property
    def chances(self) -> dict[str, float]:
        """As ``begun``, with probabilities: 0 for a beginning that is no piece."""
        return {p: 0.0 if x is None else math.exp(x) for p, x in self.begun.items()}

    def edges(self, word: str) -> tuple[int, list[tuple[int, int, str, float]]]:
        """The length of the marked word and its lattice (from, to, piece, log probability), by ``from``."""
        s, begun = START + word, self.begun
        n, out = len(s), []
        for i in range(n):
            single = False
            for j in range(i + 1, n + 1):
                part = s[i:j]
                if part not in begun:
                    break
                p = begun[part]
                if p is not None:
                    out.append((i, j, part, p))
                    single = single or j == i + 1
            if not single:
                out.append((i, i + 1, "", sum(self.byte[b] for b in s[i].encode("utf-8", "surrogatepass"))))
        return n, out

    def log_probability(self, word: str, whole: float | None = None, share: float = 0.0) -> float:
        """The forward recursion in log space: the log of the sum, over all segmentations, of the products of piece probabilities.

        ``whole`` is the log probability of the word as one piece of the corpus, if it is one; all other ways to spell
        it share ``share`` (a log probability), which stands on the edges that begin the word.
        """
        n, edges = self.edges(word)
        if share:
            edges = [(i, j, piece, p if i else p + share) for i, j, piece, p in edges]
        if whole is not None:
            edges = [(0, n, "", whole), *edges]
        return _forward(n, edges)[n]


def _forward(n: int, edges: list) -> list[float]:
    exp, log1p = math.exp, math.log1p
    a: list = [0.0] + [None] * n
    for i, j, _, p in edges:
        if a[i] is None:
            continue
        x, y = a[i] + p, a[j]
        a[j] = x if y is None else (y + log1p(exp(x - y)) if y > x else x + log1p(exp(y - x)))
    return a


#: Below this the product of a word's probabilities is left to logarithms.
LEAST = 1e-250


def expected(pieces: Pieces, word: str, count: float, into: dict[str, float], bytes_into: list[float]) -> None:
    """Adds ``count`` times the expected use of each piece in the word's segmentations: forward, then backward; by plain products where the word's probability is no less than LEAST."""
    s, chances = START + word, pieces.chances
    n, edges = len(s), []
    a = [1.0] + [0.0] * n
    for i in range(n):
        here, single = a[i], False
        for j in range(i + 1, n + 1):
            part = s[i:j]
            p = chances.get(part)
            if p is None:
                break
            if p:
                a[j] += here * p
                edges.append((i, j, part, p))
                single = single or j == i + 1
        if not single:
            p = math.exp(sum(pieces.byte[b] for b in s[i].encode("utf-8", "surrogatepass")))
            a[i + 1] += here * p
            edges.append((i, i + 1, "", p))
    total = a[n]
    if total < LEAST:
        _expected_by_logs(pieces, word, count, into, bytes_into)
        return
    b = [0.0] * n + [count / total]
    for i, j, piece, p in reversed(edges):
        rest = p * b[j]
        b[i] += rest
        use = a[i] * rest
        if piece:
            into[piece] = into.get(piece, 0.0) + use
        else:
            for byte in s[i].encode("utf-8", "surrogatepass"):
                bytes_into[byte] += use


def _expected_by_logs(pieces: Pieces, word: str, count: float, into: dict[str, float], bytes_into: list[float]) -> None:
    n, edges = pieces.edges(word)
    a = _forward(n, edges)
    exp, log1p, total = math.exp, math.log1p, a[n]
    b: list = [None] * n + [0.0]
    for i, j, piece, p in reversed(edges):
        if a[i] is None or b[j] is None:
            continue
        x, y = b[j] + p, b[i]
        b[i] = x if y is None else (y + log1p(exp(x - y)) if y > x else x + log1p(exp(y - x)))
        use = count * exp(a[i] + p + b[j] - total)
        if piece:
            into[piece] = into.get(piece, 0.0) + use
        else:
            for byte in (START + word)[i].encode("utf-8", "surrogatepass"):
                bytes_into[byte] += use


def vocabulary(path: str) -> tuple[dict[str, float], list[float]]:
    """Weights, by their sum 1, of the pieces and of the 256 bytes of a sentencepiece model.

    Scores of a unigram model are log probabilities. Scores of a merge model are its ranks, negative whole
    numbers; the piece of rank r weighs 1 / (r + 10), as words' frequencies fall with their rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    plain = {model.id_to_piece(i): model.get_score(i) for i in ids if not model.is_byte(i)}
    if all(x <= 0 and x == int(x) for x in plain.values()):
        order = sorted(plain, key=lambda p: (-plain[p], p))
        weight = {p: 1.0 / (r + 10) for r, p in enumerate(order)}
    else:
        weight = {p: math.exp(x) for p, x in plain.items()}
    least = min(weight.values(), default=1.0)
    total = sum(weight.values()) + 256 * least
    return {p: w / total for p, w in weight.items()}, [least / total] * 256


def _model(piece: Mapping[str, float], byte: list[float], ends: float) -> Pieces:
    """Pieces of these weights; the end has the weight ``ends`` and half a count."""
    total = sum(piece.values()) + sum(byte) + ends + 0.5
    return Pieces({p: math.log(w / total) for p, w in piece.items() if w > 0}, tuple(math.log(w / total) for w in byte), math.log((ends + 0.5) / total))


def fit(words: DataFrame, path: str, rounds: int = ROUNDS, prior: float = PRIOR_PIECES) -> Pieces:
    """The pieces' probabilities after ``rounds`` over the distinct training words of ``words (word, c)``, from the vocabulary's weights and towards them.

    Each word counts once, as frequent ones are pieces themselves and the vocabulary is left with those that
    are new. Each task adds up its words' expected counts and sends one row for each piece it met; the driver
    gets one row for each piece of the vocabulary, which is fixed.
    """
    weight, byte = vocabulary(path)
    pieces = _model(weight, byte, 0.0)
    for _ in range(rounds):

        def work(batches, now=pieces):
            into, in_bytes = {}, [0.0] * 256
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    expected(now, word, 1.0, into, in_bytes)
            names = [*into, *(f"<{b}>" for b in range(256))]
            uses = [*into.values(), *in_bytes]
            is_byte = [False] * len(into) + [True] * 256
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(is_byte), pa.array(uses, pa.float64())], names=["piece", "is_byte", "uses"])

        found = words.filter("c > 0").select("word").mapInArrow(work, "piece string, is_byte boolean, uses double")
        uses = {(r.piece, r.is_byte): r.uses for r in found.groupBy("piece", "is_byte").agg(F.sum("uses").alias("uses")).collect()}
        pieces = _model({p: w * prior + uses.get((p, False), 0.0) for p, w in weight.items()}, [w * prior + uses.get((f"<{b}>", True), 0.0) for b, w in enumerate(byte)], 0.0)
    return pieces


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs (doc_id, text, held_out)`` as chunks: for each a dictionary of its words with their counts in training texts, and its texts as places in that dictionary.

    Rows of kind 0: chunk, doc_id, held_out, places (32-bit little-endian). Rows of kind 1: chunk, place, word, c.
    """

    def work(batches):
        import numpy as np
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        place: dict[bytes, int] = {}
        counts = np.zeros(1 << 16, np.int64)
        texts: list = []
        size = 0

        def flush():
            nonlocal place, texts, size, number, counts
            n, m = len(texts), len(place)
            if n:
                ids, held, places = zip(*texts, strict=True)
                yield made([0] * n, pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(places, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()))
            words = list(place)
            for at in range(0, m, 50_000):
                part = [w.decode("utf-8", "surrogatepass") for w in words[at : at + 50_000]]
                k = len(part)
                yield made([1] * k, pa.nulls(k, id_type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()), pa.array(range(at, at + k), pa.int32()), pa.array(part, pa.string()), pa.array(counts[at : at + k].copy(), pa.int64()))
            number += 1
            place, texts, size, counts = {}, [], 0, np.zeros(1 << 16, np.int64)

        def made(kind, *columns):
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array([number] * len(kind), pa.int64()), *columns], names=["kind", "chunk", "doc_id", "held_out", "places", "place", "word", "c"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text, held in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                got = np.fromiter((place.setdefault(w, len(place)) for w in data), np.uint32, len(data))
                if len(place) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(place)), np.int64)])
                if not held.as_py() and len(got):
                    where, times = np.unique(got, return_counts=True)
                    counts[where] += times
                texts.append((doc_id.as_py(), held.as_py(), got.astype("<u4").tobytes()))
                size += sum(map(len, data)) + 8 * len(data) + 8
                if size >= 2 * chunk_bytes:
                    yield from flush()
        yield from flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(work, f"kind int, chunk long, doc_id {kind}, held_out boolean, places binary, place int, word string, c long")


@dataclass(frozen=True)
class Shares:
    """What the next of ``words`` words and ``ends`` ends in training is: a word of its own piece, one that is spelled, or the end. With half a count each for what was never seen, they add up to 1."""

    words: int
    kinds: int
    ends: int

    @property
    def _all(self) -> float:
        return self.words + self.ends + 1.0

    def whole(self, count: int) -> float | None:
        """The log probability of a training word as one piece."""
        return math.log((count - DISCOUNT) / self._all) if count else None

    @property
    def spelled(self) -> float:
        return math.log((DISCOUNT * self.kinds + 0.5) / self._all)

    @property
    def end(self) -> float:
        return math.log((self.ends + 0.5) / self._all)


def score(docs: DataFrame, vocabulary_path: str, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs (doc_id, text, held_out)`` -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lowered (A-Z) and parted at white space; a token is a word or the text's end. base_score is the
    add-one unigram's over the words of the rows with held_out false; score is the log10 probability that pieces
    drawn one by one until the end spell the text's words, whatever the segmentation. A piece is one of the
    vocabulary or a whole word of the rows learned from. Only rows with held_out false are learned from. No piece
    goes over a word's border, so the recursion over a text is the product of those over its words, and each
    distinct word's lattice is computed once, whatever the number of texts it is in.

    A null, empty or blank text is its end alone. Without training rows N, V and all counts are 0. Repeated rows
    are rows of their own; other columns don't matter; an empty table gives no rows.
    """
    all_ends = docs.filter("NOT held_out").count()
    parts = kept_table(chunks(docs, chunk_bytes), "kind")
    texts = parts.filter("kind = 0").select("chunk", "doc_id", "held_out", "places")
    listed = parts.filter("kind = 1").select("chunk", "place", "word", "c")
    words = kept_table(listed.groupBy("word").agg(F.sum("c").alias("c")))
    n_words, v_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, kinds = n_words + all_ends, v_words + (all_ends > 0)
    pieces, shares = fit(words, vocabulary_path, rounds), Shares(n_words, v_words, all_ends)

    def weigh(batches):
        for batch in batches:
            found = [pieces.log_probability(w, shares.whole(c), shares.spelled) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["word", "c", "lp"])

    weighed = words.select("word", "c").mapInArrow(weigh, "word string, c long, lp double")
    known = listed.select("chunk", "place", "word").join(weighed, "word").select(F.col("chunk").alias("in_chunk"), "place", "c", "lp")

    def add_up(key, left, right):
        import numpy as np

        place = right.column("place").to_numpy()
        c, lp = np.zeros(len(place)), np.zeros(len(place))
        c[place], lp[place] = right.column("c").to_numpy(), right.column("lp").to_numpy()
        base, hit, bottom = np.log10(c + 1), (c > 0).astype(np.int64), math.log10(total + kinds + 1)
        out: list = [[], [], [], []]
        for places in left.column("places"):
            at = np.frombuffer(places.as_buffer(), "<u4")
            row = (len(at) + 1, int(hit[at].sum()) + (all_ends > 0), float(base[at].sum()) + math.log10(all_ends + 1) - (len(at) + 1) * bottom, (float(lp[at].sum()) + shares.end) / math.log(10))
            for column, x in zip(out, row, strict=True):
                column.append(x)
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        made = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
        return pa.table([left.column("doc_id"), left.column("held_out"), made[0], made[1], pa.array([total] * left.num_rows, pa.int64()), made[2], made[3]], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = texts.groupBy("chunk").cogroup(known.groupBy("in_chunk"))
    return both.applyInArrow(add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """``docs`` as (doc_id, text, held_out): held out where crc32 of the id's text, mod ``folds``, is ``fold`` (a null id's text is empty)."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.crc32(name.cast("binary")) % folds == fold).alias("held_out"))


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(held_out(table(spark, sf_dir, "documents")), vocabulary_path())
