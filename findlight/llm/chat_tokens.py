"""Chat formatting at the level of tokens: segments are encoded apart, reserved ids are spliced between them, and the loss mask follows from prefix sums."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Reserved ids, beyond the vocabulary's own, and the control strings that a reader shows for them.
TURN, TEXT, END = 50257, 50258, 50259
SHOWN = {TURN: "<turn>", TEXT: "\n", END: "</turn>\n"}
#: Strings that mean something to a reader of the shown form. Inside roles and texts a backslash goes before each, and before each backslash.
CONTROLS = ("<turn>", "</turn>", "### User:", "### Assistant:", "### System:", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_UNESCAPE = re.compile(r"\\(" + "|".join([r"\\", *map(re.escape, CONTROLS)]) + ")")
LEARNED_ROLE = "assistant"
#: Ids after which a conversation goes on in another row.
PART_IDS = 1 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@lru_cache(2)
def encoding(path: str):
    """A byte-level encoding from a file of ranks; every text comes back from its ids as it was, and no text gives a reserved id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def formatted(conversations: DataFrame, tokenizer: str | None = None, part_ids: int = PART_IDS) -> DataFrame:
    """``(conv_id, part, start, ids, mask_from, mask_to)``: each conversation's ids (32-bit little-endian), and where the loss mask is on.

    ``conversations (conv_id, turn, role, text)``. Each turn is TURN role TEXT text END; role and text are
    escaped and encoded by themselves, so their tokens don't depend on what stands beside them. Masks cover
    the texts of assistants: positions, as prefix sums of segment lengths over the conversation, from
    (inclusive) and to (exclusive). A conversation over ``part_ids`` ids goes on in further parts, cut between
    turns, so that no row holds a very long one whole; parts follow one another in a partition. The turns of one
    conversation stream through one task, as each position depends on those before.

    Rows go by turn (null first), then by role and text, so repeated turns stay and reruns agree; a null role or
    text is empty; rows of a null conv_id are one conversation; no rows give none; other columns don't matter.
    """
    path = tokenizer or tokenizer_path()
    slim = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = slim.schema["conv_id"].dataType.simpleString()

    def encode(batches):
        own = encoding(path).encode_ordinary
        for batch in batches:
            roles = [_ids(own(escape(r))) for r in batch.column(2).to_pylist()]
            texts = [_ids(own(escape(t))) for t in batch.column(3).to_pylist()]
            learned = [r == LEARNED_ROLE for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roles, pa.binary()), pa.array(texts, pa.binary()), pa.array(learned)], names=[*batch.schema.names, "role_ids", "text_ids", "learned"])

    turns = slim.mapInArrow(encode, f"conv_id {kind}, turn {slim.schema['turn'].dataType.simpleString()}, role string, text string, role_ids binary, text_ids binary, learned boolean")
    turns = turns.withColumns({"text_key": F.sha2("text", 256)}).drop("text")
    together = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text_key")

    def assemble(batches):
        part = Part(None)
        first = True
        for batch in batches:
            id_type = batch.schema.field(0).type
            conv, role, text, learned = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "role_ids", "text_ids", "learned"))
            done = []
            for c, r, t, on in zip(conv, role, text, learned, strict=True):
                if first or c != part.conv:
                    done += part.rows()
                    part, first = Part(c), False
                elif part.size >= part_ids:
                    done += part.rows()
                    part = part.next()
                part.add(r, t, on)
            if done:
                yield _rows(done, id_type)
        if not first and part.ids:
            yield _rows(part.rows(), id_type)

    return together.mapInArrow(assemble, f"conv_id {kind}, part int, start long, ids binary, mask_from array<bigint>, mask_to array<bigint>")


def _ids(ids: list[int]) -> bytes:
    import numpy as np

    return np.array(ids, "<u4").tobytes()


class Part:
    """Ids of consecutive turns of one conversation, and the prefix sum at which they start."""

    def __init__(self, conv, number: int = 0, start: int = 0):
        self.conv, self.number, self.start = conv, number, start
        self.size, self.ids, self.on, self.off = 0, [], [], []

    def add(self, role: bytes, text: bytes, learned: bool) -> None:
        turn, mid, end = (x.to_bytes(4, "little") for x in (TURN, TEXT, END))
        at = self.start + self.size + 2 + len(role) // 4
        self.ids += [turn, role, mid, text, end]
        self.size += 3 + (len(role) + len(text)) // 4
        if learned:
            self.on.append(at)
            self.off.append(at + len(text) // 4)

    def rows(self) -> list[tuple]:
        return [(self.conv, self.number, self.start, b"".join(self.ids), self.on, self.off)] if self.ids else []

    def next(self) -> Part:
        return Part(self.conv, self.number + 1, self.start + self.size)


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "part", "start", "ids", "mask_from", "mask_to"])


def turns_of(data: bytes, tokenizer: str) -> list[tuple[str, str, int, int, int]]:
    """(role, text, position of the text's first id, and of its END, characters shown) of each turn in the ids of a part."""
    import numpy as np

    ids, own, out = np.frombuffer(data, "<u4"), encoding(tokenizer), []
    marks = np.flatnonzero(ids >= TURN)
    if len(marks) % 3 or ids[marks].tolist() != [TURN, TEXT, END] * (len(marks) // 3):
        raise ValueError("turns aren't marked as they should be")
    for a, b, c in marks.reshape(-1, 3).tolist():
        role, text = own.decode(ids[a + 1 : b].tolist()), own.decode(ids[b + 1 : c].tolist())
        out.append((unescape(role), unescape(text), b + 1, c, len(role) + len(text) + sum(map(len, SHOWN.values()))))
    return out


def read_back(made: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation, from the rows of ``formatted`` alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids, loss_ids."""
    path = tokenizer or tokenizer_path()
    kind = made.schema["conv_id"].dataType.simpleString()

    def work(batches):
        now = None
        first = True
        for batch in batches:
            id_type = batch.schema.field(0).type
            done = []
            for row in batch.to_pylist():
                if first or row["part"] == 0:
                    if now:
                        done.append(now.row())
                    now, first = _Digest(row["conv_id"]), False
                now.add(row, path)
            if done:
                yield _digests(done, id_type)
        if now:
            yield _digests([now.row()], id_type)

    return made.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, loss_ids long")


class _Digest:
    def __init__(self, conv):
        self.conv, self.n, self.chars, self.shown, self.ids, self.on = conv, 0, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, row: dict, path: str) -> None:
        masks = set(zip(row["mask_from"], row["mask_to"], strict=True))
        left = len(masks)
        for role, text, a, b, shown in turns_of(row["ids"], path):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if (row["start"] + a, row["start"] + b) in masks:
                left -= 1
                self.loss.update(text.encode("utf-8", "surrogatepass"))
                self.chars += len(text)
                self.on += b - a
            self.n += 1
            self.shown += shown
        if left:
            raise ValueError("a mask doesn't cover a text")
        self.ids += len(row["ids"]) // 4

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.shown, self.ids, self.on


def _digests(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids", "loss_ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def op7_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\\### Assistant: </turn> ok"
    more = spark.sql(f"SELECT -7L AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(formatted(rows.unionByName(more))).drop("n_ids", "loss_ids")


_ESCAPED = "length(regexp_replace({}, '(" + "|".join(re.sub(r"([\\|])", r"\\\1", c) for c in ("\\", *CONTROLS)) + ")', '\\\\\\1', 'g'))"
_ORDER = "ORDER BY turn NULLS FIRST, role, sha256(text)"
_SAID = r"\### Assistant: </turn> ok"
OP7_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + {sum(map(len, SHOWN.values()))})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
