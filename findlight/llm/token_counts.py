"""Token counts of fields and sections: each document is encoded once, whole, and its tokens' spans are joined to the sections' spans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_tokens import encoding, tokenizer_path
from .common import table

#: What stands between two fields of a document; its characters belong to the field before.
JOINT = "\n"


def attribute(starts, ends, bounds):
    """Tokens to sections by overlap: for each section of ``bounds`` (ascending, n + 1 of them) the number of tokens, and of those that cross its end.

    A token goes to the section that holds most of its bytes; of equals, to the first. Every token goes to one
    section, so counts add up to the document's. Sections may be empty; they get no token.
    """
    import numpy as np

    n = len(bounds) - 1
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    home, crossing = first.copy(), np.flatnonzero(first != last)
    for k in crossing.tolist():
        held = [min(ends[k], bounds[s + 1]) - max(starts[k], bounds[s]) for s in range(first[k], last[k] + 1)]
        home[k] = first[k] + int(np.argmax(held))
    return np.bincount(home, minlength=n), np.bincount(first[crossing], minlength=n)


def section_tokens(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang", "text"), split_field: str | None = "text", id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, section, field, line, char_start, char_end, n_tokens, n_crossing)``: a row for each section of each document row.

    A document is its fields, joined by line feeds, encoded in one piece. Sections are its fields, but each line
    of ``split_field`` is one by itself (its line feed belongs to it); they part the document without gaps, and
    their spans are given in characters of it; tokens are laid over them by bytes, of which a character may have
    several tokens. A null field is empty and has a section of no characters, or of its
    joint. Rows that repeat an id have sections of their own; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    slim = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])
    kind = slim.schema["doc_id"].dataType.simpleString()

    def work(batches):
        import numpy as np

        own = encoding(path)
        size_of = np.zeros(max(own.max_token_value + 1, 1), np.int64)
        for token in range(len(size_of)):
            try:
                size_of[token] = len(own.decode_single_token_bytes(token))
            except KeyError:
                pass
        names = ["doc_id", "section", "field", "line", "char_start", "char_end", "n_tokens", "n_crossing"]
        for batch in batches:
            out: list = [[] for _ in names]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sections = []
                for i, (f, value) in enumerate(zip(fields, row[1:], strict=True)):
                    value += JOINT if i < len(fields) - 1 else ""
                    if f == split_field and value:
                        lines = value.split("\n")
                        parts = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
                        sections += [(f, k, x) for k, x in enumerate(parts)]
                    else:
                        sections.append((f, None, value))
                texts = [x for _, _, x in sections]
                chars = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
                sizes = np.concatenate(([0], np.cumsum([len(x.encode("utf-8", "surrogatepass")) for x in texts])))
                ends = np.cumsum(size_of[own.encode_to_numpy("".join(texts), disallowed_special=()).astype(np.int64)])
                counts, crossing = attribute(np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends, sizes)
                n = len(sections)
                for column, values in zip(out, ([row[0]] * n, range(n), (s[0] for s in sections), (s[1] for s in sections), chars[:-1].tolist(), chars[1:].tolist(), counts.tolist(), crossing.tolist()), strict=True):
                    column.extend(values)
                if len(out[0]) >= 50_000:
                    yield _batch(out, names, batch.schema.field(0).type)
                    out = [[] for _ in names]
            if out[0]:
                yield _batch(out, names, batch.schema.field(0).type)

    return slim.mapInArrow(work, f"doc_id {kind}, section int, field string, line int, char_start long, char_end long, n_tokens long, n_crossing long")


def _batch(columns: list, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
