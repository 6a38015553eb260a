"""Fields from samples: what a column is, and what may be asked of it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, time

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.schema import Field, Schema

SAMPLE_ROWS, SAMPLES = 200, 25
# Parts of names that say what a column is.
CODE_HINTS = ("code", "status", "type", "category", "key", "flag", "level", "state", "sku", "abbr")
TEXT_HINTS = ("desc", "description", "note", "comment", "title", "name", "summary", "address", "bio", "content", "text", "message")
NOT_FIELDS = ("id", "seq")
#: Times of one column are all written alike: one of these forms (the layouts of ``readers.TIME_LAYOUTS``).
_TIMES = (
    r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)",
    r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?", r"\d{4}-\d\d-\d\d", r"\d\d:\d\d:\d\d(\.\d+)?",
)


def _hint(name: str, hints: Iterable[str]) -> bool:
    return any(h in name.lower() for h in hints)


def _are_times(values: list[str]) -> bool:
    """Whether all values are valid and of one form."""
    def valid(v: str) -> bool:
        try:
            time.fromisoformat(v) if v[2:3] == ":" else datetime.fromisoformat(v)
            return True
        except ValueError:
            return False

    return any(all(re.fullmatch(form, v) for v in values) for form in _TIMES) and all(map(valid, values))


def _is_number(v: str) -> bool:
    try:
        float(v)
        return not (v != v.strip() or "_" in v and not v.lower().startswith("0x"))
    except ValueError:
        return False


def of_strings(name: str, values: list[str]) -> Field:
    """Of string samples: a name that says text, or code, then short values without blanks, then long or mostly blank-parted ones, else a keyword. Lengths are in bytes."""
    spaced = sum(bool(re.search("[ \t]", v)) for v in values) > len(values) // 2
    mean = sum(len(v.encode()) for v in values) / len(values) if values else 0.0
    if _hint(name, TEXT_HINTS):
        return Field(name, "text", lookup=False, indexed=True, fuzzy=True)
    if _hint(name, CODE_HINTS) or (0 < mean <= 24 and not spaced):
        return Field(name, "keyword", prefix=(3, 5), facetable=True)
    if mean > 40 or spaced:
        return Field(name, "text", lookup=False, indexed=True, fuzzy=True)
    return Field(name, "keyword", facetable=True)


def of_values(name: str, values: list[str]) -> Field:
    """Of untyped samples: codes, then texts by name, then numbers, booleans and times if all are, then as strings."""
    values = [v for v in values if v is not None and v.strip()][:SAMPLES]
    if _hint(name, CODE_HINTS):
        return Field(name, "keyword", prefix=(3, 5), facetable=True)
    if _hint(name, TEXT_HINTS) or not values:
        return of_strings(name, values)
    if all(map(_is_number, values)):
        whole = all(re.fullmatch(r"[+-]?\d+", v) and -(2**63) <= int(v) < 2**63 for v in values)
        return Field(name, "int" if whole else "float", sortable=True)
    if all(v in ("1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False") for v in values):
        return Field(name, "keyword", facetable=True)
    if _are_times(values):
        return Field(name, "time", sortable=True)
    return of_strings(name, values)


def of_type(name: str, kind: T.DataType, values: list) -> Field:
    """By the column's type; strings by their samples."""
    if isinstance(kind, T.BooleanType):
        return Field(name, "keyword", facetable=True)
    if isinstance(kind, T.IntegralType):
        return Field(name, "int", sortable=True)
    if isinstance(kind, T.NumericType):
        return Field(name, "float", sortable=True)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return Field(name, "time", sortable=True, wall=isinstance(kind, T.TimestampNTZType))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        sized = next((len(v) for v in values if v), None)
        return Field(name, "vector", dim=sized)
    if isinstance(kind, T.ArrayType):
        return Field(name, "keyword", multi=True, facetable=True)
    return of_strings(name, [str(v) for v in values if v is not None and str(v).strip()])


def infer(df: DataFrame, id: str = "id", untyped: bool = False, explicit: Iterable[Field] = ()) -> Schema:
    """A schema from the types of ``df`` and up to SAMPLE_ROWS of its rows; ``untyped``: all values are text, as in CSV. Fields given explicitly win."""
    rows = df.limit(SAMPLE_ROWS).collect()
    given = {f.name: f for f in explicit}
    fields = []
    for c in df.schema:
        if c.name.lower() in (*NOT_FIELDS, id.lower()):
            continue
        values = [v for r in rows if (v := r[c.name]) is not None and str(v).strip()][:SAMPLES]
        made = of_values(c.name, [str(v) for v in values]) if untyped else of_type(c.name, c.dataType, values)
        fields.append(given.pop(c.name, made))
    return Schema((*fields, *given.values()), id)


def typed(df: DataFrame, schema: Schema) -> DataFrame:
    """``df``, read as text, with each column cast to its field's type."""
    from pyspark.sql import functions as F

    from .readers import parse_time

    out = {}
    for f in schema.fields:
        kind = dict(df.dtypes).get(f.source)
        if kind == "string" and f.kind in ("int", "float"):
            out[f.source] = F.col(f.source).try_cast("bigint" if f.kind == "int" else "double")
        elif kind == "string" and f.kind == "time":
            out[f.source] = parse_time(F.col(f.source))
    return df.withColumns(out) if out else df


def describe(schema: Schema) -> list[tuple[str, str]]:
    return [(f.name, f.kind) for f in schema.fields]
