"""The schema of a searchable table: fields, what they are and what may be asked of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import normalize
from ..functions.analyzers import Analyzers

KINDS = ("keyword", "text", "bool", "int", "float", "time", "vector")


@dataclass(frozen=True)
class Field:
    """One field, read from the column of its name (or ``column``).

    ``prefix`` and ``ngram`` are (least, most) characters, or None where the operator is not offered; operators
    that a field doesn't offer match nothing.
    """

    name: str
    kind: str = "keyword"
    lookup: bool = True
    indexed: bool = False
    prefix: tuple[int, int] | None = None
    suffix: bool = False
    ngram: tuple[int, int] | None = None
    fuzzy: bool = False
    phrase: bool = False
    lowercase: bool = True
    unique: bool = False
    facetable: bool = False
    sortable: bool = False
    stored: bool = True
    ttl: bool = False
    analyzer: str = "standard"
    dim: int | None = None
    metric: str = "cosine"
    boost: float = 1.0
    normalizer: str | None = ""
    column: str | None = None
    multi: bool = False
    wall: bool = False
    norm: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r} of field {self.name!r}")
        if self.normalizer == "":
            object.__setattr__(self, "normalizer", normalize.detect(self.name) if self.kind in ("keyword", "text") else None)

    @property
    def source(self) -> str:
        return self.column or self.name

    @property
    def words(self) -> bool:
        """Whether its values are parted into tokens."""
        return self.kind == "text" or self.indexed

    @property
    def strings(self) -> bool:
        return self.kind in ("keyword", "text", "bool")

    @property
    def numbers(self) -> bool:
        return self.kind in ("int", "float", "time")


@dataclass(frozen=True)
class Schema:
    """Fields by name, the id column, and the analyzers of the collection."""

    fields: tuple[Field, ...]
    id: str = "id"
    seq: str | None = None
    analyzers: Analyzers = field(default_factory=Analyzers, compare=False)

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("a field is named twice")

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def need(self, name: str) -> Field:
        f = self.get(name)
        if f is None:
            raise KeyError(f"unknown field {name!r}")
        return f

    @property
    def order(self) -> str:
        """The column that ties are broken by."""
        return self.seq or self.id

    def replacing(self, *fields: Field) -> Schema:
        """With these fields in place of those of the same names, or added."""
        by = {f.name: f for f in self.fields} | {f.name: f for f in fields}
        return replace(self, fields=tuple(by.values()))


def of_frame(df: DataFrame, id: str, text: tuple[str, ...] = (), seq: str | None = None) -> Schema:
    """A schema by the types of ``df``: strings are keywords with every operator (``text``: text), numbers and times are sortable."""
    made = []
    for c in df.schema:
        if c.name == id:
            continue
        t, multi = c.dataType, False
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            t, multi = t.elementType, True
        every = {"prefix": (1, 64), "suffix": True, "ngram": (2, 4), "fuzzy": True, "facetable": True, "multi": multi}
        if isinstance(t, T.StringType):
            made.append(Field(c.name, "text", lookup=False, phrase=True, **every) if c.name in text else Field(c.name, "keyword", **every))
        elif isinstance(t, T.BooleanType):
            made.append(Field(c.name, "bool", facetable=True))
        elif isinstance(t, T.IntegralType):
            made.append(Field(c.name, "int", sortable=True, facetable=True))
        elif isinstance(t, T.NumericType):
            made.append(Field(c.name, "float", sortable=True))
        elif isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
            made.append(Field(c.name, "time", sortable=True, wall=isinstance(t, T.TimestampNTZType)))
        elif isinstance(t, T.ArrayType):
            made.append(Field(c.name, "vector"))
    return Schema(tuple(made), id, seq)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or where ``df`` has it already (whatever its case) the name with underscores in front."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
