"""The query tree."""

from __future__ import annotations

from dataclasses import dataclass


class Query:
    """A predicate over rows; every row either matches or doesn't."""


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class Term(Query):
    field: str
    value: object


@dataclass(frozen=True)
class Terms(Query):
    field: str
    values: tuple


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    value: str


@dataclass(frozen=True)
class Suffix(Query):
    field: str
    value: str


@dataclass(frozen=True)
class Contains(Query):
    """All n-grams of the value occur; ``exact`` asks for the value itself."""

    field: str
    value: str
    exact: bool = False


@dataclass(frozen=True)
class Fuzzy(Query):
    """A token within ``distance`` edits that begins like the value; ``anywhere``: that begins otherwise, as beyond one edit where no token of the table begins so."""

    field: str
    value: str
    distance: int = 1
    anywhere: bool = False


@dataclass(frozen=True)
class Exists(Query):
    field: str


@dataclass(frozen=True)
class Missing(Query):
    field: str


@dataclass(frozen=True)
class Range(Query):
    """An exclusive bound wins over an inclusive one; a bound that is no number or time is passed over."""

    field: str
    gte: object = None
    gt: object = None
    lte: object = None
    lt: object = None


@dataclass(frozen=True)
class And(Query):
    parts: tuple[Query, ...] = ()


@dataclass(frozen=True)
class Or(Query):
    parts: tuple[Query, ...] = ()


@dataclass(frozen=True)
class Not(Query):
    part: Query


@dataclass(frozen=True)
class Bool(Query):
    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    filter: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    min_should_match: int = 0


@dataclass(frozen=True)
class Phrase(Query):
    field: str
    value: str
    slop: int = 0


@dataclass(frozen=True)
class Proximity(Query):
    """Ordered: a phrase of the terms. Unordered: all terms, anywhere, or with ``windowed`` within ``slop`` tokens beyond their number."""

    field: str
    terms: tuple[str, ...]
    slop: int = 0
    ordered: bool = False
    windowed: bool = False


@dataclass(frozen=True)
class Cidr(Query):
    field: str
    value: str


@dataclass(frozen=True)
class DomainWildcard(Query):
    """The domain and those below it, by labels."""

    field: str
    pattern: str


@dataclass(frozen=True)
class Whole(Query):
    """A whole normalised value: contains, starts_with, ends_with or fuzzy (distance 1)."""

    field: str
    value: str
    operator: str


@dataclass(frozen=True)
class GlobalTerm(Query):
    """Every word is in at least one string field; ``fuzzy`` allows distance 1 on fields that offer it."""

    words: tuple[str, ...]
    fuzzy: bool = False


@dataclass(frozen=True)
class Compound(Query):
    """Values of several fields at once."""

    fields: tuple[str, ...]
    values: tuple


@dataclass(frozen=True)
class TupleLookup(Query):
    """(term, group > 0, YYYY-MM-DD) and, if given, source, over fields of the names given."""

    term: str
    group_id: int
    date_key: str
    source: str | None = None
    names: tuple[str, str, str, str] = ("term", "group_id", "date_key", "source")


@dataclass(frozen=True)
class Vector(Query):
    field: str
    vector: tuple[float, ...]
    k: int = 10
    metric: str | None = None
    filter: Query | None = None
    exact: bool = True


@dataclass(frozen=True)
class Explain(Query):
    """Transparent; ``search`` prints the plan of what it holds."""

    part: Query


def words_in(q: Query | None) -> GlobalTerm | None:
    """The global term that asks for ranking: the root, or within conjunctions, filters and alternatives."""
    if isinstance(q, GlobalTerm):
        return q
    parts: tuple[Query, ...] = ()
    if isinstance(q, And):
        parts = q.parts
    elif isinstance(q, Bool):
        parts = (*q.must, *q.filter, *q.should)
    elif isinstance(q, Explain):
        parts = (q.part,)
    return next((g for p in parts if (g := words_in(p))), None)
