"""Query trees from text: the simple syntax, URL filters, lookup strings and JSON."""

from __future__ import annotations

import json
from functools import lru_cache
from urllib.parse import parse_qsl

from . import query as q
from .schema import Schema

RESERVED = ("limit", "offset", "fuzzy", "profile", "with_docs")
# Names of filter operators.
_EQ, _NE, _GONE = ("eq", "equal", "equals"), ("ne", "neq", "not_equal"), ("missing", "not_exists")
_PATTERN = ("contains", "starts_with", "ends_with", "fuzzy")


def simple(field: str, expression: str) -> q.Query:
    """``+x`` must, ``-x`` must not, ``x*`` prefix, ``*x`` suffix, ``x~2`` fuzzy, else a term.

    Bare words alone must all match; beside signs they are alternatives, of which one is needed. Nothing at all
    matches everything.
    """
    bare, must, must_not = [], [], []
    for word in expression.split():
        needed, rest = word.startswith("+"), word.removeprefix("+")
        refused, rest = rest.startswith("-"), rest.removeprefix("-")
        (must_not if refused else must if needed else bare).append(_leaf(field, rest))
    if not (bare or must or must_not):
        return q.MatchAll()
    if not (must or must_not):
        return bare[0] if len(bare) == 1 else q.And(tuple(bare))
    return q.Bool(must=tuple(must), should=tuple(bare), must_not=tuple(must_not))


def _leaf(field: str, word: str) -> q.Query:
    if word.endswith("*") and len(word) > 1:
        return q.Prefix(field, word[:-1])
    if word.startswith("*") and len(word) > 1:
        return q.Suffix(field, word[1:])
    body, tilde, distance = word.partition("~")
    if tilde:
        return q.Fuzzy(field, body, int(distance) if distance.lstrip("+-").isdigit() else 1)
    return q.Term(field, word)


def url_filter(raw: str, schema: Schema) -> q.Query:
    """``field=value`` and ``field__operator=value``, joined by ``&``, all of which must hold; ``term=`` looks in all string fields unless a field has that name."""
    pairs = parse_qsl(raw.lstrip("?"), keep_blank_values=True)
    fuzzy = any(k == "fuzzy" and v.lower() in ("1", "true", "yes", "on") for k, v in pairs)
    filters: list[q.Query] = []
    for key, value in pairs:
        if key in RESERVED:
            continue
        if key == "term" and schema.get("term") is None:
            words = tuple(schema.analyzers.of_literal(value))
            if words:
                filters.append(q.GlobalTerm(words, fuzzy))
            continue
        name, operator = key, "eq"
        if schema.get(key) is None and "__" in key:
            name, _, operator = key.rpartition("__")
        if schema.get(name) is None:
            raise ValueError(f"unknown field {name!r}")
        if not value.strip() and operator not in ("exists", "not_zero", *_GONE):
            continue
        filters.append(filter_of(schema, name, operator, value))
    return q.Bool(filter=tuple(filters)) if filters else q.MatchAll()


def filter_of(schema: Schema, name: str, operator: str, value: str) -> q.Query:
    """One filter; a value that doesn't fit the field's type raises."""
    f = schema.need(name)

    def number(text: str) -> object:
        if f.kind == "time":
            return text.strip()
        try:
            return float(text)
        except ValueError:
            raise ValueError(f"{name}: {text!r} is no number") from None

    def equals(text: str) -> q.Query:
        if f.numbers:
            return q.Range(name, gte=number(text), lte=number(text))
        if f.kind == "text":
            return simple(name, text)
        return q.Term(name, text)

    def pattern(kind: str) -> q.Query:
        """By what the field offers, which for a text is its tokens; else over its whole values."""
        offered = {"contains": (f.ngram, q.Contains), "starts_with": (f.prefix, q.Prefix), "ends_with": (f.suffix, q.Suffix), "fuzzy": (f.fuzzy, q.Fuzzy)}
        has, made = offered[kind]
        return made(name, value) if has else q.Whole(name, value, kind)

    if operator in _EQ:
        return equals(value)
    if operator in _NE:
        return q.Not(equals(value))
    if operator == "exists":
        return q.Exists(name)
    if operator in _GONE:
        return q.Missing(name)
    if operator in ("in", "not_in"):
        alternatives = tuple(equals(v.strip()) for v in value.split(",") if v.strip())
        return q.Or(alternatives) if operator == "in" else q.Not(q.Or(alternatives))
    if operator in _PATTERN or operator == "not_contains":
        if f.numbers or f.kind == "vector":
            raise ValueError(f"{operator} doesn't fit the {f.kind} field {name!r}")
        if operator == "not_contains":
            return q.Not(pattern("contains"))
        return pattern(operator)
    if not f.numbers:
        raise ValueError(f"{operator} doesn't fit the {f.kind} field {name!r}")
    if operator == "not_zero":
        return q.Or((q.Range(name, lt=0), q.Range(name, gt=0)))
    if operator in ("gt", "gte", "lt", "lte"):
        return q.Range(name, **{operator: number(value)})
    if operator == "between":
        low, comma, high = value.partition(",")
        if not comma:
            raise ValueError("between takes two values")
        return q.Range(name, gte=number(low), lte=number(high))
    raise ValueError(f"unknown operator {operator!r}")


@lru_cache(1024)
def lookup(raw: str) -> q.Query:
    """``term=..&group_id=..&date_key=..[&source=..]``: a tuple if it is whole, else what is there of it, as terms."""
    got = {k: v for k, v in parse_qsl(raw.lstrip("?")) if k in ("term", "group_id", "date_key", "source")}
    if {"term", "group_id", "date_key"} <= got.keys() and got["group_id"].isdigit() and int(got["group_id"]) > 0:
        return q.TupleLookup(got["term"], int(got["group_id"]), got["date_key"], got.get("source"))
    return q.Bool(filter=tuple(q.Term(k, v) for k, v in got.items()))


def wire(body: str | dict) -> q.Query:
    """A query from JSON, or from what JSON gave; an unknown type raises."""
    d = json.loads(body) if isinstance(body, str) else body
    kind, f = d.get("type", ""), d.get("field", "")
    many = lambda key: tuple(wire(x) for x in d.get(key) or ())
    value = d.get("value", "")
    made = {
        "term": lambda: q.Term(f, value),
        "terms": lambda: q.Terms(f, tuple(d.get("values") or ())),
        "prefix": lambda: q.Prefix(f, value),
        "suffix": lambda: q.Suffix(f, value),
        "contains": lambda: q.Contains(f, value),
        "fuzzy": lambda: q.Fuzzy(f, value, int(d.get("distance") or 1)),
        "exists": lambda: q.Exists(f),
        "missing": lambda: q.Missing(f),
        "range": lambda: q.Range(f, d.get("gte"), d.get("gt"), d.get("lte"), d.get("lt")),
        "phrase": lambda: q.Phrase(f, value, int(d.get("slop") or 0)),
        "proximity": lambda: q.Proximity(f, tuple(d.get("terms") or ()), int(d.get("slop") or 0), bool(d.get("ordered"))),
        "cidr": lambda: q.Cidr(f, value),
        "domain_wildcard": lambda: q.DomainWildcard(f, d.get("pattern") or value),
        "compound": lambda: q.Compound(tuple(d.get("fields") or ()), tuple(d.get("values") or ())),
        "vector": lambda: q.Vector(f, tuple(d.get("vector") or ()), int(d.get("k") or 10), d.get("metric"), wire(d["filter"]) if isinstance(d.get("filter"), dict) else None, bool(d.get("exact", True))),
        "and": lambda: q.And(many("must")),
        "or": lambda: q.Or(many("should")),
        "not": lambda: q.Not(wire(d["query"])),
        "bool": lambda: q.Bool(many("must"), many("should"), many("filter"), many("must_not"), int(d.get("min_should_match") or 0)),
        "simple": lambda: simple(f, value),
        "global_term": lambda: q.GlobalTerm(tuple(d.get("words") or ()), bool(d.get("fuzzy"))),
        "match_all": q.MatchAll,
    }
    made["in"] = made["terms"]
    if kind not in made:
        raise ValueError(f"unknown query type {kind!r}")
    return made[kind]()
