"""Query trees to boolean Columns that are never null."""

from __future__ import annotations

import ipaddress
import re
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.analyzers import TOKEN_CLASS, grams
from . import query as q
from .schema import Field, Schema

NONE, ALL = False, True
#: What tells a token's edges in a lowered text.
_EDGE_L, _EDGE_R = f"(?<![{TOKEN_CLASS}])", f"(?![{TOKEN_CLASS}])"
#: Between values of a multi-valued field: no character of any token.
GAP = " \n "


def compile_query(tree: q.Query | None, schema: Schema) -> Column:
    """``tree`` over the columns of ``schema``'s fields, never null. Parts of a conjunction stand in the order of their cost, as they are tried from the left."""
    return _Compiler(schema).of(tree or q.MatchAll())


def compile_filter(tree: q.Query | None, schema: Schema) -> Column:
    """As ``compile_query``, but may be null where it is false: as a filter it means the same, and comparisons of bare columns reach the scan."""
    return _Compiler(schema, strict=False).of(tree or q.MatchAll())


def cost(tree: q.Query) -> int:
    """Dearest leaf: equality 0, range 1, prefix 2, search in a string 3, edit distance 4, arrays 5."""
    parts = getattr(tree, "parts", None) or [p for n in ("must", "should", "filter", "must_not") for p in getattr(tree, n, ())] or ([tree.part] if hasattr(tree, "part") else [])
    if parts:
        return max(map(cost, parts))
    order = ((q.Term, q.Terms, q.Exists, q.Missing, q.MatchAll, q.Compound, q.TupleLookup), (q.Range, q.Cidr), (q.Prefix, q.Suffix, q.DomainWildcard), (q.Contains, q.Whole), (q.Fuzzy, q.GlobalTerm))
    return next((k for k, kinds in enumerate(order) if isinstance(tree, kinds)), 5)


def sure(c: Column) -> Column:
    """Null as false."""
    return F.coalesce(c, F.lit(False))


def moment(v: object) -> float | None:
    """Seconds since 1970 of a number, a numeric string or an ISO time; None for anything else."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, int | float):
        return float(v)
    if isinstance(v, datetime):
        return (v if v.tzinfo else v.replace(tzinfo=UTC)).timestamp()
    try:
        return float(str(v))
    except ValueError:
        pass
    try:
        t = datetime.fromisoformat(str(v).strip().replace("Z", "+00:00"))
        return (t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp()
    except ValueError:
        return None


class _Compiler:
    def __init__(self, schema: Schema, strict: bool = True):
        self.schema, self.strict = schema, strict

    def sure(self, c: Column) -> Column:
        return sure(c) if self.strict else c

    def definite(self) -> _Compiler:
        """What stands under a negation, or is counted, must not be null."""
        return self if self.strict else _Compiler(self.schema)

    def of(self, tree: q.Query) -> Column:
        made = getattr(self, f"_{type(tree).__name__.lower()}", None)
        if made is None:
            raise TypeError(f"{type(tree).__name__} can't be a predicate")
        out = made(tree)
        return F.lit(out) if isinstance(out, bool) else out

    # What a field holds.

    def _col(self, f: Field) -> Column:
        return F.col(f.source)

    def _value(self, f: Field, c: Column) -> Column:
        return normalize.value(c.cast("string"), f.normalizer, f.lowercase)

    def _any_value(self, f: Field, test) -> Column:
        """Whether a whole value passes."""
        if f.multi:
            return self.sure(F.exists(self._col(f), lambda v: test(self._value(f, v))))
        return self.sure(test(F.col(f.norm) if f.norm else self._value(f, self._col(f))))

    def _text(self, f: Field) -> Column:
        c = self._col(f)
        return F.array_join(c, GAP) if f.multi else c.cast("string")

    def _tokens(self, f: Field) -> Column:
        name = f.analyzer if f.lowercase or f.analyzer != "standard" else "cased"
        return self.schema.analyzers.tokens(self._text(f), name)

    def _searchable(self, f: Field) -> Column | None:
        """The text in which a token may be searched for, if tokens are runs of token characters."""
        if not self.schema.analyzers.simple(f.analyzer):
            return None
        return F.lower(self._text(f)) if f.lowercase and f.analyzer == "standard" else self._text(f) if f.analyzer == "standard" else None

    def _any_token(self, f: Field, literal: str, left: bool, right: bool) -> Column:
        """Whether a token equals ``literal``, or begins (``right`` open) or ends (``left`` open) with it."""
        s = self._searchable(f)
        if s is not None:
            if not re.fullmatch(r"[\w\-@.]+", literal):
                return F.lit(False)
            pattern = (_EDGE_L if left else "") + _quote(literal) + (_EDGE_R if right else "")
            return self.sure(F.contains(s, F.lit(literal)) & s.rlike(pattern))
        if left and right:
            return self.sure(F.array_contains(self._tokens(f), literal))
        return self.sure(F.exists(self._tokens(f), lambda t: t.startswith(literal) if left else t.endswith(literal)))

    def _literal(self, f: Field, v: object) -> str:
        return normalize.literal(v, f.normalizer, f.lowercase)

    # Leaves.

    def _matchall(self, t):
        return ALL

    def _explain(self, t):
        return self.of(t.part)

    def _term(self, t: q.Term):
        f = self.schema.get(t.field)
        if f is None or not f.strings:
            return NONE
        v = self._literal(f, t.value)
        if not v:
            return NONE
        if f.kind == "bool":
            return self.sure(self._col(f) == F.lit(v == "true")) if v in ("true", "false") else NONE
        tests = []
        if f.kind == "keyword" or f.lookup:
            tests.append(self._any_value(f, lambda c: c == v))
        if f.words:
            tests.append(self._any_token(f, v, True, True))
        return _any(tests)

    def _terms(self, t: q.Terms):
        f = self.schema.get(t.field)
        if f is None or not f.strings:
            return NONE
        literals = sorted({v for x in t.values if (v := self._literal(f, x))})
        if f.kind == "keyword" and not f.words and literals:
            return self._any_value(f, lambda c: c.isin(*literals))
        return _any([self._or_lit(self._term(q.Term(t.field, v))) for v in literals])

    def _or_lit(self, c):
        return F.lit(c) if isinstance(c, bool) else c

    def _prefix(self, t: q.Prefix):
        f = self.schema.get(t.field)
        if f is None or not f.prefix:
            return NONE
        v = self._literal(f, t.value)
        if not v or not f.prefix[0] <= len(v) <= f.prefix[1]:
            return NONE
        tests = [] if f.words and f.kind != "text" else [self._any_value(f, lambda c: c.startswith(v))] if f.kind == "keyword" else []
        return _any(tests + ([self._any_token(f, v, True, False)] if f.words else []))

    def _suffix(self, t: q.Suffix):
        f = self.schema.get(t.field)
        if f is None or not (f.suffix or f.normalizer == "domain"):
            return NONE
        v = self._literal(f, t.value) if f.normalizer != "domain" else normalize.literal(t.value, None, True)
        if not v:
            return NONE
        if f.words:
            return self._any_token(f, v, False, True)
        return self._any_value(f, lambda c: c.endswith(v))

    def _contains(self, t: q.Contains):
        f = self.schema.get(t.field)
        if f is None or not f.ngram:
            return NONE
        v, (least, most) = self._literal(f, t.value), f.ngram
        if len(v) < least:
            return NONE
        if t.exact:
            return self._any_value(f, lambda c: F.contains(c, F.lit(v)))
        parts = {v[i : i + n] for n in range(least, min(max(most, least), len(v)) + 1) for i in range(len(v) - n + 1)}
        # A gram that is part of a longer one that is asked for needs no test of its own.
        top = [g for g in sorted(parts) if not any(g != h and g in h for h in parts)]
        if f.words:
            token = re.compile(r"[\w\-@.]+")
            if not all(token.fullmatch(g) for g in top):
                return NONE
            s = self._searchable(f)
            if s is not None:
                return reduce(lambda a, b: a & b, [self.sure(F.contains(s, F.lit(g))) for g in top])
            return reduce(lambda a, b: a & b, [self.sure(F.exists(self._tokens(f), _holds(g))) for g in top])
        return reduce(lambda a, b: a & b, [self._any_value(f, _holds(g)) for g in top])

    def _fuzzy(self, t: q.Fuzzy):
        f = self.schema.get(t.field)
        if f is None or not f.fuzzy or not f.strings:
            return NONE
        v, d = self._literal(f, t.value), t.distance if t.distance > 0 else 1
        if not v:
            return NONE

        def near(c: Column) -> Column:
            close = (F.abs(F.length(c) - len(v)) <= d) & (F.levenshtein(c, F.lit(v), d) >= 0)
            return close if t.anywhere else c.startswith(v[0]) & close

        tests = [self._any_value(f, near)] if f.kind == "keyword" else []
        if f.words:
            tests.append(self.sure(F.exists(self._tokens(f), near)))
        return _any(tests)

    def begins(self, t: q.Fuzzy) -> Column:
        """Whether a row has a value or token that begins like ``t``'s value; true where that can't matter."""
        f = self.schema.get(t.field)
        if f is None or not f.fuzzy or not f.strings or not (v := self._literal(f, t.value)):
            return F.lit(True)
        tests = [self._any_value(f, lambda c: c.startswith(v[0]))] if f.kind == "keyword" else []
        if f.words:
            tests.append(self._any_token(f, v[0], True, False))
        return _any(tests)

    def _exists(self, t: q.Exists):
        f = self.schema.get(t.field)
        return NONE if f is None else self._col(f).isNotNull()

    def _missing(self, t: q.Missing):
        f = self.schema.get(t.field)
        return ALL if f is None else self._col(f).isNull()

    def _range(self, t: q.Range):
        f = self.schema.get(t.field)
        if f is None or not f.numbers:
            return NONE
        c = self._col(f)
        low, high = (moment(t.gt), True) if moment(t.gt) is not None else (moment(t.gte), False), (moment(t.lt), True) if moment(t.lt) is not None else (moment(t.lte), False)

        def lit(x: float) -> Column:
            if f.kind == "time":
                at = F.timestamp_micros(F.lit(round(x * 1e6)))
                return F.lit(datetime.fromtimestamp(x, UTC).replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz") if f.wall else at
            return F.lit(int(x)) if f.kind == "int" and x == int(x) and abs(x) < 2**53 else F.lit(x)

        tests = []
        if low[0] is not None:
            tests.append(c > lit(low[0]) if low[1] else c >= lit(low[0]))
        if high[0] is not None:
            tests.append(c < lit(high[0]) if high[1] else c <= lit(high[0]))
        return self.sure(reduce(lambda a, b: a & b, tests)) if tests else c.isNotNull()

    def _cidr(self, t: q.Cidr):
        f = self.schema.get(t.field)
        if f is None or f.normalizer != "ip":
            return NONE
        try:
            net = ipaddress.IPv4Network(t.value.strip(), strict=False)
        except ValueError:
            return NONE
        c = F.get(self._col(f), F.lit(0)) if f.multi else self._col(f)
        return self.sure(normalize.ipv4(c.cast("string")).between(int(net.network_address), int(net.broadcast_address)))

    def _domainwildcard(self, t: q.DomainWildcard):
        f = self.schema.get(t.field)
        if f is None or not f.strings:
            return NONE
        d = normalize.literal(t.pattern, "domain", True)
        if not d:
            return NONE
        test = lambda c: (normalize.domain(c) == d) | normalize.domain(c).endswith("." + d)
        return self.sure(F.exists(self._col(f), test)) if f.multi else self.sure(test(self._col(f).cast("string")))

    def _whole(self, t: q.Whole):
        f = self.schema.get(t.field)
        if f is None or not f.strings:
            return NONE
        v = self._literal(f, t.value)
        if not v:
            return NONE
        tests = {"contains": lambda c: F.contains(c, F.lit(v)), "starts_with": lambda c: c.startswith(v), "ends_with": lambda c: c.endswith(v), "fuzzy": lambda c: (F.abs(F.length(c) - len(v)) <= 1) & (F.levenshtein(c, F.lit(v), 1) >= 0)}
        return self._any_value(f, tests[t.operator])

    def _globalterm(self, t: q.GlobalTerm):
        fields = [f for f in self.schema.fields if f.strings]
        if not t.words or not fields:
            return NONE
        return reduce(lambda a, b: a & b, [_any([self._or_lit(self._word(f, w, t.fuzzy)) for f in fields]) for w in t.words])

    def _word(self, f: Field, word: str, fuzzy: bool):
        exact = self._or_lit(self._term(q.Term(f.name, word)))
        return exact | self._or_lit(self._fuzzy(q.Fuzzy(f.name, word, 1))) if fuzzy and f.fuzzy else exact

    def _compound(self, t: q.Compound):
        if not t.fields or len(t.fields) != len(t.values) or any(not normalize.stringify(v).strip() for v in t.values):
            return NONE
        tests = []
        for name, v in zip(t.fields, t.values, strict=True):
            f = self.schema.get(name)
            if f is None:
                return NONE
            if f.numbers:
                tests.append(self._range(q.Range(name, gte=v, lte=v)) if moment(v) is not None else F.lit(False))
            else:
                tests.append(self._any_value(f, _equals(self._literal(f, v))))
        return reduce(lambda a, b: a & b, tests)

    def _tuplelookup(self, t: q.TupleLookup):
        given = [(t.names[0], t.term), (t.names[1], t.group_id), (t.names[2], t.date_key)] + ([(t.names[3], t.source)] if t.source else [])
        if not t.term or not t.date_key or t.group_id <= 0:
            return NONE
        return self._compound(q.Compound(tuple(n for n, _ in given), tuple(v for _, v in given)))

    # Phrases.

    def _phrase(self, t: q.Phrase):
        f = self.schema.get(t.field)
        if f is None or not f.words:
            return NONE
        return self._sequence(f, self.schema.analyzers.of_literal(t.value, f.analyzer if f.lowercase or f.analyzer != "standard" else "cased"), t.slop)

    def _sequence(self, f: Field, terms: list[str], slop: int):
        if not terms:
            return NONE
        if len(terms) == 1:
            return self._any_token(f, terms[0], True, True)
        if f.multi:
            return self.sure(F.exists(self._col(f), lambda v: self._in_order(f, v, terms, slop)))
        return self._in_order(f, self._col(f).cast("string"), terms, slop)

    def _in_order(self, f: Field, text: Column, terms: list[str], slop: int) -> Column:
        """Whether the terms follow one another in one value, ``slop`` tokens or fewer between."""
        plain = self.schema.analyzers.simple(f.analyzer) and f.analyzer == "standard"
        if plain:
            s = F.lower(text) if f.lowercase else text
            have = reduce(lambda a, b: a & b, [F.contains(s, F.lit(x)) for x in terms])
            gap = f"[^{TOKEN_CLASS}]+"
            if slop <= 0:
                return self.sure(have & s.rlike(_EDGE_L + gap.join(map(_quote, terms)) + _EDGE_R))
            # From each start the next term is taken where it is nearest, for good: lazy repeats inside atomic groups.
            rest = "".join(rf"(?>(?:{gap}[{TOKEN_CLASS}]++){{0,{slop}}}?{gap}{_quote(x)}{_EDGE_R})" for x in terms[1:])
            return self.sure(have & s.rlike(f"{_EDGE_L}{_quote(terms[0])}{_EDGE_R}{rest}"))
        name = f.analyzer if f.lowercase or f.analyzer != "standard" else "cased"
        joined = F.array_join(self.schema.analyzers.tokens(text, name), " ")
        if slop <= 0:
            return self.sure(F.contains(F.concat(F.lit(" "), joined, F.lit(" ")), F.lit(f" {' '.join(terms)} ")))
        # From each start the next term is taken where it is nearest, for good: lazy repeats inside atomic groups.
        rest = " ".join(rf"(?>(?:[^ ]+ ){{0,{slop}}}?{_quote(x)}(?![^ ]))" for x in terms[1:])
        have = reduce(lambda a, b: a & b, [F.contains(joined, F.lit(x)) for x in terms])
        return self.sure(have & joined.rlike(rf"(?<![^ ]){_quote(terms[0])} {rest}"))

    def _proximity(self, t: q.Proximity):
        f = self.schema.get(t.field)
        if f is None or not t.terms:
            return NONE
        if t.ordered:
            return self._sequence(f, [x for v in t.terms for x in self.schema.analyzers.of_literal(v, f.analyzer)], t.slop)
        every = reduce(lambda a, b: a & b, [self._or_lit(self._term(q.Term(t.field, v))) for v in t.terms])
        if not t.windowed:
            return every
        wanted = F.array(*[F.lit(self._literal(f, v)) for v in t.terms])
        span = len(t.terms) + t.slop
        near = lambda k: F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(k) - span + 1)), lambda i: F.size(F.array_intersect(F.slice(k, i, span), wanted)) == len(set(t.terms)))
        return every & self.sure(F.get(F.transform(F.array(self._tokens(f)), near), F.lit(0)))

    # Composites.

    def _and(self, t: q.And):
        return reduce(lambda a, b: a & b, [self.of(p) for p in sorted(t.parts, key=cost)], F.lit(True)) if t.parts else ALL

    def _or(self, t: q.Or):
        return _any([self.of(p) for p in t.parts])

    def _not(self, t: q.Not):
        return ~self.definite().of(t.part)

    def _bool(self, t: q.Bool):
        need = max(1, t.min_should_match) if t.should else 0
        if need > len(t.should):
            return NONE
        parts = [self.of(p) for p in sorted((*t.must, *t.filter), key=cost)]
        if need == 1:
            parts.append(_any([self.of(p) for p in t.should]))
        elif need:
            parts.append(sum((self.definite().of(p).cast("int") for p in t.should), F.lit(0)) >= need)
        parts += [~self.definite().of(p) for p in sorted(t.must_not, key=cost)]
        return reduce(lambda a, b: a & b, parts) if parts else ALL

    def _vector(self, t: q.Vector):
        raise TypeError("a vector query inside others is resolved by search(), which knows the rows")


def _holds(part: str):
    return lambda c: F.contains(c, F.lit(part))


def _equals(literal: str):
    return lambda c: c == literal


def _any(tests: list[Column]):
    return reduce(lambda a, b: a | b, tests) if tests else NONE


def _quote(literal: str) -> str:
    """For Java's regular expressions."""
    return re.sub(r"([^\w])", r"\\\1", literal, flags=re.ASCII) if literal.isascii() else "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def compound_key(*columns: Column) -> Column:
    """Trimmed and lowered values joined by U+001F; null if one is null or empty."""
    parts = [normalize.plain(c.cast("string")) for c in columns]
    return F.when(reduce(lambda a, b: a & b, [sure(p != "") for p in parts]), F.concat_ws("\x1f", *parts))


def encode_date(c: Column) -> Column:
    """Days since 1970 of a YYYY-MM-DD string, plus 2^31; null if it is none."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.datediff(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1970-01-01")).cast("long") + 2**31)


def gram_column(c: Column, least: int, most: int) -> Column:
    return grams(c, least, most)
