"""Analyzers: text Columns to arrays of tokens, and the same for query literals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a token, stop words, suffixes and digits.
TOKEN_CLASS = r"\p{L}\p{Nd}_\-@."
STOP_WORDS = ("a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were")
SUFFIXES = ("ingly", "edly", "ing", "ed", "ies", "s")
CJK_BLANKS = (" ", "\t", "\n", "\r")
NEPALI = ("०१२३४५६७८९।", "0123456789 ")


def standard(c: Column) -> Column:
    """Lowered runs of letters, decimal digits, and ``_ - @ .``."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{TOKEN_CLASS}]+"), F.lit(0))


def cased(c: Column) -> Column:
    """As ``standard``, with the case kept."""
    return F.regexp_extract_all(c, F.lit(f"[{TOKEN_CLASS}]+"), F.lit(0))


def stop(c: Column) -> Column:
    return F.filter(standard(c), lambda t: ~t.isin(*STOP_WORDS))


def stem_token(t: Column) -> Column:
    """Without the first suffix that fits and leaves more than two characters (of ``ies``, a ``y`` stays)."""
    out = None
    for s in SUFFIXES:
        cut = F.substring(t, F.lit(1), F.length(t) - len(s))
        cut = F.concat(cut, F.lit("y")) if s == "ies" else cut
        fits = t.endswith(s) & (F.octet_length(t) > len(s) + 2)
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(t)


def stem(c: Column) -> Column:
    return F.transform(standard(c), stem_token)


def nepali(c: Column) -> Column:
    return standard(F.translate(c, *NEPALI))


def cjk_places(c: Column) -> Column:
    """Each character but blanks, tabs and line ends, lowered, together with the very next one if that is none of these either: one string a place."""
    here = f"[^{''.join(CJK_BLANKS)}]"
    return F.regexp_extract_all(F.lower(c), F.lit(f"(?=({here}{here}?)){here}"), F.lit(1))


def cjk_tokens(place: Column) -> Column:
    """The tokens of one of ``cjk_places``: its character, and the pair if it is one."""
    return F.when(F.length(place) == 1, F.array(place)).otherwise(F.array(F.substring(place, 1, 1), place))


def cjk(c: Column) -> Column:
    """Each character but blanks, tabs and line ends, lowered, and after it the pair with the very next character if that is none of these either."""
    return F.flatten(F.transform(cjk_places(c), cjk_tokens))


def grams(c: Column, least: int, most: int) -> Column:
    """All substrings of ``least`` to ``most`` characters, by length, then place."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(c) - (n - 1))
        return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))

    sizes = [of_size(n) for n in range(least, most + 1)]
    return F.flatten(F.array(*sizes))


def prefixes(c: Column, least: int, most: int) -> Column:
    """Beginnings of ``least`` to ``most`` characters."""
    top = F.least(F.length(c), F.lit(most))
    return F.when(top < least, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(least), top), lambda n: F.substring(c, F.lit(1), n)))


def suffixes(c: Column) -> Column:
    """All endings, the longest first."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.length(c))))


def literal_tokens(text: str, name: str = "standard") -> list[str]:
    """The tokens of a query literal under a built-in analyzer."""
    t = text if name == "cased" else text.lower()
    if name == "cjk":
        return [x for i, c in enumerate(t) if c not in CJK_BLANKS for x in ([c, c + t[i + 1]] if i + 1 < len(t) and t[i + 1] not in CJK_BLANKS else [c])]
    if name == "nepali":
        t = t.translate(str.maketrans(*NEPALI))
    ok = lambda ch: ch in "_-@." or unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nd"
    tokens = re.sub(r"\s+", " ", "".join(c if ok(c) else " " for c in t)).split()
    if name == "stop":
        return [x for x in tokens if x not in STOP_WORDS]
    if name == "stem":
        return [_stem(x) for x in tokens]
    return tokens


def _stem(t: str) -> str:
    for s in SUFFIXES:
        if t.endswith(s) and len(t.encode()) > len(s) + 2:
            return t[: -len(s)] + ("y" if s == "ies" else "")
    return t


@dataclass
class Analyzers:
    """Analyzers by name, and synonyms that are appended to a text's tokens, in the tables and in the queries of one collection."""

    columns: dict[str, Callable[[Column], Column]] = field(default_factory=lambda: {"standard": standard, "cased": cased, "stop": stop, "stem": stem, "nepali": nepali, "cjk": cjk})
    literals: dict[str, Callable[[str], list[str]]] = field(default_factory=dict)
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def register(self, name: str, column: Callable[[Column], Column], literal: Callable[[str], list[str]]) -> None:
        """A user's analyzer, as a function of Columns (built-in functions or a pandas UDF) and of literals."""
        self.columns[name], self.literals[name] = column, literal

    def synonym(self, term: str, *expansions: str) -> None:
        self.synonyms[term.lower()] = tuple(x.lower() for x in expansions)

    def tokens(self, c: Column, name: str = "standard") -> Column:
        base = self.columns.get(name, standard)(c)
        if not self.synonyms:
            return base
        known = F.create_map(*[x for t, e in self.synonyms.items() for x in (F.lit(t), F.array(*map(F.lit, e)))])
        none = F.array().cast("array<string>")
        return F.get(F.transform(F.array(base), lambda b: F.concat(b, F.flatten(F.transform(b, lambda t: F.coalesce(F.try_element_at(known, t), none))))), F.lit(0))

    def of_literal(self, text: str, name: str = "standard") -> list[str]:
        got = self.literals[name](text) if name in self.literals else literal_tokens(text, name)
        return got + [e for t in got for e in self.synonyms.get(t, ())]

    def simple(self, name: str) -> bool:
        """Whether tokens of ``name`` are maximal runs of token characters, so that one may be searched for without parting the text."""
        return name in ("standard", "cased", "nepali") and name not in self.literals and not self.synonyms


def phrase_terms(tokens: Iterable[str]) -> list[str]:
    return [t for t in tokens if t]
