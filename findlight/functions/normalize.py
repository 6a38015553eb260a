"""Normalisation of values, as Columns, and of query literals, as Python strings, by the same rules."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normalisers by what a field's name contains, first match first.
BY_NAME = (("email", ("email",)), ("phone", ("phone", "mobile")), ("domain", ("domain", "host")), ("url", ("url", "uri")), ("ip", ("ip",)))
#: Unicode white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def detect(field_name: str) -> str | None:
    """The normaliser that a field's name asks for."""
    low = field_name.lower()
    return next((kind for kind, parts in BY_NAME if any(p in low for p in parts)), None)


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(c, F.lit(_WHITE))


def plain(c: Column, lower: bool = True) -> Column:
    return F.lower(trim(c)) if lower else trim(c)


def email(c: Column) -> Column:
    return F.lower(trim(c))


def phone(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9+]", "")


def domain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim(c)), r"^\*\.", ""), r"\.$", "")


def url(c: Column) -> Column:
    """Scheme and host lowered, the rest as it is; all lowered if there is no scheme."""
    t, pattern = trim(c), r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)((?s:.*))$"
    split = F.concat(F.lower(F.regexp_extract(t, pattern, 1)), F.lower(F.regexp_extract(t, pattern, 2)), F.regexp_extract(t, pattern, 3))
    return F.when(t.rlike(pattern), split).otherwise(F.lower(t))


def url_host(c: Column) -> Column:
    """The host of a URL, lowered, without user and port; null if there is none."""
    host = F.regexp_extract(F.lower(trim(c)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def value(c: Column, normalizer: str | None, lower: bool) -> Column:
    """A whole value by its field's rules."""
    if normalizer in ("email", "phone", "domain", "url"):
        return {"email": email, "phone": phone, "domain": domain, "url": url}[normalizer](c)
    return plain(c, lower)


def literal(v: object, normalizer: str | None, lower: bool) -> str:
    """A query literal by the rules of ``value``."""
    t = stringify(v).strip()
    if normalizer == "email":
        return t.lower()
    if normalizer == "phone":
        return re.sub(r"[^0-9+]", "", t)
    if normalizer == "domain":
        return re.sub(r"\.$", "", re.sub(r"^\*\.", "", t.lower()))
    if normalizer == "url":
        parts = urlsplit(t)
        if not parts.scheme or "://" not in t:
            return t.lower()
        head, rest = t.split("://", 1)
        host = re.match(r"[^/?#]*", rest)[0]
        return f"{head.lower()}://{host.lower()}{rest[len(host):]}"
    return t.lower() if lower else t


def stringify(v: object) -> str:
    """Numbers in their shortest decimal form, booleans as true and false, all else as it is."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v:.0f}" if v == int(v) and abs(v) < 1e16 else repr(v)
    return "" if v is None else str(v)


def ipv4(c: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    t, octet = trim(c), r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    parts = F.split(t, r"\.")
    number = sum((F.get(parts, F.lit(k)).cast("long") * (256 ** (3 - k)) for k in range(4)), F.lit(0))
    return F.when(t.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"), number)
