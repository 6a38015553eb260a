"""Vector similarity, quantisation and score shaping as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of metrics.
METRICS = {"cosine": "cosine", "cos": "cosine", "dot": "dot", "inner_product": "dot", "ip": "dot", "l2": "l2", "euclidean": "l2"}


def vector_literal(v: Sequence[float]) -> Column:
    """A constant array of doubles, parsed from one string so that long vectors make short plans."""
    return F.split(F.lit(",".join(repr(float(x)) for x in v)), ",").cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_score(a: Column, b: Column) -> Column:
    """Minus the squared distance."""
    return -F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """By the metric's name; an unknown one is cosine."""
    return {"cosine": cosine, "dot": dot, "l2": l2_score}[METRICS.get(metric.lower(), "cosine")](a, b)


def valid(v: Column, dim: int | None = None) -> Column:
    """Whether a vector is there, has numbers only, and ``dim`` of them if that is given."""
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(ok & (F.size(v) == dim) if dim else ok, F.lit(False))


def quantize(v: Column) -> Column:
    """Each number clipped to [-1, 1], times 127, cut towards zero."""
    return F.transform(v, lambda x: (F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 127).cast("tinyint"))


def dequantize(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def decay(value: Column, origin: float, scale: float) -> Column:
    """exp(-|value - origin| / scale); 1 for a scale of 0 or less."""
    return F.exp(-F.abs(value.cast("double") - F.lit(float(origin))) / F.lit(float(scale))) if scale > 0 else F.lit(1.0)


def highlight(text: Column, term: str, size: int = 80) -> Column:
    """The first place of ``term``, whatever its case, marked, with half of ``size`` characters on each side; empty if it isn't there."""
    at, half, n = F.instr(F.lower(text), term.lower()), max(size, 0) // 2 if size > 0 else 40, len(term)
    start = F.greatest(at - half, F.lit(1))
    made = F.concat(F.substring(text, start, at - start), F.lit("<mark>"), F.substring(text, at, F.lit(n)), F.lit("</mark>"), F.substring(text, at + n, F.lit(half)))
    return F.when((at > 0) & F.lit(n > 0), made).otherwise("")
