"""Search: filter, rank, sort, page, count, facets, and what is told about a table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.normalize import value as norm_value
from ..plans import query as q
from ..plans.compiler import _Compiler, compile_filter
from ..plans.schema import Schema, fresh
from . import mutations, ranking, vector


@dataclass(frozen=True)
class Sort:
    """By one field. Missing values come last ascending and first descending; ``missing="first"`` turns either round."""

    field: str
    desc: bool = False
    missing: str = ""

    def column(self, schema: Schema) -> Column:
        f = schema.need(self.field)
        c = F.get(F.col(f.source), F.lit(0)) if f.multi else F.col(f.source)
        first = self.missing == "first"
        if self.desc:
            return c.desc_nulls_last() if first else c.desc_nulls_first()
        return c.asc_nulls_first() if first else c.asc_nulls_last()


@dataclass(frozen=True)
class Request:
    query: q.Query | None = None
    limit: int = 20
    offset: int = 0
    sort: tuple[Sort, ...] = ()
    facets: tuple[str, ...] = ()
    with_docs: bool = True


@dataclass
class Result:
    """A page of hits; total and facets are computed when they are asked for."""

    hits: DataFrame
    _total: Callable[[], int]
    facets: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self._total()


class Collection:
    """A table with its schema; ``now`` is the time (seconds) by which rows expire."""

    def __init__(self, df: DataFrame, schema: Schema, now: float | None = None, deleted_col: str | None = None):
        self.df, self.schema = df, schema
        self.live = mutations.live(df, schema, now, deleted_col)
        #: What scores are called: ``score``, unless the table has a column of that name.
        self.score = fresh(self.live, "score")

    # Vector parts of a query are turned into rows first, and fuzzy ones look further where nothing begins like them.

    def _resolve(self, tree: q.Query | None) -> tuple[q.Query | None, DataFrame]:
        """The tree without its vector parts, and the live rows with a marker column for each of those."""
        rows, found = self.live, []

        def walk(t):
            if isinstance(t, q.Vector):
                found.append(t)
                return _Marked(f"_v{len(found) - 1}")
            if isinstance(t, q.Fuzzy) and t.distance > 1 and not t.anywhere and self.live.filter(_Compiler(self.schema).begins(t)).isEmpty():
                return replace(t, anywhere=True)
            if isinstance(t, q.And | q.Or):
                return type(t)(tuple(walk(p) for p in t.parts))
            if isinstance(t, q.Not | q.Explain):
                return type(t)(walk(t.part))
            if isinstance(t, q.Bool):
                return q.Bool(*(tuple(walk(p) for p in part) for part in (t.must, t.should, t.filter, t.must_not)), t.min_should_match)
            return t

        tree = walk(tree) if tree is not None else None
        for k, v in enumerate(found):
            ids = self.nearest(v).select(F.col(self.schema.id).alias(f"_i{k}"), F.lit(True).alias(f"_v{k}"))
            rows = rows.join(F.broadcast(ids), F.col(self.schema.id) == F.col(f"_i{k}"), "left").drop(f"_i{k}")  # k rows at most
        return tree, rows

    def matching(self, tree: q.Query | None) -> DataFrame:
        """All live rows that match."""
        tree, rows = self._resolve(tree)
        schema = self.schema.replacing(*_marked_fields(tree)) if tree is not None else self.schema
        return rows.filter(compile_filter(_unmark(tree), schema)).select(*self.live.columns)

    def nearest(self, v: q.Vector, limit: int | None = None, offset: int = 0) -> DataFrame:
        f = self.schema.need(v.field)
        k = v.k if v.k > 0 else (limit or 10)
        if f.dim and len(v.vector) != f.dim:
            return self.live.withColumn(self.score, F.lit(0.0)).limit(0)
        rows = self.matching(v.filter) if v.filter is not None else self.live
        metric = v.metric or f.metric
        return vector.top_k(rows, f.source, v.vector, min(k, limit + offset) if limit else k, metric, None, self.schema.order, offset, self.score)

    def search(self, request: Request) -> Result:
        """Hits with ``score``: similarity for a vector at the root, BM25 if words are sought globally and no order is asked for, else 1, by id."""
        s, order = self.schema, F.col(self.schema.order)
        tree = request.query.part if isinstance(request.query, q.Explain) else request.query
        if isinstance(tree, q.Vector):
            hits = self.nearest(tree, request.limit, request.offset)
            return Result(self._project(hits, request), lambda: self.nearest(tree).count())
        words = q.words_in(tree)
        if words and not request.sort and not request.facets:
            scored = ranking.bm25(self.live, s, words.words, compile_filter(tree, s), words.fuzzy, self.score)
            ranked = scored.orderBy(F.col(self.score).desc(), order)
        else:
            found = self.matching(tree)
            ranked = found.withColumn(self.score, F.lit(1.0)).orderBy(*[x.column(s) for x in request.sort], order)
        hits = (ranked.offset(request.offset) if request.offset else ranked).limit(request.limit)
        if isinstance(request.query, q.Explain):
            hits.explain("formatted")
        return Result(self._project(hits, request), lambda: self.count(tree), {n: self.facet(tree, n) for n in request.facets})

    def _project(self, hits: DataFrame, request: Request) -> DataFrame:
        return hits if request.with_docs else hits.select(self.schema.id, self.score)

    def count(self, tree: q.Query | None) -> int:
        return self.matching(tree).count()

    def facet(self, tree: q.Query | None, name: str) -> DataFrame:
        """``(value, count)`` over all matches: first values only, most frequent first, then by value."""
        f = self.schema.need(name)
        c = F.get(F.col(f.source), F.lit(0)) if f.multi else F.col(f.source)
        rows = self.matching(tree).select(c.alias("value")).filter("value IS NOT NULL")
        return rows.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "value")

    def rerank(self, request: Request, score: Column) -> DataFrame:
        """The page that ``search`` gives, scored anew by a Column (or pandas UDF) over its columns, highest first."""
        page = self.search(request).hits.withColumn("_place", F.monotonically_increasing_id())
        return page.withColumn(self.score, score).orderBy(F.col(self.score).desc(), "_place").drop("_place")

    def highlight(self, tree: q.Query | None, name: str, term: str, size: int = 80) -> DataFrame:
        f = self.schema.need(name)
        return self.matching(tree).select(self.schema.id, vectors.highlight(F.col(f.source), term, size).alias("highlight"))

    def analyze(self, name: str) -> DataFrame:
        """``(id, pos, token)`` of a field."""
        f = self.schema.need(name)
        return self.live.select(self.schema.id, F.posexplode_outer(_Compiler(self.schema)._tokens(f)).alias("pos", "token")).filter("token IS NOT NULL")

    def get(self, id: object) -> DataFrame:
        return self.live.filter(F.col(self.schema.id) == F.lit(id))

    def stats(self) -> DataFrame:
        """One row: docs, live, deleted, fields, and the distinct terms, tokens and vectors of all fields."""
        compiler, parts = _Compiler(self.schema), []
        for f in self.schema.fields:
            if f.kind in ("keyword", "text"):
                values = F.array(norm_value(F.col(f.source).cast("string"), f.normalizer, f.lowercase)) if not f.words else compiler._tokens(f)
                parts.append(self.live.select(F.lit(f.name).alias("f"), F.explode_outer(values).alias("t")))
        terms = None
        for p in parts:
            terms = p if terms is None else terms.union(p)
        n_terms = terms.filter("t IS NOT NULL AND t <> ''").distinct().agg(F.count("*").alias("terms")) if terms is not None else self.live.limit(0).agg(F.count("*").alias("terms"))
        n_vectors = sum((F.count(F.col(f.source)) for f in self.schema.fields if f.kind == "vector"), F.lit(0).cast("long"))
        counts = self.live.agg(F.count("*").alias("live"), n_vectors.alias("vectors"))
        docs = self.df.agg(F.count("*").alias("docs"))
        return docs.crossJoin(counts).crossJoin(n_terms).select("docs", "live", (F.col("docs") - F.col("live")).alias("deleted"), F.lit(len(self.schema.fields)).alias("fields"), "terms", "vectors")  # one row each

    def profile(self, tree: q.Query | None) -> dict:
        """The kind of the root, matches, and seconds."""
        began = time.perf_counter()
        n = self.count(tree)
        return {"query": type(tree).__name__ if tree is not None else "MatchAll", "matches": n, "seconds": time.perf_counter() - began}

    def complete(self, name: str, prefix: str, limit: int = 0) -> DataFrame:
        """``(term)``: the distinct tokens of a field that begin so, in order; all of them for a limit of 0."""
        found = self.analyze(name).filter(F.col("token").startswith(prefix)).select(F.col("token").alias("term")).distinct().orderBy("term")
        return found.limit(limit) if limit else found


@dataclass(frozen=True)
class _Marked(q.Query):
    name: str


def _marked_fields(tree) -> list:
    from ..plans.schema import Field

    names = []

    def walk(t):
        if isinstance(t, _Marked):
            names.append(t.name)
        for p in [*getattr(t, "parts", ()), *(x for n in ("must", "should", "filter", "must_not") for x in getattr(t, n, ())), *([t.part] if hasattr(t, "part") else [])]:
            walk(p)

    walk(tree)
    return [Field(n, "bool") for n in names]


def _unmark(t):
    if isinstance(t, _Marked):
        return q.Term(t.name, True)
    if isinstance(t, q.And | q.Or):
        return type(t)(tuple(_unmark(p) for p in t.parts))
    if isinstance(t, q.Not | q.Explain):
        return type(t)(_unmark(t.part))
    if isinstance(t, q.Bool):
        return q.Bool(*(tuple(_unmark(p) for p in part) for part in (t.must, t.should, t.filter, t.must_not)), t.min_should_match)
    return t


def rank_within(df: DataFrame, by: str, score: str, k: int) -> DataFrame:
    """The ``k`` best rows of each group."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def union_shards(*results: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Hits of several collections in one global order."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.orderBy(*order).limit(limit)
