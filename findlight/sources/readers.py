"""Sources by name: tables and queries over JDBC, CSV, JSON lines, Parquet, in-memory rows, generated rows and HTTP."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layouts that a time may be written in, tried in turn after plain seconds; the last is a time of the first day of year 0.
_FRACTION = "[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"
TIME_LAYOUTS = (
    f"yyyy-MM-dd'T'HH:mm:ss{_FRACTION}XXX", f"yyyy-MM-dd HH:mm:ss{_FRACTION}XXX", f"yyyy-MM-dd HH:mm:ss{_FRACTION}",
    f"yyyy-MM-dd'T'HH:mm:ss{_FRACTION}", "yyyy-MM-dd", f"HH:mm:ss{_FRACTION}",
)
ROWS_KEYS = ("data", "results", "items", "records")

Factory = Callable[[SparkSession, Mapping[str, object]], DataFrame]


class Registry:
    """Factories by name, whatever its case. Parameters of a call win over the configuration's."""

    def __init__(self) -> None:
        self._made: dict[str, Factory] = {}

    def register(self, kind: str, factory: Factory) -> None:
        self._made[kind.lower()] = factory

    def kinds(self) -> list[str]:
        return sorted(self._made)

    def open(self, spark: SparkSession, config: Mapping[str, object], **params: object) -> DataFrame:
        merged = {**config, **{k: v for k, v in params.items() if v is not None}}
        kind = str(merged.get("type", "")).lower()
        if kind not in self._made:
            raise ValueError(f"unknown source type {kind!r}")
        return self._made[kind](spark, merged)


def interpolate(text: str, params: Mapping[str, object]) -> str:
    """``${name}`` by ``params``; a name that isn't there raises."""

    def one(m: re.Match) -> str:
        if m[1] not in params:
            raise ValueError(f"no value for {m[1]!r}")
        return str(params[m[1]])

    return re.sub(r"\$\{(\w+)\}", one, text)


def bind(df: DataFrame, columns: Mapping[str, str] | Iterable[str] | None) -> DataFrame:
    """The columns asked for (new name -> name in the source, whatever its case); empty strings become null."""
    if columns is None:
        wanted = {c: c for c in df.columns}
    else:
        wanted = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    by_low = {c.lower(): c for c in df.columns}
    out = []
    for name, source in wanted.items():
        if source.lower() not in by_low:
            raise ValueError(f"no column {source!r}")
        c, kind = by_low[source.lower()], dict(df.dtypes)[by_low[source.lower()]]
        out.append((F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) if kind == "string" else F.col(f"`{c}`")).alias(name))
    return df.select(*out)


def parse_time(c: Column, layout: str | None = None) -> Column:
    """A timestamp from text: by ``layout``, or as seconds since 1970, or by the first of TIME_LAYOUTS that fits; null if none does. A time of day is one of 0000-01-01."""
    if layout:
        return F.try_to_timestamp(c, F.lit(layout))
    c = F.trim(c)
    seconds = F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.timestamp_micros((F.expr("1000000D") * c.try_cast("double")).cast("long")))
    dated = lambda x: F.concat(F.lit("0000-01-01 "), c) if x.startswith("HH") else c
    return F.coalesce(seconds, *[F.try_to_timestamp(dated(x), F.lit(f"yyyy-MM-dd {x}" if x.startswith("HH") else x)) for x in TIME_LAYOUTS])


def csv(spark: SparkSession, path: str, columns=None, **options) -> DataFrame:
    """A file with a header row; all columns are strings."""
    return bind(spark.read.options(header=True, **options).csv(path), columns)


def jsonl(spark: SparkSession, path: str, columns=None, id: str | None = "id", **options) -> DataFrame:
    """One object a line; the id is made a string."""
    df = spark.read.options(**options).json(path)
    if id and id in df.columns:
        df = df.withColumn(id, F.col(id).cast("string"))
    return bind(df, columns)


def parquet(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else bind(df, columns)


def jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, predicates: list[str] | None = None, columns=None, **options) -> DataFrame:
    """A database's table or query; with ``key`` and ``bounds``, or with ``predicates``, read in parallel parts. Fetches row by row with a cursor of ``fetchsize``."""
    read = spark.read.format("jdbc").options(url=url, **{"fetchsize": 10_000, **options})
    if predicates:
        source = table or f"({query}) q"
        return bind(spark.read.jdbc(url, source, predicates=predicates, properties={k: str(v) for k, v in options.items()}), columns)
    if key and bounds:
        read = read.options(dbtable=table or f"({query}) q", partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    else:
        read = read.option("query", query) if query else read.option("dbtable", table)
    return bind(read.load(), columns)


def rows(spark: SparkSession, data: Iterable, schema) -> DataFrame:
    """Rows that the driver has."""
    return spark.createDataFrame(list(data), schema)


def generated(spark: SparkSession, n: int, columns: Mapping[str, str], partitions: int | None = None) -> DataFrame:
    """``n`` rows by SQL expressions over ``id``, made where they are used."""
    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).select(*[F.expr(e).alias(c) for c, e in columns.items()])


def records(spark: SparkSession, n: int, partition_rows: int = 1000) -> DataFrame:
    """Record triples for trials of composite lookups and partitioned loads."""
    return generated(spark, n, {"id": "CAST(id + 1 AS STRING)", "term": "concat('key-', id % 97)", "group_id": "CAST(id % 16 + 1 AS STRING)", "date_key": "date_format(date_add(DATE'2026-01-01', CAST(id % 28 AS INT)), 'yyyy-MM-dd')", "partition_id": f"CAST(id div {partition_rows} AS STRING)", "entity_id": "concat('e', id)"})


def sql_text(text: str, params: Mapping[str, object]) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: spark.sql(interpolate(text, params))


def default_registry() -> Registry:
    """With the types sql_table, sql_view, sql_query, sql_file, csv, jsonl, parquet and http."""
    made = Registry()
    cols = lambda c: c.get("columns")

    def table(spark: SparkSession, c: Mapping) -> DataFrame:
        if c.get("url"):
            return jdbc(spark, str(c["url"]), table=str(c["table"]), key=c.get("key"), bounds=c.get("bounds"), columns=cols(c), **(c.get("options") or {}))
        return bind(spark.table(str(c["table"])), cols(c))

    def query(spark: SparkSession, c: Mapping, text: str | None = None) -> DataFrame:
        text = interpolate(text or str(c["query"]), c)
        if c.get("url"):
            return jdbc(spark, str(c["url"]), query=text, columns=cols(c), **(c.get("options") or {}))
        return bind(spark.sql(text), cols(c))

    def file(spark: SparkSession, c: Mapping) -> DataFrame:
        lines = spark.read.text(str(c["path"]), wholetext=True).first()
        return query(spark, c, lines[0] if lines else "")

    made.register("sql_table", table)
    made.register("sql_view", table)
    made.register("sql_query", query)
    made.register("sql_file", file)
    made.register("csv", lambda s, c: csv(s, str(c["path"]), cols(c), **(c.get("options") or {})))
    made.register("jsonl", lambda s, c: jsonl(s, str(c["path"]), cols(c)))
    made.register("parquet", lambda s, c: parquet(s, str(c["path"]), cols(c)))
    made.register("http", _http)
    return made


def _http(spark: SparkSession, c: Mapping) -> DataFrame:
    from .http import HttpRows

    spark.dataSource.register(HttpRows)
    options = {k: str(v) for k, v in c.items() if k in ("url", "page_param", "limit", "limit_param", "token", "schema", "method", "max_pages")}
    options |= {f"header.{k}": str(v) for k, v in (c.get("headers") or {}).items()}
    return bind(spark.read.format("findlight_http").options(**options).load(), c.get("columns"))
