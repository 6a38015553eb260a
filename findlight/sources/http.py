"""A JSON service as a data source: pages of objects, in an array or under a usual key."""

from __future__ import annotations

import json
import urllib.request
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import ROWS_KEYS


def rows_in(body: object) -> list[dict]:
    """The objects of a response."""
    if isinstance(body, dict):
        body = next((body[k] for k in ROWS_KEYS if isinstance(body.get(k), list)), [])
    return [x for x in body if isinstance(x, dict)] if isinstance(body, list) else []


def fetch(options: dict[str, str], page: int | None) -> list[dict]:
    url = options["url"]
    query = {}
    if page is not None:
        query[options["page_param"]] = page
    if options.get("limit"):
        query[options.get("limit_param", "limit")] = options["limit"]
    if query:
        url += ("&" if "?" in url else "?") + urlencode(query)
    request = urllib.request.Request(url, method=options.get("method", "GET"))  # noqa: S310
    if options.get("token"):
        request.add_header("Authorization", f"Bearer {options['token']}")
    for k, v in options.items():
        if k.startswith("header."):
            request.add_header(k[7:], v)
    with urllib.request.urlopen(request, timeout=float(options.get("timeout", 30))) as response:  # noqa: S310
        return rows_in(json.load(response))


class HttpRows(DataSource):
    """Options: url, schema (DDL; strings are taken of other columns' values as JSON gives them), page_param (without it one fetch), limit, token, header.NAME, max_pages."""

    @classmethod
    def name(cls) -> str:
        return "findlight_http"

    def schema(self) -> str:
        if self.options.get("schema"):
            return self.options["schema"]
        first = fetch(dict(self.options), 1 if self.options.get("page_param") else None)
        names = sorted({k for row in first for k in row})
        kinds = {n: {type(r[n]) for r in first if r.get(n) is not None} for n in names}
        return ", ".join(f"`{n}` {'double' if kinds[n] and kinds[n] <= {int, float} else 'boolean' if kinds[n] == {bool} else 'string'}" for n in names) or "id string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(dict(self.options), schema)


class HttpReader(DataSourceReader):
    """Pages from 1 until one is empty, in one task, as no service says how many there are."""

    def __init__(self, options: dict[str, str], schema):
        self._options, self._schema = options, schema

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        page = 1 if self._options.get("page_param") else None
        kinds = [(f.name, f.dataType.typeName()) for f in self._schema.fields]
        most = int(self._options.get("max_pages", 1_000_000))
        while True:
            got = fetch(self._options, page)
            for row in got:
                yield tuple(_as(row.get(n), kind) for n, kind in kinds)
            if page is None or not got or page >= most:
                return
            page += 1


def _as(v: object, kind: str):
    if v is None:
        return None
    if kind in ("double", "float"):
        return float(v)
    if kind in ("long", "integer"):
        return int(v)
    if kind == "boolean":
        return bool(v)
    if kind == "array":
        return [float(x) for x in v]
    return v if isinstance(v, str) else json.dumps(v)
