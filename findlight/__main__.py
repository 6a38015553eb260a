"""Command line: ``python -m findlight plan | search | validate | repair | compact | generations | restore-search``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("findlight")
    sub = p.add_subparsers(dest="command", required=True)
    plan = sub.add_parser("plan", help="how many partitions a table of so many rows gets")
    plan.add_argument("rows", type=int)
    plan.add_argument("--low-memory", action="store_true")
    search = sub.add_parser("search", help="search a file: a URL filter, or a JSON query")
    search.add_argument("path")
    search.add_argument("query")
    search.add_argument("--type", default="parquet")
    search.add_argument("--id", default="id")
    search.add_argument("--limit", type=int, default=20)
    for name, text in (("generations", "stored generations, the newest first"), ("validate", "what is wrong with the current generation"), ("repair", "store a generation without what is wrong"), ("compact", "remove old generations")):
        one = sub.add_parser(name, help=text)
        one.add_argument("root")
        one.add_argument("--id", default="id")
        one.add_argument("--keep", type=int, default=2)
    stored = sub.add_parser("restore-search", help="search a stored collection")
    stored.add_argument("root")
    stored.add_argument("name")
    stored.add_argument("query")
    stored.add_argument("--limit", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    from . import catalog
    from .operators.search import Collection, Request
    from .plans import parsers
    from .plans.schema import Schema
    from .sources.infer import infer, typed
    from .sources.readers import default_registry
    from .sources.store import Store

    a = arguments().parse_args(argv)
    if a.command == "plan":
        print(json.dumps(vars(catalog.deployment(a.rows, a.low_memory))))
        return 0
    spark = SparkSession.builder.appName("findlight").getOrCreate()

    def show(c: Collection) -> None:
        tree = parsers.wire(a.query) if a.query.lstrip().startswith("{") else parsers.url_filter(a.query, c.schema)
        got = c.search(Request(tree, limit=a.limit))
        for line in got.hits.toJSON().toLocalIterator():
            print(line)
        print(json.dumps({"total": got.total}))

    if a.command == "search":
        df = default_registry().open(spark, {"type": a.type, "path": a.path})
        schema = infer(df, a.id, untyped=a.type == "csv")
        show(Collection(typed(df, schema), schema))
    elif a.command == "restore-search":
        made = catalog.Catalog(spark, a.root)
        made.restore()
        show(made.get(a.name))
    else:
        store = Store(spark, a.root)
        if a.command == "generations":
            print(json.dumps({"current": store.current(), "generations": store.generations()}))
        elif a.command == "validate":
            found = store.validate(Schema((), a.id))
            print(json.dumps({"problems": found}))
            return int(bool(found))
        elif a.command == "repair":
            print(json.dumps({"generation": store.repair(Schema((), a.id)).generation}))
        else:
            print(json.dumps({"removed": store.compact(a.keep)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
