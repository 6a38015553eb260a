"""Many collections by name, their reloads and swaps, and plans for how to cut large ones."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.search import Collection, Request, Result
from .plans import query as q
from .plans.schema import Field, Schema
from .sources.infer import infer, typed
from .sources.readers import Registry, default_registry
from .sources.store import Files, Store


@dataclass
class Entry:
    collection: Collection
    generation: int
    store: Store | None = None


class Catalog:
    """Collections by id. A reload builds the new one whole before it takes the old one's place; a failure leaves the old one."""

    def __init__(self, spark: SparkSession, root: str | None = None, registry: Registry | None = None):
        self.spark, self.root, self.registry = spark, root, registry or default_registry()
        self._entries: dict[str, Entry] = {}
        self._lock = threading.Lock()

    def list(self) -> list[str]:
        return sorted(self._entries)

    def get(self, name: str) -> Collection:
        if name not in self._entries:
            raise KeyError(f"no collection {name!r}")
        return self._entries[name].collection

    def generation(self, name: str) -> int:
        return self._entries[name].generation

    def add(self, name: str, df: DataFrame, schema: Schema, now: float | None = None) -> Collection:
        if name in self._entries:
            raise ValueError(f"{name!r} is there already")
        return self.reload(name, lambda: df, schema, now)

    def reload(self, name: str, build: Callable[[], DataFrame], schema: Schema, now: float | None = None, keep: int = 2) -> Collection:
        df, store = build(), None
        if self.root:
            store = Store(self.spark, f"{self.root}/{name}")
            store.save(df)
            store.files.write("schema.json", json.dumps([vars(f) for f in schema.fields] + [{"id": schema.id, "seq": schema.seq}]))
            store.compact(keep)
            df = store.read()
        made = Collection(df, schema, now)
        with self._lock:
            before = self._entries.get(name)
            self._entries[name] = Entry(made, before.generation + 1 if before else 1, store)
        return made

    def reload_source(self, name: str, config: Mapping[str, object], id: str = "id", explicit: tuple[Field, ...] = (), **params: object) -> Collection:
        """From a source of the registry; the schema is inferred, but for the fields given."""
        df = self.registry.open(self.spark, config, **params)
        schema = infer(df, id, untyped=str(config.get("type")).lower() == "csv", explicit=explicit)
        return self.reload(name, lambda: typed(df, schema), schema)

    def remove(self, name: str) -> None:
        with self._lock:
            self._entries.pop(name, None)

    def restore(self, now: float | None = None) -> list[str]:
        """Opens every collection that is stored below the root."""
        found = []
        probe = Store(self.spark, self.root or "")
        for name in probe.files.list():
            store = Store(self.spark, f"{self.root}/{name}")
            text = store.files.read("schema.json")
            if text and store.current() is not None:
                *fields, keys = json.loads(text)
                made = [Field(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}) for f in fields]
                schema = Schema(tuple(made), keys["id"], keys["seq"])
                with self._lock:
                    self._entries[name] = Entry(Collection(store.read(), schema, now), store.current(), store)
                found.append(name)
        return found

    def search(self, name: str, request: Request) -> Result:
        return self.get(name).search(request)

    def search_all(self, names: list[str], request: Request) -> DataFrame:
        """Hits of several collections with ``collection``, by score, then id, in one order."""
        out = None
        for n in names:
            c = self.get(n)
            hits = c.search(request).hits.select(F.col(c.schema.id).cast("string").alias("id"), F.col(c.score).alias("score"), F.lit(n).alias("collection"))
            out = hits if out is None else out.unionByName(hits)
        return out.orderBy(F.col("score").desc(), "id", "collection").limit(request.limit)

    @staticmethod
    def from_config(spark: SparkSession, config: Mapping | str, root: str | None = None, registry: Registry | None = None) -> Catalog:
        """From ``{"datasources": {name: {...}}, "indexes": {name: {"datasource", "id", "fields": [{...}]}}}`` or its JSON text."""
        config = json.loads(config) if isinstance(config, str) else config
        made = Catalog(spark, root, registry)
        for name, index in config.get("indexes", {}).items():
            source = config.get("datasources", {}).get(index["datasource"])
            if source is None:
                raise ValueError(f"{name!r}: no datasource {index['datasource']!r}")
            fields = tuple(Field(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}) for f in index.get("fields", ()))
            made.reload_source(name, source, index.get("id", "id"), fields)
        return made


@dataclass
class Task:
    id: str
    name: str
    status: str = "running"
    error: str = ""
    started: float = field(default_factory=time.time)
    ended: float | None = None


class Tasks:
    """Reloads in the background, each under a tag of its own by which its jobs can be stopped."""

    def __init__(self, catalog: Catalog):
        self._catalog, self._tasks, self._threads = catalog, {}, {}

    def start(self, name: str, build: Callable[[], DataFrame], schema: Schema) -> Task:
        task = Task(uuid.uuid4().hex, name)
        self._tasks[task.id] = task

        def work() -> None:
            self._catalog.spark.addTag(task.id)
            try:
                self._catalog.reload(name, build, schema)
                task.status = "cancelled" if task.status == "cancelled" else "done"
            except Exception as e:  # noqa: BLE001
                if task.status != "cancelled":
                    task.status, task.error = "failed", str(e)
            finally:
                task.ended = time.time()

        thread = threading.Thread(target=work, daemon=True)
        self._threads[task.id] = thread
        thread.start()
        return task

    def cancel(self, id: str) -> None:
        task = self._tasks[id]
        if task.status == "running":
            task.status = "cancelled"
            self._catalog.spark.interruptTag(id)

    def list(self) -> list[Task]:
        return sorted(self._tasks.values(), key=lambda t: t.started)

    def wait(self, id: str, timeout: float | None = None) -> Task:
        self._threads[id].join(timeout)
        return self._tasks[id]


# How to cut large tables.


def recommended_partitions(rows: int, target: int = 5_000_000) -> int:
    return max(1, -(-rows // target)) if rows > 0 else 1


@dataclass(frozen=True)
class Plan:
    rows: int
    partitions: int
    rows_per_partition: int
    batch: int
    low_memory: bool


def deployment(rows: int, low_memory: bool = False, target: int | None = None) -> Plan:
    """Partitions for so many rows: five million each, or a quarter of one where memory is short."""
    per = target or (250_000 if low_memory else 5_000_000)
    return Plan(rows, recommended_partitions(rows, per), per, 16_384 if low_memory else 131_072, low_memory)


@dataclass(frozen=True)
class Scheme:
    """Names partitions ``<base>-wiNN-YYYYMM-facNN`` by group, month and a third key.

    Without ``groups`` (0) each group is a part of its own; without ``months``, or ``thirds`` (0), names and folders do without these.
    """

    base: str = "records"
    groups: int = 16
    thirds: int = 16
    months: bool = True

    def name(self, group: int, date_key: str, third: int = 0) -> str:
        parts = [self.base or "lookup"]
        if self.groups:
            parts.append(f"wi{group % self.groups:02d}")
        elif group > 0:
            parts.append(f"wi{group}")
        if self.months and len(date_key) >= 7:
            parts.append(date_key[:4] + date_key[5:7])
        if self.thirds:
            parts.append(f"fac{third % self.thirds:02d}")
        return "-".join(parts)

    def columns(self, group: Column, date_key: Column, third: Column) -> dict[str, Column]:
        """Columns to partition a table by, so that filters on them skip folders."""
        made = {"wi": F.pmod(group.cast("int"), F.lit(self.groups)) if self.groups else group.cast("int")}
        if self.months:
            made["month"] = F.concat(F.substring(date_key, 1, 4), F.substring(date_key, 6, 2))
        if self.thirds:
            made["fac"] = F.pmod(third.cast("int"), F.lit(self.thirds))
        return made

    def prune(self, df: DataFrame, group: int | None = None, date_key: str | None = None) -> DataFrame:
        """The part of a table so partitioned in which matches may lie."""
        if group is not None:
            df = df.filter(F.col("wi") == (group % self.groups if self.groups else group))
        return df if date_key is None or not self.months else df.filter(F.col("month") == date_key[:4] + date_key[5:7])


@dataclass
class Dataset:
    """A partitioned table's manifest: its scheme, and the rows of each partition, by the values of the partition columns."""

    scheme: Scheme
    partitions: list[dict]

    @staticmethod
    def of(scheme: Scheme, df: DataFrame) -> Dataset:
        """Counted by one aggregation; a row for each partition comes to the driver."""
        keys = [k for k in ("wi", "month", "fac") if k in df.columns]
        rows = df.groupBy(*keys).agg(F.count("*").alias("rows")).orderBy(*keys).collect()
        return Dataset(scheme, [r.asDict() for r in rows])

    def save(self, spark: SparkSession, root: str, name: str = "dataset.json") -> None:
        Files(spark, root).write(name, json.dumps({"scheme": vars(self.scheme), "partitions": self.partitions}))

    @staticmethod
    def load(spark: SparkSession, root: str, name: str = "dataset.json") -> Dataset:
        text = Files(spark, root).read(name)
        if text is None:
            raise FileNotFoundError(f"no {name} below {root}")
        got = json.loads(text)
        return Dataset(Scheme(**got["scheme"]), got["partitions"])


def route(known: set[str], scheme: Scheme, group: int, date_key: str, third: int = 0) -> str:
    """The partition of a lookup, or the base where there is none."""
    name = scheme.name(group, date_key, third)
    return name if name in known else scheme.base


def explain(collection: Collection, tree: q.Query) -> str:
    return collection.matching(tree)._jdf.queryExecution().toString()
