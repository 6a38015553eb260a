"""Stored generations of a table: immutable Parquet folders, a manifest beside each, and a pointer to the current one."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mutations import apply_changes, violations
from ..plans.schema import Schema


def scratch(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share, spark.checkpoint.dir; where that is unset and all run on one machine, in one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        at = tempfile.mkdtemp(prefix="findlight-")
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


class Files:
    """Small files and folders in whatever file system a path is in, through Spark's own."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """At once: written beside and renamed into place, so that readers find the old text or the new one."""
        temporary, target = self._path(f".{name.replace('/', '_')}.{uuid.uuid4().hex}"), self._path(name)
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        over = self._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        over[0] = getattr(fs, "Options$Rename").OVERWRITE
        context = fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(target), over)

    def claim(self, name: str) -> bool:
        """Makes an empty file; False if it is there already. Of several callers one gets it."""
        self._fs.mkdirs(self._path(name).getParent())
        return self._fs.createNewFile(self._path(name))

    def list(self, name: str = "") -> list[str]:
        if not self._fs.exists(self._path(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def lengths(self, name: str) -> dict[str, int]:
        """The length of each data file below a folder, by its path there."""
        top, found = self._fs.makeQualified(self._path(name)).toString(), self._fs.listFiles(self._path(name), True)
        out = {}
        while found.hasNext():
            status = found.next()
            path = status.getPath().toString()
            if path.rsplit("/", 1)[-1].startswith("part-"):
                out[path.removeprefix(top).lstrip("/")] = status.getLen()
        return out


@dataclass
class Manifest:
    generation: int
    rows: int
    hash: str
    files: dict
    created: float
    schema: str


class Store:
    """Generations below ``root``: ``gen=N`` folders, each with a manifest, and CURRENT."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def generations(self) -> list[int]:
        """The newest first."""
        return sorted((int(x[4:]) for x in self.files.list() if x.startswith("gen=")), reverse=True)

    def current(self) -> int | None:
        text = self.files.read("CURRENT")
        return int(text) if text else None

    def save(self, df: DataFrame, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), max_rows_per_file: int = 0) -> Manifest:
        """A new generation, current once it is whole. Sorted within files, so that ranges skip row groups."""
        n = max(self.generations(), default=0) + 1
        while not self.files.claim(f"claims/{n}"):
            n += 1
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        writer = df.write
        if max_rows_per_file:
            writer = writer.option("maxRecordsPerFile", max_rows_per_file)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/gen={n}")
        rows, digest = self._measure(self.read(n))
        made = Manifest(n, rows, digest, self.files.lengths(f"gen={n}"), time.time(), df.schema.json())
        self.files.write(f"manifest-{n}.json", json.dumps(asdict(made)))
        self.files.write("CURRENT", str(n))
        return made

    def _measure(self, df: DataFrame) -> tuple[int, str]:
        rows, digest = df.agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(df.columns)))).first()
        return rows, str(digest or 0)

    def read(self, generation: int | None = None) -> DataFrame:
        n = generation if generation is not None else self.current()
        if n is None:
            raise FileNotFoundError(f"no generation below {self.root}")
        return self.spark.read.parquet(f"{self.root}/gen={n}")

    def replayed(self, log: ChangeLog, id_col: str, seq_col: str, op_col: str = "op", deletes: tuple[str, ...] = ("delete",), strict: bool = False) -> DataFrame:
        """The current generation after the changes of ``log``, as a store is opened whose last changes weren't saved; damaged records are passed over, or raise if ``strict``."""
        table = self.read()
        schema = T.StructType([*table.schema.fields, T.StructField(op_col, T.StringType())])
        return apply_changes(table, log.read(schema, strict), id_col, seq_col, op_col, deletes)

    def manifest(self, generation: int | None = None) -> Manifest | None:
        text = self.files.read(f"manifest-{generation if generation is not None else self.current()}.json")
        return Manifest(**json.loads(text)) if text else None

    def validate(self, schema: Schema | None = None, generation: int | None = None) -> list[str]:
        """What is wrong with a generation: nothing, if the list is empty."""
        n = generation if generation is not None else self.current()
        found, made = [], self.manifest(n)
        if made is None:
            return ["no manifest"]
        there = self.files.lengths(f"gen={n}")
        if there != made.files:
            wrong = sorted(k for k in {*there, *made.files} if there.get(k) != made.files.get(k))
            return [f"files differ from those that were written: {', '.join(wrong[:5])}"]
        rows, digest = self._measure(self.read(n))
        if rows != made.rows:
            found.append(f"{rows} rows instead of {made.rows}")
        if digest != made.hash:
            found.append("rows differ from those that were written")
        if schema is not None:
            df = self.read(n)
            if df.filter(F.col(schema.id).isNull()).limit(1).count():
                found.append("a row has no id")
            if df.groupBy(schema.id).count().filter("count > 1").limit(1).count():
                found.append("an id is repeated")
            if violations(df, schema).limit(1).count():
                found.append("a unique value is repeated")
        return found

    def repair(self, schema: Schema, seq_col: str | None = None) -> Manifest:
        """A new generation without rows that have no id, and with the last row of each id."""
        df = self.read().filter(F.col(schema.id).isNotNull())
        if seq_col:
            from ..operators.mutations import latest

            return self.save(latest(df, schema.id, seq_col))
        return self.save(df.dropDuplicates([schema.id]))

    def compact(self, keep: int = 2, max_age: float | None = None, now: float | None = None) -> list[int]:
        """Removes all but the newest ``keep`` generations, and those over ``max_age`` seconds; never the current one. Returns what went."""
        gone = []
        for place, n in enumerate(self.generations()):
            made = self.manifest(n)
            old = max_age is not None and made is not None and (now or time.time()) - made.created > max_age
            if n != self.current() and (place >= keep or old):
                self.files.delete(f"gen={n}")
                self.files.delete(f"manifest-{n}.json")
                gone.append(n)
        return gone


class ChangeLog:
    """Changes as JSON lines with a checksum each, to be applied over a generation."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, changes: DataFrame) -> None:
        body = F.to_json(F.struct(*changes.columns))
        changes.select(body.alias("body"), F.crc32(body.cast("binary")).alias("crc")).write.mode("append").json(self.path)

    def read(self, schema, strict: bool = False) -> DataFrame:
        """The changes whose checksums hold; ``strict`` raises if one doesn't, or isn't there."""
        lines = self.spark.read.schema("body string, crc long").json(self.path)
        good = F.coalesce(F.crc32(F.col("body").cast("binary")) == F.col("crc"), F.lit(False))
        if strict and lines.filter(~good).limit(1).count():
            raise ValueError("a record of the change log is damaged")
        return lines.filter(good).select(F.from_json("body", schema).alias("r")).select("r.*")

    def truncate(self) -> None:
        Files(self.spark, self.path).delete("")


class Checkpoint:
    """Progress by name, as JSON files."""

    def __init__(self, spark: SparkSession, root: str):
        self._files = Files(spark, root)

    def load(self, name: str) -> dict:
        return json.loads(self._files.read(f"{name}.json") or "{}")

    def save(self, name: str, **state: object) -> None:
        self._files.write(f"{name}.json", json.dumps(state, default=str))

    def reset(self, name: str) -> None:
        self._files.delete(f"{name}.json")
