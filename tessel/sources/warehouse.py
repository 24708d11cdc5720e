"""Tables in a folder: Parquet files, and a numbered manifest for each version of a table that names the files it consists of.

A change writes its files first and then the manifest with the next number, which only one writer can do; another one that
comes second adds its rows to the version it finds, or computes its update or delete anew. So no change is lost, and
readers see a version from before or after a change. Updates and deletes rewrite only files that hold a row met. Files of
former versions stay for KEEP_SECONDS, so that DataFrames made before a change can still be read. All file
operations go through Hadoop's file systems; the folder may be in any store that Spark reads and that renames atomically.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.operators.dml import _hit, delete_rows, insert_rows, not_null, update_rows

#: How long files of former versions are kept.
KEEP_SECONDS = 3600.0
#: Files of a table from which on an insert puts them together.
MOST_FILES = 512
ATTEMPTS = 20
#: Local file systems look before they rename, so writers of this process also take turns.
_turns: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)


class TableExists(ValueError):
    pass


class TableMissing(ValueError):
    pass


class ConcurrentChange(RuntimeError):
    pass


class Warehouse:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files

    def _path(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self._conf)

    def _names(self, *parts: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        path, fs = self._path(*parts)
        try:
            return [s.getPath().getName() for s in fs.listStatus(path)]
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return []
            raise

    def _current(self, name: str) -> int:
        """Number of the newest manifest; 0 if there is none."""
        return max((int(f[9:-5]) for f in self._names(name.lower()) if f.startswith("manifest-") and f.endswith(".json")), default=0)

    def _manifest(self, name: str, number: int | None = None) -> dict:
        number = self._current(name) if number is None else number
        if not number:
            raise TableMissing(f"table {name} not found")
        path, fs = self._path(name.lower(), f"manifest-{number}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": number}
        finally:
            stream.close()

    def _commit(self, name: str, manifest: dict) -> bool:
        """Whether the manifest became the one after manifest["number"]; if not, another writer was first."""
        new, fs = self._path(name.lower(), f"{uuid.uuid4().hex}.tmp")
        old, _ = self._path(name.lower(), f"manifest-{manifest['number'] + 1}.json")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        with _turns[f"{self.root}/{name.lower()}"]:
            if self._current(name) == manifest["number"]:
                try:
                    context.rename(new, old, options)
                    return True
                except Exception as e:
                    if "AlreadyExists" not in str(e):
                        raise
        fs.delete(new, False)
        return False

    def _write(self, name: str, df: DataFrame) -> list[str]:
        """The files that hold the rows, as their places below the table's folder."""
        part = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name.lower()}/{part}")
        return [f"{part}/{f}" for f in sorted(self._names(name.lower(), part)) if f.endswith(".parquet")]

    def _read(self, name: str, schema: StructType, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name.lower()}/{f}" for f in files))

    # catalog

    def tables(self) -> list[str]:
        return sorted(self._manifest(d, n)["name"] for d in self._names() if (n := self._current(d)))

    def exists(self, name: str) -> bool:
        return self._current(name) > 0

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self._manifest(name)["schema"])

    def create(self, name: str, schema: StructType) -> None:
        if self.exists(name) or not self._commit(name, {"name": name, "schema": schema.jsonValue(), "files": [], "number": 0}):
            raise TableExists(f"table {name} already exists")

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if not self.exists(name):
            if if_exists:
                return False
            raise TableMissing(f"table {name} not found")
        path, fs = self._path(name.lower())
        return bool(fs.delete(path, True))

    def table(self, name: str) -> DataFrame:
        m = self._manifest(name)
        return self._read(name, StructType.fromJson(m["schema"]), m["files"])

    def register_views(self, names: set[str] | None = None) -> None:
        """Views of the tables of these names, in lower case, or of all."""
        for folder in self._names():
            if (names is None or folder in names) and (n := self._current(folder)):
                m = self._manifest(folder, n)
                self._read(folder, StructType.fromJson(m["schema"]), m["files"]).createOrReplaceTempView(m["name"])

    def vacuum(self, name: str, keep_seconds: float = KEEP_SECONDS) -> int:
        """Deletes files that the current version doesn't have and that are older; returns how many folders went."""
        kept = {f.partition("/")[0] for f in self._manifest(name)["files"]}
        path, fs = self._path(name.lower())
        old = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName() not in kept and s.getModificationTime() < 1000 * (time.time() - keep_seconds)]
        return sum(bool(fs.delete(p, True)) for p in old)

    # rows

    def insert(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds rows to the current version; returns how many.

        With batch, a stream's name and the number of its batch, nothing is added if the table has that batch or a later one of the stream.
        """
        schema, seen = self.schema(name), Observation()
        empty = self.spark.createDataFrame([], schema)
        checked = not_null(insert_rows(empty, rows), schema).observe(seen, F.count(F.lit(1)).alias("n"))
        new, n = self._write(name, checked), seen.get["n"]
        for _ in range(ATTEMPTS):
            m = self._manifest(name)
            done = m.get("streams", {})
            if batch and done.get(batch[0], -1) >= batch[1]:
                return 0
            if not n and not batch or self._commit(name, m | {"files": m["files"] + new * (n > 0), "streams": done | dict([batch] if batch else [])}):
                if len(m["files"]) + len(new) > MOST_FILES:
                    self.compact(name)
                return n
        raise ConcurrentChange(f"table {name} is changed too often")

    def compact(self, name: str) -> bool:
        """Puts the table's files together, about 128 MB of them to one, unless another writer is faster."""
        m = self._manifest(name)
        sizes = [fs.getFileStatus(p).getLen() for p, fs in (self._path(name.lower(), f) for f in m["files"])]
        df = self._read(name, StructType.fromJson(m["schema"]), m["files"])
        return self._commit(name, m | {"files": self._write(name, df.repartition(1 + sum(sizes) // (128 << 20)))})

    def _rewrite(self, name: str, where: Column | str | None, change: Callable[[DataFrame, StructType], DataFrame]) -> int:
        """The rows of all files that hold a row met are read, changed and written anew."""
        for _ in range(ATTEMPTS):
            m = self._manifest(name)
            schema = StructType.fromJson(m["schema"])
            hits = self._read(name, schema, m["files"]).withColumn("_file", F.input_file_name()).where(_hit(where)).groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect() if m["files"] else []
            if not hits:
                change(self._read(name, schema, []), schema)  # for its errors
                return 0
            met = {"/".join(r["_file"].split("/")[-2:]) for r in hits}
            new = self._write(name, change(self._read(name, schema, sorted(met)), schema))
            if self._commit(name, m | {"files": [f for f in m["files"] if f not in met] + new}):
                self.vacuum(name)
                return sum(r["n"] for r in hits)
        raise ConcurrentChange(f"table {name} is changed too often")

    def update(self, name: str, assign: Mapping[str, Column | str], where: Column | str | None = None) -> int:
        """Returns how many rows met the predicate."""
        return self._rewrite(name, where, lambda df, schema: not_null(update_rows(df, assign, where), schema))

    def delete(self, name: str, where: Column | str | None = None) -> int:
        """Returns how many rows met the predicate and are gone."""
        return self._rewrite(name, where, lambda df, schema: delete_rows(df, where))
