"""A graph store of append-only Parquet tables behind numbered manifests.

Every commit writes its rows as new Parquet folders and then a manifest with the next number; the highest one holds. No manifest is ever
replaced, so readers see a commit as a whole or not at all, whenever a writer dies, and of two writers that began at one state the later is
refused. Paths go through Spark's file systems, so the store may live wherever Spark can write."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES

#: Manifests that stay for readers that are under way.
KEPT = 8


class GraphStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _numbers(self) -> list[int]:
        """Numbers of the manifests that stand; 0 is the one without a number that older stores have."""
        found = self._fs.globStatus(self._path(f"{self.root}/MANIFEST*.json")) or []
        return sorted(int(f.getPath().getName()[8:-5].lstrip(".") or 0) for f in found)

    def _at(self, number: int):
        return self._path(f"{self.root}/MANIFEST{f'.{number:012d}' if number else ''}.json")

    def latest(self) -> tuple[int, dict[str, list[str]]]:
        """The highest manifest with its number, -1 for a new store."""
        numbers = self._numbers()
        if not numbers:
            return -1, {}
        stream = self._fs.open(self._at(numbers[-1]))
        try:
            return numbers[-1], json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict[str, list[str]]:
        return self.latest()[1]

    def read(self, name: str) -> DataFrame:
        parts = self.manifest().get(name, [])
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{p}" for p in parts])

    def commit(self, **rows: DataFrame) -> None:
        """Append rows to tables, all at once; OSError if another writer committed meanwhile."""
        number, now = self.latest()
        for name, df in rows.items():
            if name not in TABLES:
                raise KeyError(name)
            part = f"{name}/{uuid.uuid4().hex}"
            names = [c.split()[0] for c in _fields(TABLES[name])]
            df.select(*names).write.parquet(f"{self.root}/{part}")
            now[name] = [*now.get(name, []), part]
        self._publish(number, now)

    def replace(self, **rows: DataFrame) -> None:
        """Point tables at new rows only (for deletions)."""
        number, now = self.latest()
        for name, df in rows.items():
            part = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{part}")
            now[name] = [part]
        self._publish(number, now)

    def _publish(self, number: int, manifest: dict[str, list[str]]) -> None:
        new, at = self._path(f"{self.root}/_new.{uuid.uuid4().hex}"), self._at(max(number, 0) + 1)
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(new, at):
            self._fs.delete(new, False)
            raise OSError("another writer has committed; nothing of this commit is seen")
        for old in self._numbers()[:-KEPT]:
            self._fs.delete(self._at(old), False)

    def dump(self, to: str) -> list[str]:
        """Every table that has rows as Parquet under a folder; the names."""
        names = sorted(self.manifest())
        for name in names:
            self.read(name).write.parquet(f"{to.rstrip('/')}/{name}")
        return names

    def restore(self, source: str, tables: list[str] | None = None) -> list[str]:
        """Rows as they are, keys and initial states kept, no guards; of the tables named, or of all that the folder has."""
        at = source.rstrip("/")
        fs = self._path(at).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(t for t in TABLES if fs.exists(self._path(f"{at}/{t}"))) if tables is None else tables
        self.commit(**{t: self.spark.read.schema(TABLES[t]).parquet(f"{at}/{t}") for t in names})
        return names


def _fields(ddl: str) -> list[str]:
    """The columns of a DDL string."""
    out, depth, own = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return [*out, own.strip()]
