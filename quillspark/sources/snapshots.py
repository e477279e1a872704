"""Tables that change together: versions with a manifest, written first and switched at once.

Data goes to new folders and is never changed. A manifest names, for each table, the folder of each of its parts; it is
written under another name and renamed, so that a version is there as a whole or not at all. Readers take the newest
manifest and stay on it; a writer that fails at any step leaves the version before it. Folders that no kept version
names are dropped later.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import dropped, exists, located

#: Milliseconds after which a folder that no manifest names is taken to be a failed writer's.
ABANDONED = 86_400_000


class Conflict(RuntimeError):
    """Another writer has made a version since this one was read."""


class Store:
    """Versioned tables below a path. The object stays on the version that was newest when it was made or last moved."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.moved()

    def moved(self) -> Store:
        """Take the newest version."""
        found = self._versions()
        self.version = found[-1] if found else 0
        self.tables: dict[str, dict[str, str]] = self._manifest(self.version) if found else {}
        return self

    def _versions(self) -> list[int]:
        folder = f"{self.path}/manifests"
        if not exists(self.spark, folder):
            return []
        system, at = located(self.spark, folder)
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _manifest(self, version: int) -> dict[str, dict[str, str]]:
        line = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()
        return json.loads(line.value)

    def has(self, table: str) -> bool:
        return bool(self.tables.get(table))

    def read(self, table: str, schema: object | None = None, parts: list[str] | None = None) -> DataFrame:
        """A table of this version, or the given parts of it; without any, an empty one of schema."""
        held = self.tables.get(table, {})
        folders = sorted({f"{self.path}/{held[p]}" for p in (held if parts is None else parts) if p in held})
        if not folders:
            if schema is None:
                raise ValueError(f"there is no {table} in {self.path}")
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema is not None else self.spark.read).parquet(*folders)

    def written(self, rows: DataFrame, part: str | None = None) -> dict[str, str]:
        """Write rows to new folders; gives the folder of each value of column part, or of the one part ``all``.

        Nothing refers to them before they are committed.
        """
        name = f"data/{uuid.uuid4().hex}"
        if part is None:
            rows.write.parquet(f"{self.path}/{name}")
            return {"all": name}
        rows.write.partitionBy(part).parquet(f"{self.path}/{name}")
        system, at = located(self.spark, f"{self.path}/{name}")
        folders = [s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()]
        return {f.partition("=")[2]: f"{name}/{f}" for f in folders if "=" in f}

    def commit(self, changes: dict[str, dict[str, str | None]]) -> int:
        """A new version with changed parts of tables (None: the part goes), all at once; gives its number.

        Fails with Conflict, changing nothing, if a newer version than this object's has been made.
        """
        tables = {t: dict(p) for t, p in self.tables.items()}
        for table, parts in changes.items():
            held = tables.setdefault(table, {}) | parts
            tables[table] = {k: v for k, v in held.items() if v is not None}
        new = self.version + 1
        target, temporary = f"{self.path}/manifests/{new:012d}.json", f"{self.path}/manifests/_{uuid.uuid4().hex}"
        system, at = located(self.spark, temporary)
        out = system.create(at, False)
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        out.close()
        _, to = located(self.spark, target)
        if self._versions()[-1:] > [self.version] or system.exists(to) or not system.rename(at, to):
            system.delete(at, False)
            raise Conflict(f"version {new} of {self.path} is there already")
        self.version, self.tables = new, tables
        return new

    def vacuum(self, keep: int = 2, abandoned: int = ABANDONED) -> list[str]:
        """Drop all but the newest keep versions with the data that only they name, and what failed writers left long ago."""
        versions = self._versions()
        named = {v: {f for p in self._manifest(v).values() for f in p.values()} for v in versions}
        kept = set().union(*(named[v] for v in versions[-keep:]))
        old = set().union(*(named[v] for v in versions[:-keep])) - kept
        if exists(self.spark, f"{self.path}/data"):
            in_use = {f.split("/part=")[0] for f in kept}
            system, at = located(self.spark, f"{self.path}/data")
            now = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
            held = {f"data/{s.getPath().getName()}": s.getModificationTime() for s in system.listStatus(at)}
            old |= {f for f, t in held.items() if now - t >= abandoned and f not in in_use}
        for v in versions[:-keep]:
            dropped(self.spark, f"{self.path}/manifests/{v:012d}.json")
        for folder in sorted(old):
            dropped(self.spark, f"{self.path}/{folder}")
        return sorted(old)


def part_of(doc_id: str = "doc_id") -> Column:
    """The part of a document: one of 256, by a hash of its id."""
    return F.concat(F.lit("p"), F.substring(F.md5(doc_id), 1, 2))
