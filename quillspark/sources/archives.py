"""Outputs of an outer document parser as they are delivered: archives with a content list each.

A Python data source: the driver lists the archives, a partition reads one of them, entry by entry.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillspark.functions import fields
from quillspark.session import exists, ready
from quillspark.sources import files

ENDING, LIST, OTHER = ".zip", "content_list.json", "_v2"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def content_entry(names: list[str]) -> str | None:
    """The first in order of the entries that hold a content list, those of its second format left out."""
    return min((n for n in names if n.endswith(LIST) and OTHER not in n.rsplit("/", 1)[-1]), default=None)


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[Archive]:
        system, root = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [Archive(p) for p in sorted(f.path for f in found if f.is_file and f.path.lower().endswith(ENDING))]

    def read(self, partition: Archive) -> Iterator[tuple]:
        """One row: path, name without ending, entry, content; or the error of an archive that cannot be read."""
        system, _ = opened(self.folder)
        name = partition.value.rsplit("/", 1)[-1][: -len(ENDING)]
        try:
            with system.open_input_file(partition.value) as raw, zipfile.ZipFile(raw) as held:
                entry = content_entry(held.namelist())
                if entry is None:
                    yield partition.value, name, None, None, f"no {LIST}"
                else:
                    yield partition.value, name, entry, held.read(entry), None
        except Exception as e:  # noqa: BLE001  whatever is wrong with an archive concerns its document alone
            yield partition.value, name, None, None, f"{type(e).__name__}: {e}"


class Archives(DataSource):
    """``spark.read.format("parser_archives").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "parser_archives"

    def schema(self) -> str:
        return "path string, name string, entry string, content binary, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, entry, content, error of the archives below folder, a partition each; none gives no rows."""
    ready(spark).dataSource.register(Archives)
    if not ArchiveReader(folder).partitions():
        return spark.createDataFrame([], Archives({}).schema())
    return spark.read.format("parser_archives").load(folder)


def archived_blocks(docs: DataFrame, folder: str, kept: str, again: bool = False) -> DataFrame:
    """Raw blocks of docs (doc_id, file_name) from the archives of their names, each parsed once and kept at the path kept.

    again parses documents that are there already. A document whose archive is missing or broken has one block of
    type ``error`` and is tried again by the next call; entries and JSON that fail concern their document alone.
    """
    spark = docs.sparkSession
    names = [c.split()[0] for c in fields.RAW_BLOCK.split(", ")]
    held = spark.read.schema(fields.RAW_BLOCK + ", run bigint").parquet(kept) if exists(spark, kept) else spark.createDataFrame([], fields.RAW_BLOCK + ", run bigint")
    last = held.agg(F.max("run").alias("run")).first().run
    due = files.unparsed(docs.select("doc_id", "file_name"), held, again)
    due = due.withColumn("name", F.regexp_replace("file_name", r"\.[^.]*$", ""))
    found = due.join(archives(spark, folder), "name", "left")
    blocks = files.parsed(found.where("content is not null"), lambda content: iter(json.loads(content)))
    missing = found.where("content is null").select("doc_id", F.lit("error").alias("type"), F.coalesce("error", F.lit("no archive")).alias("text"), F.lit(0).alias("pos"))
    good = blocks.where("type <> 'error'").withColumn("run", F.lit((last or 0) + 1).cast("bigint"))
    good.write.mode("append").parquet(kept)
    # The last run that parsed a document holds.
    stored = spark.read.schema(fields.RAW_BLOCK + ", run bigint").parquet(kept)
    newest = stored.groupBy("doc_id").agg(F.max("run").alias("run"))
    rows = stored.join(newest, ["doc_id", "run"], "left_semi").join(docs.select("doc_id"), "doc_id", "left_semi").select(*names)
    failed = blocks.where("type = 'error'").select(*names).unionByName(missing, allowMissingColumns=True)
    return rows.unionByName(failed.select(*names))
