"""Import of a folder of files, whole or as a file stream that takes what has come since.

Models are functions of columns: ``summarise(text, title, content_type)`` gives a summary, ``recognise(text,
title, content_type)`` a model's JSON about the document's entity, ``embed(text)`` a vector. Without them a
document has no summary and stands for itself. A file that cannot be parsed fails alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import fields, rules, text as tx
from quillspark.operators import entities as ent, layout, registry, retrieval
from quillspark.session import staged
from quillspark.sources import files, sinks
from quillspark.sources.snapshots import Store


@dataclass(frozen=True)
class Models:
    parse: Callable[[DataFrame], DataFrame] = files.markdown
    embed: Callable[[Column], Column] = retrieval.dense_vector
    summarise: Callable[[Column, Column, Column], Column] | None = None
    recognise: Callable[[Column, Column, Column], Column] | None = None


def documents(scanned: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Registry rows of scanned files with their action."""
    decided = registry.decisions(scanned.drop("content"), known, force)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return decided.withColumns({"content_type": tx.content_type(F.col("folder"), F.col("file_name")), "document_title": tx.title(stem), "status": F.lit("running")})


def recognised(work: DataFrame, raw: DataFrame, chunks: DataFrame, models: Models) -> DataFrame:
    """doc_id, entity of documents: what the recogniser says and the text bears out; else the document itself."""
    read = work.select("doc_id", "document_title", "content_type").join(layout.entity_input(raw, chunks), "doc_id", "left")
    said = models.recognise(F.col("text"), F.col("document_title"), F.col("content_type")) if models.recognise else F.lit(None).cast("string")
    told = read.withColumn("e", F.from_json(said, fields.RECOGNISED))
    return told.select("doc_id", ent.grounded(F.col("e.type"), F.col("e.name"), F.col("e.codes"), F.col("e.aliases"), F.col("text"), F.col("document_title")).alias("entity"))


def summaries(work: DataFrame, chunks: DataFrame, models: Models) -> DataFrame:
    """doc_id, summary of the documents that have text; blank without a model."""
    read = layout.assembled(chunks, rules.SUMMARY_MOST).join(work.select("doc_id", "document_title", "content_type"), "doc_id")
    said = models.summarise(F.col("text"), F.col("document_title"), F.col("content_type")) if models.summarise else F.lit("")
    return read.select("doc_id", tx.strip(F.coalesce(said, F.lit(""))).alias("summary"))


def indexed(docs: DataFrame, scanned: DataFrame, models: Models = Models()) -> tuple[DataFrame, DataFrame]:
    """Index rows of documents to be imported, one per distinct content, and (doc_id, entity, error) of each."""
    work = docs.where("action <> 'skip'").dropDuplicates(["doc_id"])
    raw, _ = staged(models.parse(work.join(scanned.select("path", "content"), "path").select("doc_id", "content")), "raw-blocks")
    errors = raw.where("type = 'error'").groupBy("doc_id").agg(F.min("text").alias("error"))
    good = work.join(errors, "doc_id", "left_anti")
    raw = raw.join(errors, "doc_id", "left_anti")
    blocks, _ = staged(layout.layout(raw), "blocks")
    body, _ = staged(layout.chunk(blocks), "chunks")
    chunks = layout.all_chunks(good, body, layout.table_facts(blocks), summaries(good, body, models))
    titled = chunks.join(good.select("doc_id", "content_type", "document_title"), "doc_id")
    text = tx.embed_text(F.col("document_title"), F.col("content_type"), F.col("section_path"), F.col("embed_body"))
    vectors = titled.select("doc_id", "seq", models.embed(text).alias("dense"), retrieval.sparse_vector(text).alias("sparse"))
    about = recognised(good, raw, body, models).withColumn("error", F.lit(""))
    about = about.unionByName(errors.select("doc_id", F.lit(None).cast(about.schema["entity"].dataType).alias("entity"), "error"))
    return sinks.index_rows(good, chunks.drop("embed_body", "table_html"), vectors), about


def imported(scanned: DataFrame, path: str, known: DataFrame | None = None, force: bool = False, models: Models = Models()) -> tuple[DataFrame, DataFrame]:
    """Import what is new among scanned files: the registry with them ready or failed, and the files with their actions.

    A new version of a file replaces the documents of the same name, chunks and all. Chunks and registry of the store
    at path change in one version: a failure before it leaves both as they were. known is the store's registry if not given.
    """
    spark = scanned.sparkSession
    store = Store(spark, path)
    known = known_documents(spark, path) if known is None else known
    docs, _ = staged(documents(scanned, known, force), "decisions")
    kept = registry.without_replaced(known, docs)
    rows, about = indexed(docs, scanned, models)
    about, _ = staged(about, "about")
    rows, _ = staged(rows, "new-chunks")
    parts, _ = sinks.staged_index(rows, store, known.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti"))
    done = docs.where("action <> 'skip'").dropDuplicates(["doc_id"]).join(about, "doc_id")
    done = done.join(rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count")), "doc_id", "left")
    status = F.when(F.col("error") == "", "ready").otherwise("failed")
    values = done.withColumns({"status": status, "chunk_count": F.coalesce("chunk_count", F.lit(0))})
    columns = [c for c in ("doc_id", "file_name", "content_type", "document_title", "status", "chunk_count", "entity", "error") if c in known.columns]
    files_ = store.written(registry.updated(kept, values.select(*columns)).select(*known.columns))
    store.commit({"index": parts, "registry": files_, "search": {"all": None}})
    return store.read("registry", known.schema), docs


def import_folder(spark: SparkSession, root: str, path: str, known: DataFrame | None = None, force: bool = False, only: str | None = None, models: Models = Models()) -> DataFrame:
    """Import what is new under root into the store at path; gives the registry with the imported documents ready or failed."""
    return imported(files.scan(spark, root, only), path, known, force, models)[0]


def known_documents(spark: SparkSession, path: str) -> DataFrame:
    """The registry of the store at path; empty where there is none yet."""
    return Store(spark, path).read("registry", fields.REGISTRY)


def chunks_of(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the store at path."""
    return Store(spark, path).read("index")


def indexes_of(spark: SparkSession, path: str) -> retrieval.Indexes | None:
    """The search indexes of the newest version of the store at path, if they have been built for it."""
    store = Store(spark, path)
    return retrieval.Indexes.open(spark, f"{store.path}/{store.tables['search']['all']}") if store.has("search") else None


def built_indexes(spark: SparkSession, path: str) -> retrieval.Indexes:
    """Index the chunks of the newest version for search, as a version of its own; a change of chunks takes them out again."""
    store = Store(spark, path)
    name = f"data/{uuid.uuid4().hex}"
    found = retrieval.Indexes.build(store.read("index"), f"{store.path}/{name}")
    store.commit({"search": {"all": name}})
    return found


def entities(known: DataFrame) -> DataFrame:
    """Merged entities of the ready documents of a registry."""
    return ent.merge(known.where("status = 'ready'").select("doc_id", "file_name", "entity"))


def import_stream(spark: SparkSession, root: str, path: str, checkpoint: str, models: Models = Models()) -> object:
    """A query that imports the files under root that no run before has seen into the store at path, then ends.

    Ready contents are skipped, and files of known names replace what was there. A batch that is run again finds its
    documents ready and changes nothing.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(root)

    def batch(rows: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
        seen = rows.withColumns({"file_name": name, "file_ext": ext, "folder": F.lit(""), "file_hash": F.sha2("content", 256)}).where(ext.isin(rules.EXTENSIONS))
        imported(seen, path, models=models)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
