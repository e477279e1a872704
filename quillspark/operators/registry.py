"""The registry of documents: what is new, what is done again, what is skipped; its updates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_id(digest: Column) -> Column:
    return F.substring(digest, 1, 16)


def decisions(files: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """files (file_name, file_hash, ...) with doc_id and action: skip a ready document unless force, redo one
    that is known by its hash, else new."""
    rows = files.withColumn("doc_id", document_id(F.col("file_hash")))
    rows = rows.join(known.select("doc_id", F.col("status").alias("_status")), "doc_id", "left")
    action = F.when((F.col("_status") == "ready") & F.lit(not force), "skip").when(F.col("_status").isNotNull(), "redo").otherwise("new")
    return rows.withColumn("action", action).drop("_status")


def latest(rows: DataFrame, key: str = "file_name", order: str = "seen_at") -> DataFrame:
    """The last row of each key; ties go by document id. Versions of a key are reduced to one before they are shuffled."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(order, "doc_id")).alias("_last")).select("_last.*")


def updated(known: DataFrame, changes: DataFrame) -> DataFrame:
    """known with changes (doc_id and some of its columns) put over it; documents of changes that are unknown are added."""
    fresh = changes.select("doc_id", *[F.col(c).alias(f"_n_{c}") for c in changes.columns if c != "doc_id"])
    both = known.join(fresh, "doc_id", "full_outer")
    return both.select("doc_id", *[F.coalesce(f"_n_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in known.columns if c != "doc_id"])


def without_replaced(known: DataFrame, decided: DataFrame) -> DataFrame:
    """known less the documents whose file name a new document takes over."""
    new = decided.where("action = 'new'").select("file_name", F.col("doc_id").alias("_new"))
    return known.join(new, (known["file_name"] == new["file_name"]) & (known["doc_id"] != new["_new"]), "left_anti")


def page_counts(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, page_count: the last page of its blocks; 1 without any."""
    pages = raw.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("page_count"))
    return docs.select("doc_id").join(pages, "doc_id", "left").select("doc_id", F.coalesce("page_count", F.lit(1)).alias("page_count"))


def stale(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti")


def report(decided: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row: files scanned, names by action, names that are ready, errors by name."""
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("file_name"))))
    rows = decided.join(outcome, "file_name", "left")
    failed = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.struct("file_name", "error")))))
    return rows.agg(F.count("*").alias("scanned"), *[names(F.col("action") == a).alias(a) for a in ("new", "redo", "skip")], names(F.col("status") == "ready").alias("ready"), failed.alias("failed"))


def upload_check(name: Column, extensions: list[str]) -> Column:
    """struct<ok, reason> of an uploaded file's name."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    kind = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    reason = F.when(base == "", "no file name").when(~kind.isin(extensions), F.concat(F.lit("not supported: "), base))
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def question_check(question: Column, most: int) -> Column:
    """struct<ok, reason> of a question."""
    from quillspark.functions.text import strip

    plain = strip(F.coalesce(question, F.lit("")))
    reason = F.when(plain == "", "empty").when(F.length(plain) > most, "too long")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))
