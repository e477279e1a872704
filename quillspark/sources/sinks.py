"""Sinks: the chunk index, the registry, evaluation archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import rules, text as tx
from quillspark.session import dropped, staged
from quillspark.sources.snapshots import Store, part_of


def index_rows(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of the chunk index: ids ``doc-0001``, texts cut to their byte limits, vectors (doc_id, seq, dense, sparse).

    Every chunk must have a vector; one without fails the write. An empty sparse vector gets one vanishing weight.
    """
    rows = chunks.join(vectors, ["doc_id", "seq"], "left").join(docs.select("doc_id", "content_type"), "doc_id")
    dense = F.when(F.col("dense").isNull(), F.raise_error(F.concat(F.lit("no vector for chunk "), "seq", F.lit(" of "), "doc_id"))).otherwise(F.col("dense"))
    sparse = F.when(F.coalesce(F.size("sparse"), F.lit(0)) < 1, F.create_map(F.lit(0), F.lit(1e-6).cast("float"))).otherwise(F.col("sparse"))
    return rows.select(
        F.format_string("%s-%04d", "doc_id", "seq").alias("chunk_id"), "kind", "content_type", tx.fit_bytes(F.col("section_path"), rules.PATH_BYTES).alias("section_path"),
        "page_start", "page_end", "derived", tx.fit_bytes(F.col("text"), rules.TEXT_BYTES).alias("text"), dense.alias("dense"), sparse.alias("sparse"), "doc_id",
    )


def staged_index(rows: DataFrame, store: Store, gone: DataFrame | None = None) -> tuple[dict[str, str | None], int]:
    """Parts of the index with the chunks of the documents in rows replaced, and those of the documents gone dropped.

    Gives the parts for a commit and the number of chunks of rows' documents, which must be that of rows. Only the
    parts of these documents (at most 256) are read, and written anew beside the old ones: nothing changes before
    the commit.
    """
    rows, path_of_rows = staged(rows.withColumn("part", part_of()), "index-rows")
    ids = rows.select("doc_id") if gone is None else rows.select("doc_id").unionByName(gone.select("doc_id"))
    ids, path_of_ids = staged(ids.distinct().withColumn("part", part_of()), "index-ids")
    touched = [r.part for r in ids.select("part").distinct().collect()]
    schema = rows.drop("part").schema
    kept = store.read("index", schema, touched).join(ids.select("doc_id"), "doc_id", "left_anti").withColumn("part", part_of())
    whole = rows.unionByName(kept.select(*rows.columns))
    new = store.written(whole.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(8))), "part")
    due, count = rows.count(), 0
    if new:
        held = store.spark.read.schema(schema).parquet(*[f"{store.path}/{f}" for f in new.values()])
        count = held.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").count()
    for used in (path_of_rows, path_of_ids):
        dropped(store.spark, used)
    if count != due:
        raise ValueError(f"{count} chunks in the index, {due} expected")
    return dict.fromkeys(touched) | new, count


def write_index(rows: DataFrame, path: str, gone: DataFrame | None = None) -> int:
    """Replace and drop chunks of the store at path in one version of its own; gives the number of chunks written."""
    store = Store(rows.sparkSession, path)
    parts, count = staged_index(rows, store, gone)
    store.commit({"index": parts, "search": {"all": None}})
    return count


def write_eval(records: DataFrame, summary: DataFrame, meta: dict[str, str], path: str) -> None:
    """Records, summary and a row of meta as JSON under path."""
    records.write.mode("overwrite").json(f"{path}/records")
    summary.write.mode("overwrite").json(f"{path}/summary")
    spark: SparkSession = records.sparkSession
    spark.createDataFrame([tuple(meta.values())], [*meta]).write.mode("overwrite").json(f"{path}/meta")
