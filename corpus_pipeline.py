"""The corpus pipeline: quality filter, exact dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as
Parquet and read back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import content_sort, entropy_mix, near_copies, pair_bpe, rff_quality
from quillspark.llm.queries import tokenizer_file
from quillspark.session import staged, table


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id, null too, is in ids."""
    ids = ids.select(F.col("doc_id").alias("_kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; rows that share an id stay if one of them does.

    Null and empty texts are scored like any other; rows without an id stay if one of these does; no rows give none.
    """
    scores = rff_quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return _with_ids(docs, scores.where("predicted = 1"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    return content_sort.distinct_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles at least 0.8 alike, the document with the smallest id.

    Texts without words, null ones too, are one group; a group of rows without ids keeps them; no rows give none.
    """
    found = near_copies.near_copies(docs)
    return _with_ids(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that share an id are taken alike."""
    key, n, copy = (f"_{uuid.uuid4().hex}" for _ in range(3))  # names that no column of docs has
    copies = entropy_mix.mix(docs).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(n)).where(F.col(n) > 0)
    taken = docs.join(copies, docs["doc_id"].eqNullSafe(copies[key]))
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(n)))).drop(key, n, copy)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every row; null texts are empty, no rows give none."""
    return pair_bpe.round_trip(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("near-dedup", near_dedup),
    ("mixing sources", mix),
    ("bpe encoding", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs, _ = staged(docs, f"stage-{number}")
    return docs


#: A classifier and rounding are among the stages. Tests hold run() against plain Python from the second stage on, and
#: the classifier against numpy.
ORACLE_SQL: str | None = None
