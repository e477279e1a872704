"""Evaluation runs: questions against the index, or against whole answers, with records and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions import text as tx
from quillspark.operators import evaluation, retrieval
from quillspark.plans import asking
from quillspark.session import staged


def retrieval_records(items: DataFrame, chunks: DataFrame, docs: DataFrame, embed: Callable[[Column], Column] = retrieval.dense_vector, k: int = rules.EVAL_TOP) -> DataFrame:
    """A record a turn: id, turn, category, expect, query, has_gold, rank, file_rank, top_score, top.

    A turn asks with all questions before it; top holds its first hits and whether each is gold.
    """
    turns = evaluation.followup_queries(evaluation.turns(items)).withColumn("query_id", F.concat_ws("#", "id", "turn"))
    turns, _ = staged(turns.withColumns({"dense": embed(F.col("query")), "sparse": retrieval.sparse_vector(F.col("query"))}), "eval-turns")
    hits = retrieval.search(turns, chunks, docs, k).withColumn("plain", tx.normal("text"))
    hits, _ = staged(hits.select("query_id", "rank", "file_name", "plain", "score", "page_start", "page_end"), "eval-hits")
    gold = turns.select("query_id", F.explode("gold").alias("g")).select("query_id", "g.file", tx.normal("g.quote").alias("quote"))
    ranks = evaluation.first_ranks(hits, gold)
    marks = hits.join(gold.withColumnRenamed("file", "file_name"), ["query_id", "file_name"]).where(F.col("plain").contains(F.col("quote"))).select("query_id", "rank").distinct().withColumn("hit", F.lit(True))
    kept = hits.where(F.col("rank") <= rules.EVAL_KEPT).join(marks, ["query_id", "rank"], "left")
    shown = F.struct("rank", "file_name", F.concat_ws("-", "page_start", "page_end").alias("pages"), "score", F.coalesce("hit", F.lit(False)).alias("hit"))
    tops = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(shown)).alias("top"))
    rows = turns.join(ranks, "query_id", "left").join(tops, "query_id", "left")
    return rows.select("id", "turn", "category", "expect", "query", (F.size("gold") > 0).alias("has_gold"), "rank", "file_rank", F.get("top", F.lit(0))["score"].alias("top_score"), "top")


def answer_records(items: DataFrame, entities: DataFrame, chunks: DataFrame, docs: DataFrame, **models: Callable) -> DataFrame:
    """Records of whole answers: conversations go on turn by turn, each turn asked for all items at once.

    As many rounds as the longest conversation has turns.
    """
    turns = evaluation.turns(items).withColumn("request_id", F.concat_ws("#", "id", "turn"))
    turns, _ = staged(turns, "eval-turns")
    spark = items.sparkSession
    state = spark.createDataFrame([], "session_id string, focus array<string>, pending struct<options:array<string>,plan:struct<standalone_query:string,entity_mentions:array<string>>>")
    replies = None
    for n in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        asked = turns.where(F.col("turn") == n).select("request_id", F.col("id").alias("session_id"), F.col("q").alias("question"))
        some, _ = staged(asking.ask(asked, state, entities, chunks, docs, **models), "replies")
        state = some.select("session_id", "focus", "pending")
        replies = some if replies is None else replies.unionByName(some)
    return asking.answer_records(turns, replies, tx.normal)


def progress(records: DataFrame, field: str) -> DataFrame:
    """id and one line of a field over its turns."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce(F.col(field).cast("string"), F.lit("-")).alias("v")))), lambda x: x["v"])
    return records.groupBy("id").agg(F.array_join(parts, ", ").alias("line"))
