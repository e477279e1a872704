"""A thin command line: import a folder, show the registry and its entities, search, ask, check questions.

    python -m quillspark.cli --home HOME ingest FOLDER
    python -m quillspark.cli --home HOME index
    python -m quillspark.cli --home HOME vacuum [--keep 2]
    python -m quillspark.cli --home HOME search QUERY [-k 5] [--kind text]
    python -m quillspark.cli --home HOME ask QUESTION [--session ID]
    python -m quillspark.cli --home HOME check QUESTIONS.jsonl
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import fields, rules, text as tx
from quillspark.operators import evaluation, retrieval, sessions
from quillspark.plans import asking
from quillspark.session import exists, staged
from quillspark.sources import files
from quillspark.sources.snapshots import Store
from quillspark.streaming import ingest

STATE = f"session_id string, focus array<string>, pending struct<options:array<string>,plan:{fields.PLAN}>, asked_at timestamp"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    out.add_argument("--home", required=True, help="folder of the index and the registry")
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("folder")
    one.add_argument("--force", action="store_true")
    one.add_argument("--only")
    commands.add_parser("index")
    commands.add_parser("vacuum").add_argument("--keep", type=int, default=2)
    commands.add_parser("status")
    commands.add_parser("entities")
    commands.add_parser("check").add_argument("items")
    for name in ("search", "ask"):
        one = commands.add_parser(name)
        one.add_argument("text")
        one.add_argument("-k", type=int, default=rules.TOP_K)
        one.add_argument("--kind", action="append")
        one.add_argument("--content-type", action="append")
    one.add_argument("--session", default="cli")
    return out


def known(spark: SparkSession, home: str) -> DataFrame:
    return ingest.known_documents(spark, home)


def asked(spark: SparkSession, home: str, question: str, session: str, docs: DataFrame) -> DataFrame:
    """kind, answer of a question of a session; its messages and the state it leaves are saved."""
    questions = spark.createDataFrame([("q", session, question)], "request_id string, session_id string, question string")
    states, messages = f"{home}/states", f"{home}/messages"
    before = spark.read.schema(STATE).parquet(states) if exists(spark, states) else spark.createDataFrame([], STATE)
    newest = before.where(F.col("session_id") == session).orderBy(F.desc("asked_at")).limit(1).drop("asked_at")
    replies, _ = staged(asking.ask(questions, newest, ingest.entities(docs), ingest.chunks_of(spark, home), docs, indexes=ingest.indexes_of(spark, home)).withColumn("asked_at", F.current_timestamp()), "replies")
    sessions.turn_messages(replies.select("session_id", "question", "answer", "kind", "asked_at")).write.mode("append").parquet(messages)
    replies.select("session_id", "focus", "pending", "asked_at").write.mode("append").parquet(states)
    return replies.select("kind", "answer")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The result of a command as a table."""
    docs = known(spark, args.home)
    if args.command == "ingest":
        return ingest.import_folder(spark, args.folder, args.home, None, args.force, args.only).orderBy("file_name")
    if args.command == "index":
        built = ingest.built_indexes(spark, args.home)
        return spark.createDataFrame([(built.dense.total, len(built.dense.centres), built.dense.probes)], "chunks bigint, cells int, probes int")
    if args.command == "vacuum":
        return spark.createDataFrame([(f,) for f in Store(spark, args.home).vacuum(args.keep)], "dropped string")
    if args.command == "status":
        return docs.groupBy("status").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"), F.array_sort(F.collect_set(F.when(F.col("error") != "", F.concat_ws(": ", "file_name", "error")))).alias("errors")).orderBy("status")
    if args.command == "entities":
        return ingest.entities(docs).orderBy("id")
    chunks = ingest.chunks_of(spark, args.home)
    docs = docs.withColumn("source_path", F.lit(""))
    if args.command == "check":
        lines = files.eval_items(spark, args.items)
        bad = lines.where("error is not null").select(F.concat(F.lit("line "), "line").alias("tag"), "error")
        own = evaluation.corpus(chunks, docs, tx.normal)
        return bad.unionByName(evaluation.self_check(lines.where("error is null"), own, tx.normal)).orderBy("tag", "error")
    if args.command == "ask":
        return asked(spark, args.home, args.text, args.session, docs)
    text = spark.createDataFrame([("q", args.text)], "query_id string, query string")
    queries = text.withColumns({"dense": retrieval.dense_vector("query"), "sparse": retrieval.sparse_vector(F.col("query"))})
    found = retrieval.search(queries, chunks, docs, args.k, where=retrieval.scalar_filter(args.kind, args.content_type), indexes=ingest.indexes_of(spark, args.home))
    return found.select("rank", "score", "file_name", "section_path", "page_start", "text").orderBy("rank")


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    run(spark, args).show(50, truncate=200)
    spark.stop()


if __name__ == "__main__":
    main()
