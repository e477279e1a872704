"""Conversations: last turns, listings, titles, and the state that a turn leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules


def last_turns(messages: DataFrame, turns: int = rules.HISTORY_TURNS, key: str = "session_id", order: str = "created_at") -> DataFrame:
    """The newest 2 * turns messages of each session, at (from 1) in ascending order."""
    new = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = messages.withColumn("_new", new).where(F.col("_new") <= 2 * turns)
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("_new")


def history_text(rows: DataFrame, key: str = "session_id", chars: int = rules.HISTORY_CHARS) -> DataFrame:
    """One text a session: who said what, by lines, each cut at chars."""
    who = F.when(F.col("role") == "user", "用户").otherwise("助手")
    line = F.concat(who, F.lit("："), F.substring("text", 1, chars))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def titles(messages: DataFrame, key: str = "session_id", order: str = "created_at", chars: int = rules.TITLE_CHARS) -> DataFrame:
    """The beginning of each session's earliest user message."""
    return messages.where("role = 'user'").groupBy(key).agg(F.substring(F.min_by("text", order), 1, chars).alias("title"))


def listing(rows: DataFrame, *order: Column, limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def next_state(focus: Column, kind: Column, entity_ids: Column, candidate_ids: Column, plan: Column) -> Column:
    """struct<focus, pending>: a clarification keeps the focus and stores its options; else the turn's entities, if any, are the focus."""
    none = F.array().cast("array<string>")
    focus, entity_ids, candidate_ids = (F.coalesce(c, none) for c in (focus, entity_ids, candidate_ids))
    asks = kind == "clarify"
    kept = F.when(~asks & (F.size(entity_ids) > 0), entity_ids).otherwise(focus)
    pending = F.when(asks & (F.size(candidate_ids) > 0), F.struct(candidate_ids.alias("options"), plan.alias("plan")))
    return F.struct(kept.alias("focus"), pending.alias("pending"))


def clarified_query(name: Column, query: Column) -> Column:
    return F.concat(name, F.lit("："), query)


def turn_messages(turns: DataFrame) -> DataFrame:
    """Two messages a turn (session_id, question, answer, kind, asked_at): the answer a millisecond later."""
    said = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(None).cast("string").alias("kind"), F.col("asked_at").alias("created_at")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"), F.col("kind").alias("kind"), (F.col("asked_at") + F.expr("INTERVAL '0.001' SECOND")).alias("created_at")),
    )
    return turns.select("session_id", F.explode(said).alias("m")).select("session_id", "m.*")


def without_sessions(rows: DataFrame, deleted: DataFrame, key: str = "session_id") -> DataFrame:
    return rows.join(deleted.select(key), key, "left_anti")


def node_seconds(events: DataFrame) -> DataFrame:
    """Seconds from the end of a task's node before (or its submission, seq 0) to the end of each node."""
    before = F.lag("at").over(Window.partitionBy("task_id").orderBy("seq"))
    return events.withColumn("seconds", F.round((F.unix_micros("at") - F.unix_micros(before)) / 1_000_000, 3)).where("seconds is not null")


def friendly_error(name: Column, cases: list = rules.ERRORS, other: str = rules.OTHER_ERROR) -> Column:
    """What a user is told about an error class: the first case that names it."""
    return F.coalesce(*[F.when(name.isin(list(names)), F.lit(message)) for names, message in cases], F.lit(other))


def saved(states: DataFrame, turns: DataFrame) -> DataFrame:
    """Session rows (session_id, title, focus, pending, created_at, updated_at) after turns (session_id, question,
    focus, pending, asked_at): the newest turn of each holds; title and creation stay as the first turn made them."""
    newest = turns.groupBy("session_id").agg(
        F.max_by(F.struct("focus", "pending"), "asked_at").alias("s"), F.max("asked_at").alias("new_updated"), F.min("asked_at").alias("new_created"),
        F.substring(F.min_by("question", "asked_at"), 1, rules.TITLE_CHARS).alias("new_title"),
    )
    both = states.join(newest, "session_id", "full_outer")
    fresh = F.col("new_updated").isNotNull()
    return both.select(
        "session_id", F.coalesce("title", "new_title").alias("title"), F.when(fresh, F.col("s.focus")).otherwise(F.col("focus")).alias("focus"),
        F.when(fresh, F.col("s.pending")).otherwise(F.col("pending")).alias("pending"), F.coalesce("created_at", "new_created").alias("created_at"), F.coalesce("new_updated", "updated_at").alias("updated_at"),
    )


def session_listing(states: DataFrame, messages: DataFrame, limit: int = rules.MOST_SESSIONS) -> DataFrame:
    """The newest sessions; one without a title has its first question's beginning, or none."""
    rows = listing(states, F.desc("updated_at"), F.col("session_id"), limit=limit).join(titles(messages).withColumnRenamed("title", "first"), "session_id", "left")
    return rows.select("session_id", F.coalesce(F.nullif("title", F.lit("")), "first", F.lit("")).alias("title"), "updated_at")


def task_listing(tasks: DataFrame, most: int = rules.MOST_TASKS, finished: tuple = ("done", "failed")) -> DataFrame:
    """Tasks (task_id, status, submitted_at) newest first: of those beyond most, the oldest finished ones go.

    One row a task of a short queue, so its windows need no partition.
    """
    everything = Window.partitionBy()
    rows = tasks.withColumns({"_over": F.count("*").over(everything) - most, "_done": F.col("status").isin(*finished)})
    rows = rows.withColumn("_age", F.row_number().over(Window.partitionBy("_done").orderBy("submitted_at", "task_id")))
    return rows.where(~(F.col("_done") & (F.col("_age") <= F.col("_over")))).drop("_over", "_done", "_age").orderBy(F.desc("submitted_at"), F.desc("task_id"))


def new_id() -> Column:
    """Twelve hexadecimal digits at random."""
    return F.substring(F.replace(F.uuid(), F.lit("-")), 1, 12)


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss")
