"""Live answers: guarded sentences and held-back metadata over a stream of deltas, and stateful sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from quillspark.functions import rules
from quillspark.operators.answers import Guard, GuardedStream

MARK = rules.META_MARK
STATE = "tail string, done boolean, context string, waiting string"
#: Milliseconds without a delta after which a stream that never ended is forgotten.
ABANDONED = 3_600_000
#: Milliseconds that a session is remembered after its last turn: thirty days.
IDLE = 30 * 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SHOWN = ["session_id", "seq", "shown", "hits"]


def step(state: tuple, delta: str, last: bool, guard: Guard) -> tuple[tuple, str, list[str]]:
    """The state after a delta, the text that may be shown and the hits in it.

    As many characters as the separator has are held back until it cannot begin there; what follows it
    is never shown. The state holds that tail, the open sentence and as much context as still matters.
    """
    tail, done, context, waiting = state
    if done:
        return state, "", []
    text = tail + delta
    body, mark, _ = text.partition(MARK)
    done = bool(mark) or last
    upto = len(body) if done else max(len(text) - len(MARK), 0)
    stream = GuardedStream(guard, context, waiting)
    shown = stream.take(body[:upto], last=done) if upto or (done and waiting) else ""
    return ("" if done else text[upto:], done, stream.context, stream.waiting), shown, stream.hits


def begun(question: str | None, guard: Guard) -> tuple:
    return "", False, guard.kept(question or ""), ""


def _stepped(rows: pd.DataFrame, now: tuple, guard: Guard) -> tuple[pd.DataFrame, tuple]:
    out = []
    for r in rows.itertuples():
        now, shown, hits = step(now, r.delta or "", bool(r.last), guard)
        out.append((r.session_id, r.seq, shown, hits))
    return pd.DataFrame(out, columns=SHOWN), now


def chat_deltas(prompts: DataFrame, chat: Callable[[str], Iterable[str]]) -> DataFrame:
    """Deltas (session_id, seq, question, delta, last) of a streaming model's answers to prompts (session_id, question, prompt).

    Works on a table and on a stream of prompts; an answer of nothing is one empty delta.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                parts = list(chat(r.prompt)) or [""]
                yield pd.DataFrame({"session_id": r.session_id, "seq": range(len(parts)), "question": r.question, "delta": parts, "last": [False] * (len(parts) - 1) + [True]})

    kind = prompts.schema["session_id"].dataType.simpleString()
    return prompts.select("session_id", "question", "prompt").mapInPandas(each, f"session_id {kind}, seq bigint, question string, delta string, last boolean")


def keyed_state(spark: SparkSession) -> None:
    """Processors of keyed state need a store with column families; a session without a choice gets the one Spark has."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Guarding(StatefulProcessor):
    """What a stream has not shown yet, by session: ended by its last delta, or by a timer when nothing comes for long."""

    def __init__(self, guard: Guard, abandoned: int) -> None:
        self.guard, self.abandoned = guard, abandoned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"{STATE}, seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq")
        now = tuple(self.held.get())[:-1] if self.held.exists() else begun(new["question"].iloc[0], self.guard)
        found, now = _stepped(new, now, self.guard)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if new["last"].fillna(False).astype(bool).any():
            self.held.clear()
        else:
            self.held.update((*now, int(new["seq"].iloc[-1])))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.abandoned)
        yield found

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            *now, seq = self.held.get()
            self.held.clear()
            _, shown, hits = step(tuple(now), "", True, self.guard)
            if shown or hits:
                yield pd.DataFrame([(key[0], seq, shown, hits)], columns=SHOWN)

    def close(self) -> None:
        pass


def guarded_stream(deltas: DataFrame, guard: Guard = Guard(), abandoned: int = ABANDONED) -> DataFrame:
    """Deltas (session_id, seq, question, delta, last) as rows (session_id, seq, shown, hits), whatever batches they come in.

    The state of a session ends with its last delta. When nothing has come for abandoned milliseconds a timer ends it:
    what was held back is checked and shown under the last seq. A batch's deltas of one session are in one task.
    Timers keep a query busy, so that the trigger availableNow does not end: take a period, or once.
    """
    keyed_state(deltas.sparkSession)
    kind = deltas.schema["session_id"].dataType.simpleString()
    shape = f"session_id {kind}, seq bigint, shown string, hits array<string>"
    return deltas.groupBy("session_id").transformWithStateInPandas(Guarding(guard, abandoned), shape, "Append", "ProcessingTime")


def guarded_batch(deltas: DataFrame, guard: Guard = Guard()) -> DataFrame:
    """The same over a table of deltas."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("seq")
        return _stepped(rows, begun(rows["question"].iloc[0], guard), guard)[0]

    kind = deltas.schema["session_id"].dataType.simpleString()
    return deltas.groupBy("session_id").applyInPandas(each, f"session_id {kind}, seq bigint, shown string, hits array<string>")


class Conversing(StatefulProcessor):
    """Focus, options and the last questions of a session; a session without turns for idle milliseconds is forgotten."""

    def __init__(self, idle: int, turns: int) -> None:
        self.idle, self.turns = idle, turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "focus array<string>, options array<string>, pending_query string", self.idle)
        self.asked = handle.getListState("asked", "query string", self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        focus, options, query = self.state.get() if self.state.exists() else ([], [], None)
        asked = [r[0] for r in self.asked.get()] if self.asked.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            asks, chosen = r.kind == "clarify", list(r.entity_ids)
            focus = chosen if chosen and not asks else list(focus)
            options = list(r.candidate_ids) if asks else []
            query = r.standalone_query if options else None
            out.append((key[0], r.seq, focus, options, query, asked))
            asked = [*asked, r.standalone_query][-self.turns :]
        self.state.update((list(focus), list(options), query))
        self.asked.put([(q,) for q in asked])
        yield pd.DataFrame(out, columns=["session_id", "seq", "focus", "options", "pending_query", "history"])

    def close(self) -> None:
        pass


def session_states(turns: DataFrame, idle: int = IDLE, history: int = rules.HISTORY_TURNS) -> DataFrame:
    """Turns (session_id, seq, kind, entity_ids, candidate_ids, standalone_query) with the focus and the options each leaves,
    and the questions before it, history at most. The state of a session lives for idle milliseconds after its last turn."""
    keyed_state(turns.sparkSession)
    kind = turns.schema["session_id"].dataType.simpleString()
    shape = f"session_id {kind}, seq bigint, focus array<string>, options array<string>, pending_query string, history array<string>"
    return turns.groupBy("session_id").transformWithStateInPandas(Conversing(idle, history), shape, "Append", "ProcessingTime")


def shown_events(events: DataFrame) -> DataFrame:
    """What a client gets of an event stream (session_id, seq, type, payload): deltas, sources, the end and errors."""
    return events.where(F.col("type").isin("delta", "sources", "final", "error")).select("session_id", "seq", F.col("type").alias("event"), "payload")
