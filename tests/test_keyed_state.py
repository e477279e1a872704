"""Guarded streams and sessions with keyed state: restarts, expiry, equality with the batch."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.streaming import guard as live

DELTAS = "session_id string, seq bigint, question string, delta string, last boolean"
TURNS = "session_id string, seq bigint, kind string, entity_ids array<string>, candidate_ids array<string>, standalone_query string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def runs(spark, tmp_path, schema, batches, function, pause=0.0):
    """The rows that a query makes which is stopped and started again for each batch."""
    source = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        made = function(spark.readStream.schema(schema).parquet(str(source)))
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination(120)
        time.sleep(pause)
    return spark.read.parquet(str(tmp_path / "out"))


def test_a_restarted_stream_is_the_batch(spark, tmp_path):
    parts = ["这只", "股票稳赚", "不赔！历史业绩", "不代表未来。", "<<<ME", "TA>>>{}"]
    rows = [(s, k, "问", d, k == len(parts) - 1) for s in "ab" for k, d in enumerate(parts)]
    found = runs(spark, tmp_path, DELTAS, [[r for r in rows if r[1] // 2 == n] for n in range(3)], live.guarded_stream)
    key = lambda df: sorted(map(str, df.select("session_id", "seq", "shown", "hits").collect()))
    assert key(found) == key(live.guarded_batch(spark.createDataFrame(rows, DELTAS)))


def test_an_abandoned_stream_shows_what_it_held_and_ends(spark, tmp_path):
    batches = [[("a", 0, "问", "股票稳赚不赔", False), ("b", 0, "问", "正常文字", False)], [("c", 0, "问", "别的。", True)], [("a", 7, "问", "新的一句。", True)]]
    found = runs(spark, tmp_path, DELTAS, batches, lambda df: live.guarded_stream(df, abandoned=1), pause=0.3)
    shown = {s: "".join(r.shown for r in found.where(F.col("session_id") == s).orderBy("seq").collect()) for s in "abc"}
    assert shown == {"a": rules.GUARD_REPLACEMENT + "新的一句。", "b": "正常文字", "c": "别的。"}
    assert [r.hits for r in found.where("session_id = 'a' and seq = 0 and size(hits) > 0").collect()] == [["稳赚不赔", "稳赚"]]


def turns(n, first=0):
    return [("s", k, "clarify" if k == 1 else "answer", ["e1"] if k == 0 else [], ["x", "y"] if k == 1 else [], f"q{k}") for k in range(first, first + n)]


def test_sessions_survive_restarts(spark, tmp_path):
    found = runs(spark, tmp_path, TURNS, [turns(2), turns(2, 2)], lambda df: live.session_states(df, history=2)).orderBy("seq").collect()
    assert [(r.focus, r.options, r.pending_query) for r in found] == [(["e1"], [], None), (["e1"], ["x", "y"], "q1"), (["e1"], [], None), (["e1"], [], None)]
    assert [r.history for r in found] == [[], ["q0"], ["q0", "q1"], ["q1", "q2"]]


def test_idle_sessions_are_forgotten(spark, tmp_path):
    found = runs(spark, tmp_path, TURNS, [turns(1), turns(1, 2)], lambda df: live.session_states(df, idle=1), pause=0.2).orderBy("seq").collect()
    assert [(r.focus, r.history) for r in found] == [(["e1"], []), ([], [])]
