"""Evaluation runs over an imported folder; what sessions and listings keep."""

from datetime import datetime

from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions import fields, rules
from quillspark.operators import evaluation, layout, sessions
from quillspark.streaming import ingest
from quillspark.plans import evaluating
from tests.test_asking import folder


def test_runs(spark, tmp_path):
    home = str(tmp_path / "home")
    cli.run(spark, cli.parser().parse_args(["--home", home, "ingest", str(folder(tmp_path))])).collect()
    chunks, docs = ingest.chunks_of(spark, home), cli.known(spark, home).withColumn("source_path", F.lit(""))
    gold = [("华夏债券.md", "托管费 为 0.10%")]
    items = [
        ("one", "product", [("华夏债券 托管费", "answer", gold, ["0.10%"], [])], None, [], [], [], ""),
        ("two", "multiturn", [("华夏成长", "answer", [], [], []), ("管理费", "answer", [("华夏成长.md", "不在")], [], [])], None, [], [], [], ""),
    ]
    items = spark.createDataFrame(items, fields.EVAL_ITEM)
    records = {(r.id, r.turn): r for r in evaluating.retrieval_records(items, chunks, docs).collect()}
    assert (records["one", 1].rank, records["one", 1].file_rank, records["one", 1].top[0].hit) == (1, 1, True)
    assert (records["two", 2].rank, records["two", 2].file_rank, records["two", 2].query) == (None, 1, "华夏成长 管理费") and not records["two", 1].has_gold
    found = evaluating.answer_records(items, spark.createDataFrame([], fields.ENTITY), chunks, docs)
    rows = {(r.id, r.turn): r for r in found.collect()}
    assert rows["one", 1].behavior_ok and rows["one", 1].include_ok and rows["one", 1].evidence_hit and rows["one", 1].cited_gold_file
    assert {r.kind for r in rows.values()} == {"answer"} and len(rows) == 3
    assert evaluation.answer_summary(found).first().behavior_accuracy == 1.0
    assert {r.id: r.line for r in evaluating.progress(found, "kind").collect()} == {"one": "answer", "two": "answer, answer"}


def test_sessions_are_saved(spark):
    at = lambda k: datetime(2026, 1, 1, 0, 0, k)
    shape = "session_id string, title string, focus array<string>, pending string, created_at timestamp, updated_at timestamp"
    states = spark.createDataFrame([("a", "旧题", ["x"], None, at(0), at(1)), ("c", "", [], None, at(0), at(0))], shape)
    turns = spark.createDataFrame([("a", "问一", ["y"], "p", at(3)), ("a", "问二", ["z"], None, at(4)), ("b", "长" * 50, [], None, at(5))], "session_id string, question string, focus array<string>, pending string, asked_at timestamp")
    rows = {r.session_id: r for r in sessions.saved(states, turns).collect()}
    assert (rows["a"].title, rows["a"].focus, rows["a"].pending, rows["a"].created_at, rows["a"].updated_at) == ("旧题", ["z"], None, at(0), at(4))
    assert rows["b"].title == "长" * 40 and rows["b"].created_at == at(5) and rows["c"].updated_at == at(0)
    messages = spark.createDataFrame([("c", "user", "首问", at(0))], "session_id string, role string, text string, created_at timestamp")
    listed = sessions.session_listing(states, messages).orderBy(F.desc("updated_at")).collect()
    assert [(r.session_id, r.title) for r in listed] == [("a", "旧题"), ("c", "首问")]
    tasks = spark.createDataFrame([("t0", "running", 0), ("t1", "done", 1), ("t2", "failed", 2), ("t3", "queued", 3)], "task_id string, status string, submitted_at int")
    assert [r.task_id for r in sessions.task_listing(tasks, 3).collect()] == ["t3", "t2", "t0"] and sessions.task_listing(tasks).count() == 4
    row = spark.range(1).select(sessions.friendly_error(F.lit("ReadTimeout")).alias("a"), sessions.friendly_error(F.lit("KeyError")).alias("b"), sessions.new_id().alias("i"), sessions.run_id(F.lit(at(7)).cast("timestamp")).alias("r")).first()
    assert (row.a, row.b, len(row.i), row.r) == (rules.ERRORS[1][1], rules.OTHER_ERROR, 12, "20260101T000007")


def test_images_to_describe(spark):
    blocks = spark.createDataFrame([("d", k, "image", f"{k}.png", c, ["甲", "乙", "丙"]) for k, c in enumerate(("图", "", "", "x"))], "doc_id string, seq int, type string, img_path string, caption string, section_path array<string>")
    done = spark.createDataFrame([("d", "3.png", "已述")], "doc_id string, img_path string, description string")
    sizes = spark.createDataFrame([("d", "0.png", 300, 1), ("d", "1.png", 10, 200), ("d", "2.png", 50, 50)], "doc_id string, img_path string, width int, height int")
    assert [(r.seq, r.about) for r in layout.images_to_describe(blocks, done, sizes).orderBy("seq").collect()] == [(0, "图"), (1, "乙 > 丙")]
