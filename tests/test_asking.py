"""Questions to answers over an imported folder, and the command line."""

from pyspark.sql import functions as F

from quillspark import cli
from quillspark.functions import fields, rules
from quillspark.functions import text as tx
from quillspark.operators import evaluation
from quillspark.streaming import ingest
from quillspark.plans import asking

STATE = f"session_id string, focus array<string>, pending struct<options:array<string>,plan:{fields.PLAN}>"


def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "茅台 季度报告.md").write_text("# 贵州茅台\n\n茅台 营业收入 为 539 亿元。净利润 增长。\n")
    (root / "华夏债券.md").write_text("# 华夏债券\n\n华夏债券 托管费 为 0.10%。\n")
    (root / "华夏成长.md").write_text("# 华夏成长\n\n华夏成长 管理费 为 1.5%。\n")
    return root


def test_ask(spark, tmp_path):
    home = str(tmp_path / "home")
    args = cli.parser().parse_args(["--home", home, "ingest", str(folder(tmp_path))])
    docs = {r.document_title: r for r in cli.run(spark, args).collect()}
    assert len(docs) == 3 and docs["茅台 季度报告"].content_type == "公司定期报告"
    assert cli.run(spark, cli.parser().parse_args(["--home", home, "status"])).first().documents == 3
    found = cli.run(spark, cli.parser().parse_args(["--home", home, "search", "华夏债券 托管费"])).first()
    assert found.file_name == "华夏债券.md" and found.rank == 1
    for n in (1, 2):
        if n == 2:  # from the stored indexes, the same
            assert cli.run(spark, cli.parser().parse_args(["--home", home, "index"])).first().chunks > 0
            assert cli.run(spark, cli.parser().parse_args(["--home", home, "search", "华夏债券 托管费"])).first() == found
        assert cli.run(spark, cli.parser().parse_args(["--home", home, "ask", "华夏债券 托管费", "--session", "t"])).first().kind == "answer"
        assert spark.read.parquet(f"{home}/messages").where("session_id = 't'").count() == 2 * n
    assert spark.read.schema(cli.STATE).parquet(f"{home}/states").where("focus = array('华夏债券')").count() == 2
    assert [r.id for r in cli.run(spark, cli.parser().parse_args(["--home", home, "entities"])).collect()] == sorted(docs)
    questions = tmp_path / "q.jsonl"
    questions.write_text('{"id": "a", "category": "risk", "turns": [{"q": "费"}], "expect": "answer", "gold": [{"file": "华夏债券.md", "quote": "托管费 为 0.10%"}]}\n{"id": "b", "category": "risk", "turns": [{"q": "费"}], "expect": "answer", "gold": [{"file": "华夏债券.md", "quote": "管理费 为 9%"}]}\n')
    faults = cli.run(spark, cli.parser().parse_args(["--home", home, "check", str(questions)])).collect()
    assert [(r.tag, r.error) for r in faults] == [("b#1", "no quote in 华夏债券.md")]

    ids = {k: v.doc_id for k, v in docs.items()}
    entities = spark.createDataFrame(
        [("600519", "贵州茅台酒股份有限公司", "company", ["600519"], ["茅台"], [ids["茅台 季度报告"]]), ("bond", "华夏债券投资基金", "fund", ["001001"], ["华夏"], [ids["华夏债券"]]), ("grow", "华夏成长混合", "fund", ["000001"], ["华夏"], [ids["华夏成长"]])], fields.ENTITY
    )
    chunks = ingest.chunks_of(spark, home)
    registry = cli.known(spark, home).withColumn("source_path", F.lit("p"))
    pending = (["bond", "grow"], ("费率", []))
    state = spark.createDataFrame([("s2", ["600519"], pending), ("s1", ["600519"], None)], STATE)
    asked = [("r1", "s1", " 茅台 营业收入 "), ("r2", "s2", "第一个"), ("r3", "s3", "华夏 怎么样"), ("r4", "s4", ""), ("r5", "s5", "x" * 501)]
    good, bad = asking.accepted(spark.createDataFrame(asked, "request_id string, session_id string, question string"))
    assert sorted((r.request_id, r.reason) for r in bad.collect()) == [("r4", "empty"), ("r5", "too long")]
    replies = {r.request_id: r for r in asking.ask(good, state, entities, chunks, registry).collect()}
    one, two, three = (replies[k] for k in ("r1", "r2", "r3"))
    assert (one.kind, one.answer, one.focus) == ("answer", "茅台营业收入为539亿元。[E1]", ["600519"]) and one.sources[0].file_name == "茅台 季度报告.md" and one.sources[0].entity_codes == ["600519"]
    assert {e.doc_id for e in one.evidence} == {ids["茅台 季度报告"]}
    assert two.plan.standalone_query == "华夏债券投资基金：费率" and two.sources[0].file_name == "华夏债券.md" and two.focus == ["bond"]
    assert three.focus == [] and three.kind == "answer"

    clarify = lambda prompt, question: F.lit('请问哪一个？<<<META>>>{"kind": "clarify", "notices": ["risk"]}')
    reply = {r.request_id: r for r in asking.ask(good, state, entities, chunks, registry, generator=clarify).collect()}["r3"]
    assert reply.kind == "clarify" and sorted(reply.pending.options) == ["bond", "grow"] and reply.evidence is None and reply.answer.endswith(rules.NOTICES["risk"])
    silent = asking.ask(good, state, entities, chunks.where("false"), registry).collect()
    assert {(r.kind, r.answer) for r in silent} == {("refuse", rules.REFUSE)}
    unsafe = lambda prompt, question: F.lit("稳赚不赔。放心[E9]。")
    reply = asking.ask(good.where("request_id = 'r1'"), state, entities, chunks, registry, generator=unsafe).first()
    assert reply.answer == rules.GUARD_REPLACEMENT + "放心。" and reply.guard_hits == ["稳赚不赔", "稳赚"]
    plan = lambda question, history, focus: F.lit('{"standalone_query": "茅台 净利润", "entity_mentions": ["600519"]}')
    reply = asking.ask(good.where("request_id = 'r3'"), state, entities, chunks, registry, planner=plan).first()
    assert reply.focus == ["600519"] and reply.plan.entity_mentions == ["600519"]

    # The planner is told what the session is about.
    about = lambda question, history, focus: F.to_json(F.struct(F.concat(focus, F.lit("的费用")).alias("standalone_query"), F.array(focus).alias("entity_mentions")))
    lost = spark.createDataFrame([("s1", ["gone", "600519"], None)], STATE)
    reply = asking.ask(good.where("request_id = 'r1'"), lost, entities, chunks, registry, planner=about).first()
    assert reply.plan.standalone_query == "贵州茅台酒股份有限公司的费用" and reply.focus == ["600519"]
    reply = asking.ask(good.where("request_id = 'r3'"), state, entities, chunks, registry, planner=about).first()
    assert reply.plan.standalone_query == "（无）的费用"

    gold = [("茅台 季度报告.md", "营业收入 为 539")]
    items = spark.createDataFrame([("i1", "risk", [("茅台 营业收入", "answer", gold, ["539"], ["净利润"])], None, [], [], [], ""), ("i2", "risk", [("无", "refuse", [], [], [])], None, [], [], [], "")], fields.EVAL_ITEM)
    turns = evaluation.turns(items).withColumn("request_id", F.when(F.col("id") == "i1", "r1").otherwise("lost"))
    records = {r.id: r for r in asking.answer_records(turns, asking.ask(good, state, entities, chunks, registry), tx.normal).collect()}
    assert (records["i1"].behavior_ok, records["i1"].include_ok, records["i1"].evidence_hit, records["i1"].cited_gold_file, records["i1"].exclude_hits) == (True, True, True, True, [])
    assert (records["i2"].kind, records["i2"].behavior_ok, records["i2"].error, records["i2"].include_ok) == ("error", False, "no reply", None)
