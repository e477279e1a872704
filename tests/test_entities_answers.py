"""Entities, mentions, guarded answers, citations, model output, evaluation, sessions and registry."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import fields, rules
from quillspark.functions import text as tx
from quillspark.operators import answers, evaluation, registry, retrieval, sessions
from quillspark.operators import entities as ent
from quillspark.plans import catalogue

BASE = [
    ("bond", "华夏债券投资基金（华夏债券C）", "fund", ["001001", "001003"], ["华夏债券C", "华夏债券", "华夏"], []),
    ("fcf", "华夏国证自由现金流ETF发起式联接基金", "fund", ["023917"], ["华夏自由现金流", "华夏"], []),
    ("maotai", "贵州茅台酒股份有限公司", "company", ["600519"], ["贵州茅台", "茅台"], []),
]
AUTO = [
    ("fcf", "华夏国证自由现金流交易型开放式指数证券投资基金发起式联接基金", "fund", ["023917"], ["华夏国证自由现金流ETF发起式联接", "华夏自由现金流联接"], []),
    ("zzys", "易方达智造优势混合型证券投资基金", "fund", ["011300"], ["易方达智造优势"], []),
    ("cmb", "招商银行股份有限公司", "company", ["600036"], ["招行"], []),
    ("ldy", "中国建设银行广东省分行利得盈2013年第17期人民币非保本理财", "wealth_product", [], ["建行利得盈2013年第17期"], []),
    ("bond", "华夏债券投资基金", "fund", ["001001"], ["华夏债券C"], []),
    ("mp", "中国货币政策执行报告", "document", [], [], []),
]
ANY = [("confirmed", ["fcf"]), ("ambiguous", ["bond", "fcf"]), ("unknown", []), ("none", [])]


def resolved(spark, entities, mentions):
    known = spark.createDataFrame(entities, fields.ENTITY)
    asked = spark.createDataFrame([(k, m) for k, m in enumerate(mentions)], "request_id int, mentions array<string>")
    return [(r.status, sorted(r.entity_ids or r.candidate_ids)) for r in ent.resolve(asked, known).orderBy("request_id").collect()]


def test_resolve(spark):
    found = resolved(spark, BASE, [["001003"], ["华夏债券C"], ["茅台"], ["华夏的那只基金"], ["宁德时代"], ["基金"], [], ["茅台", "华夏", "宁德时代"]])
    assert found == [("confirmed", ["bond"]), ("confirmed", ["bond"]), ("confirmed", ["maotai"]), ANY[1], ANY[2], ANY[3], ANY[3], ("confirmed", ["maotai"])]


def test_resolve_variants(spark):
    asked = ["华夏自由现金流ETF联接", "华夏国证自由现金流联接基金", "建行利得盈理财", "华夏基金", "华夏的那只基金", "易方达蓝筹精选混合", "工商银行", "工商银行股份有限公司", "华夏成长混合", "货币基金", "投资者教育资料", "季报"]
    found = resolved(spark, AUTO, [[m] for m in asked])
    assert found == [ANY[0], ANY[0], ("confirmed", ["ldy"]), ANY[1], ANY[1], *[ANY[2]] * 4, *[ANY[3]] * 3]


def test_pick_option(spark):
    options = [{"name": e[1], "aliases": e[4]} for e in BASE[:2]]
    replies = {"第一个": 0, "2": 1, "债券那只": 0, "自由现金流的": 1, "茅台营收多少": None, "4": None, "": None}
    assert {r: ent.pick_option(r, options) for r in replies} == replies
    df = spark.createDataFrame([(r,) for r in replies], "r string").withColumn("o", F.array(*[F.struct(F.lit(o["name"]).alias("name"), F.array(*map(F.lit, o["aliases"])).alias("aliases")) for o in options]))
    assert {r.r: r.at for r in df.select("r", ent.picked_option("r", "o").alias("at")).collect()} == replies


def test_longest_common():
    import random

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert ent.longest_common(a, b) == max((j - i for i in range(len(a) + 1) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)


def test_grounded(spark):
    text = "基金名称 华夏债券投资基金 基金简称 华夏债券 基金代码 001001 华夏债券A 华夏债券C 001003"
    rows = [
        ("fund", "华夏债券投资基金", ["001001", "001003"], ["华夏债券C", "华夏债", "华夏债券"], text, "华夏债券投资基金（华夏债券C）概要"),
        ("company", "招商银行股份有限公司", ["600036"], ["招行", "招商银行"], "A 股代码：600036 招商银行股份有限公司", "招商银行季报"),
        ("fund", "华夏债券投资基金", ["001001", "999999"], ["基金", "本基金", "易方达", "华夏债券C"], text, "华夏债券资料概要"),
        ("fund", "华夏成长混合", ["001001"], None, text, "资料甲"), ("stock", "华夏债券投资基金", None, None, text, "资料甲"), (None, None, None, None, text, "资料甲"),
    ]
    df = spark.createDataFrame(rows, "type string, name string, codes array<string>, aliases array<string>, text string, title string")
    found = [r.e.asDict() for r in df.select(ent.grounded(*map(F.col, df.columns)).alias("e")).collect()]
    document = {"type": "document", "name": "资料甲", "codes": [], "aliases": []}
    assert found == [
        {"type": "fund", "name": "华夏债券投资基金", "codes": ["001001", "001003"], "aliases": ["华夏债券C", "华夏债", "华夏债券"]},
        {"type": "company", "name": "招商银行股份有限公司", "codes": ["600036"], "aliases": ["招行", "招商银行"]},
        {"type": "fund", "name": "华夏债券投资基金", "codes": ["001001"], "aliases": ["华夏债券C"]}, document, document, document,
    ]


def merged(spark, docs):
    df = spark.createDataFrame(docs, "doc_id string, file_name string, entity struct<type:string,name:string,codes:array<string>,aliases:array<string>>")
    return {r.id: r for r in ent.merge(df).collect()}


def test_merge(spark):
    docs = [
        ("q1", "1", ("company", "贵州茅台酒股份有限公司", ["600519"], ["茅台"])), ("kfs", "2", ("fund", "华夏债券投资基金", ["001001", "001003"], [])),
        ("h1", "3", ("company", "贵州茅台酒股份有限公司", [], ["贵州茅台"])), ("kfs2", "4", ("fund", "华夏债券基金", ["001003"], ["华夏债券C"])),
        ("faq", "5", ("document", "投资者问答", [], [])), ("old", "6", None),
    ]
    found = merged(spark, docs)
    assert set(found) == {"600519", "001001", "投资者问答"}
    assert (found["600519"].doc_ids, found["600519"].aliases) == (["q1", "h1"], ["茅台", "贵州茅台"]) and found["001001"].doc_ids == ["kfs", "kfs2"]
    found = merged(spark, [("a", "1", ("fund", "A", ["1"], [])), ("b", "2", ("fund", "B", ["1"], [])), ("c", "3", ("fund", "B", [], []))])
    assert sorted(r.doc_ids for r in found.values()) == [["a", "b"], ["c"]]


def test_merge_is_the_global_fold(spark):
    import random

    rng = random.Random(8)
    docs = [(f"d{k:03d}", f"{k:03d}", ("fund", f"n{rng.randrange(40)}", sorted({f"c{rng.randrange(60)}" for _ in range(rng.randrange(3))}), [])) for k in range(120)]
    groups = []
    for key, _, (_, name, codes, _) in docs:
        met = [g for g in groups if g["name"] == name or g["codes"] & set(codes)]
        home = met[0] if met else {"name": name, "codes": set(), "ids": []}
        groups = [g for g in groups if g not in met[1:]] + ([] if met else [home])
        for g in met[1:]:
            home["codes"] |= g["codes"]
            home["ids"] += g["ids"]
        home["codes"] |= set(codes)
        home["ids"].append(key)
    assert sorted(sorted(r.doc_ids) for r in ent.merge(spark.createDataFrame(docs, "doc_id string, file_name string, entity struct<type:string,name:string,codes:array<string>,aliases:array<string>>")).collect()) == sorted(sorted(g["ids"]) for g in groups)


GUARDED = [
    ("这只基金保证收益，放心买。", "", ["保证收益"]), ("这款理财稳赚不赔。", "", ["稳赚不赔", "稳赚"]), ("茅台股价一定会上涨。", "", ["一定会上涨"]), ("建议您现在买入华夏债券C。", "", ["建议您现在买入"]),
    ("本产品不保证本金和收益，也不保证收益。", "", []), ("金融产品不存在稳赚不赔的情况。", "", []), ("理财产品并非零风险。", "", []), ("我们不建议您买入任何具体产品。", "", []),
    ("私募基金不得承诺最低收益，更不能保证收益。", "", []), ("非法集资通常保本保息。", "", []), ("要警惕声称稳赚不赔的推销。", "", []), ("这款产品保本保息，年化8%。", "", ["保本保息"]),
    ("通常保本保息。", "怎么分辨非法集资？", []), ("保证收益，真的保证收益，不会保证收益。", "", ["保证收益", "保证收益"]), ("警惕！推荐买入。", "", ["推荐买入"]),
]


def test_violations(spark):
    guard = answers.Guard()
    assert [guard.violations(s, c) for s, c, _ in GUARDED] == [w for _, _, w in GUARDED]
    df = spark.createDataFrame([(k, s, c) for k, (s, c, _) in enumerate(GUARDED)], "k int, s string, c string")
    assert [r.v for r in df.select("k", answers.violations(F.col("s"), F.col("c")).alias("v")).orderBy("k").collect()] == [w for _, _, w in GUARDED]


def test_guarded_stream(spark):
    stream = answers.GuardedStream(answers.Guard())
    out = stream.take("茅台一季度营收增长6.54%。这只股票稳赚") + stream.take("不赔！历史业绩不代表未来", last=True)
    assert out == "茅台一季度营收增长6.54%。" + rules.GUARD_REPLACEMENT + "历史业绩不代表未来" and stream.hits == ["稳赚不赔", "稳赚"]
    df = spark.createDataFrame([(1, "肯定涨\n好的", "q"), (2, None, None)], "answer_id int, text string, question string")
    found = {r.answer_id: r for r in answers.guarded(df).collect()}
    assert found[1].guarded == rules.GUARD_REPLACEMENT + "\n好的" and found[1].hits == ["肯定涨"] and found[2].guarded == ""
    rows = spark.createDataFrame([(1, 0, "警惕骗局。"), (1, 1, "保本保息。"), (2, 0, "保本保息。")], "answer_id int, at int, sentence string")
    assert sorted((r.answer_id, r["at"], r.hits) for r in answers.guarded_sentences(rows, answers.Guard(), "answer_id").collect()) == [(1, 0, []), (1, 1, []), (2, 0, ["保本保息"])]


def test_citations(spark):
    df = spark.createDataFrame([("甲[E2]，乙【E1】，另见[E9]。[E2] E1 [E01]",)], "t string")
    row = df.select(answers.citations(F.col("t"), F.array(F.lit(1), F.lit(2))).alias("c")).first().c
    assert (row.text, row.used) == ("甲[E2]，乙[E1]，另见。[E2] E1 [E1]", [2, 1])
    assert df.select(answers.excluded(F.lit("不能保证收益，也保本"), F.array(F.lit("保证收益"), F.lit("保本"), F.lit("无")))).first()[0] == ["保本"]


META = [
    ('正文[E1]<<<META>>>{"kind": "answer", "cited": [1, "2", true, "x"], "notices": ["risk", "risk", "no"]}', ("answer", [1, 2], ["risk"], True)),
    ("只有正文[E3]【E1】", ("answer", [3, 1], [], False)), ("x<<<META>>>不是JSON", ("answer", [], [], False)), ('x<<<META>>>{"kind": "other"}', ("answer", [], [], False)),
    ('x<<<META>>>```json\n{"kind": "refuse"}\n```', ("refuse", [], [], True)), ("x[E2]<<<META>>>{坏", ("answer", [2], [], False)), ('<<<META>>>{"kind": "chitchat", "cited": 3}', ("chitchat", [], [], True)),
]


def test_meta(spark):
    df = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(META)], "k int, raw string").withColumn("p", answers.body_and_meta(F.col("raw")))
    found = df.select("k", answers.parsed_meta("p.meta", "p.body").alias("m")).orderBy("k").collect()
    assert [(r.m.kind, r.m.cited, r.m.notices, r.m.meta_ok) for r in found] == [w for _, w in META]
    assert answers.plan_of('说明 {"standalone_query": "问", "entity_mentions": ["茅台"]}', "q") == ("问", ["茅台"]) and answers.plan_of("坏", "q") == ("q", []) and answers.plan_of('{"standalone_query": "问", "entity_mentions": [1]}', "q") == ("q", [])


def test_rendering(spark):
    row = spark.createDataFrame([(1, "题", "类", 3, 5, True, "文" * 9, "名", ["1", "2"], "f.pdf")], "eid int, document_title string, content_type string, page_start int, page_end int, derived boolean, text string, entity_name string, entity_codes array<string>, file_name string")
    assert row.select(answers.prompt_block(4)).first()[0] == "[E1] 〔题｜类｜第3-5页｜据图表示意〕\n文文文文"
    assert row.select(answers.source_line()).first()[0] == "[E1] 题｜类｜名（1、2）｜f.pdf｜第3-5页"
    bare = row.withColumns({"page_start": F.lit(0), "entity_name": F.lit(""), "derived": F.lit(False)})
    assert bare.select(answers.source_line()).first()[0] == "[E1] 题｜类｜f.pdf" and bare.select(answers.prompt_block(1)).first()[0] == "[E1] 〔题｜类〕\n文"
    assert row.select(answers.with_notices(F.lit("答"), F.array(F.lit("risk"), F.lit("x")))).first()[0] == "答\n\n" + rules.NOTICES["risk"]
    assert row.select(answers.clarification(F.array(F.lit("甲"), F.lit("乙")))).first()[0].split("\n")[1:3] == ["1. 甲", "2. 乙"]


def test_ranks_and_metrics(spark):
    hits = spark.createDataFrame([("q", 1, "b", "xx"), ("q", 2, "a", "no"), ("q", 3, "a", "has quote"), ("r", 1, "z", "quote")], "query_id string, rank int, file_name string, plain string")
    gold = spark.createDataFrame([("q", "a", "quote"), ("r", "a", "quote")], "query_id string, file string, quote string")
    assert sorted(map(tuple, evaluation.first_ranks(hits, gold).collect()), key=str) == [("q", 3, 2), ("r", None, None)]
    ranks = spark.createDataFrame([(1,), (3,), (None,), (6,)], "rank int")
    assert tuple(ranks.agg(*evaluation.retrieval_metrics()).first()) == (4, 0.25, 0.5, 0.5, 0.75, 0.375)
    ten = spark.range(10).select(F.lit("k").alias("g"), F.col("id").cast("double").alias("v"))
    assert tuple(ten.agg(*evaluation.distribution("v")).first()) == (10, 0.0, 0.0, 4.5, 8.0, 9.0)
    assert tuple(evaluation.distribution_by_rank(ten, "v", ["g"]).first())[1:] == (10, 0.0, 0.0, 4.5, 8.0, 9.0)


def test_turns_and_self_check(spark):
    gold = lambda f, q: [(f, q)]
    items = [
        ("x1", "product", [("问", None, [], [], [])], "answer", gold("a.pdf", "营业收入"), ["必"], [], ""),
        ("x2", "product", [("问", "answer", gold("a.pdf", "不在其中"), [], [])], None, [], [], [], ""),
        ("x3", "product", [("问", "answer", gold("b.pdf", "营业收入"), [], [])], None, [], [], [], ""),
        ("x4", "multiturn", [("一", "answer", gold("a.pdf", "营业收入"), [], [])], "refuse", [], [], [], ""),
        ("x5", "negative", [("问", None, [], [], [])], None, [], [], [], ""), ("x5", "compliance", [("问", "answer", [], [], [])], None, [], [], [], ""),
    ]
    df = spark.createDataFrame(items, fields.EVAL_ITEM)
    first = evaluation.turns(df).where("id = 'x1'").first()
    assert (first.expect, first.gold[0].file, first.must_include, first.turn) == ("answer", "a.pdf", ["必"], 1)
    corpus = spark.createDataFrame([("a.pdf", "…营业收入53…")], "file string, plain string")
    found = sorted((r.tag, r.error) for r in evaluation.self_check(df, corpus, tx.normal).collect())
    assert found == [("x2#1", "no quote in a.pdf"), ("x3#1", "no file b.pdf"), ("x4", "two turns expected"), ("x5", "id repeated"), ("x5#1", "no expect")]
    assert [r.query for r in evaluation.followup_queries(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, turn int, q string")).orderBy("turn").collect()] == ["x", "x y"]


def test_answer_summary(spark):
    shape = "id string, turn int, category string, expect string, kind string, behavior_ok boolean, include_ok boolean, exclude_hits array<string>, guard_violations array<string>, evidence_hit boolean, cited_gold_file boolean, error string, has_gold boolean, rank int, file_rank int"
    rows = [("a", 1, "multiturn", "answer", "answer", True, None, [], [], True, True, None, True, 1, 1), ("a", 2, "multiturn", "refuse", "realtime_notice", False, True, ["x"], [], None, None, None, False, None, None), ("b", 1, "risk", "answer", "refuse", False, False, [], ["y", "y"], False, None, "E", True, None, 2)]
    df = spark.createDataFrame(rows, shape)
    r = evaluation.answer_summary(df).first()
    assert (r.behavior_accuracy, r.negative_refusal_rate, r.false_refusal_rate, r.must_include_pass_rate, r.guard_violations, r.errors) == (0.3333, 1.0, 0.5, 0.5, 2, 1)
    assert tuple(evaluation.chains_passed(df).first()) == (0, 1)
    assert {(r.level, r.category): (r.n, r.hit_1) for r in evaluation.retrieval_summary(df).collect()} == {("chunk", "multiturn_t1"): (1, 1.0), ("chunk", "risk"): (1, 0.0), ("chunk", "overall"): (2, 0.5), ("file", "multiturn_t1"): (1, 1.0), ("file", "risk"): (1, 0.0), ("file", "overall"): (2, 0.5)}
    assert df.select(evaluation.cited_gold(F.array(F.lit("a")), F.col("kind"), F.array(F.lit("a")))).collect()[0][0] is True


def test_retrieval(spark):
    unit = lambda *v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    chunks = spark.createDataFrame([("c1", "d1", "text", "类", "t1", unit(1.0, 0.0), {1: 1.0}), ("c2", "d2", "table", "类", "t2", unit(1.0, 1.0), {2: 3.0}), ("c3", "d3", "text", "别", "t3", unit(0.0, 1.0), {1: 2.0})], "chunk_id string, doc_id string, kind string, content_type string, text string, dense array<float>, sparse map<int,float>")
    queries = spark.createDataFrame([("q", "t1 x", unit(1.0, 0.1), {1: 1.0})], "query_id string, query string, dense array<float>, sparse map<int,float>")
    docs = spark.createDataFrame([("d1", "f1", "题1", "类", "p", "ready"), ("d2", "f2", "题2", "类", "p", "failed")], "doc_id string, file_name string, document_title string, content_type string, source_path string, status string")
    assert [r.chunk_id for r in retrieval.dense_search(queries, chunks, 2).orderBy("rank").collect()] == ["c1", "c2"]
    assert [r.chunk_id for r in retrieval.dense_search(queries, chunks, 2, block=1).orderBy("rank").collect()] == ["c1", "c2"]
    assert [(r.chunk_id, r.score) for r in retrieval.sparse_search(queries, chunks).orderBy("rank").collect()] == [("c3", 2.0), ("c1", 1.0)]
    found = retrieval.search(queries, chunks, docs).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in found] == [("c1", round(1 / 61 + 1 / 62, 5)), ("c2", round(1 / 62, 5))]
    single = retrieval.fused(retrieval.dense_search(queries, chunks)).orderBy("rank").first()
    assert round(single.score, 5) == 0.01639
    only = retrieval.scalar_filter(kinds=["table"], content_types=[], doc_ids=None)
    assert [r.chunk_id for r in retrieval.search(queries, chunks, docs, where=only).collect()] == ["c2"]
    hits = retrieval.fused(retrieval.dense_search(queries, chunks), k=3).join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    assert [r.chunk_id for r in retrieval.reranked(hits, queries, k=2).orderBy("rank").collect()] == ["c1", "c2"]
    assert [r.chunk_id for r in retrieval.permuted(hits, spark.createDataFrame([("q", [2, 0])], "query_id string, order array<int>")).orderBy("rank").collect()] == ["c3", "c1"]
    entities = spark.createDataFrame([("e", "名", "fund", ["1"], [], ["d1"]), ("m", "资料", "document", ["2"], [], ["d2"])], fields.ENTITY)
    confirmed = spark.createDataFrame([("q", 0, "e"), ("q", 1, "m"), ("q", 2, "lost")], "query_id string, at int, id string")
    numbered = retrieval.evidence(hits, docs, entities, confirmed).orderBy("eid").collect()
    assert [(r.eid, r.doc_id, r.entity_name, r.entity_codes) for r in numbered] == [(1, "d1", "名", ["1"]), (2, "d2", "", [])]
    assert sorted(r.doc_id for r in retrieval.documents_of(confirmed, entities).collect()) == ["d1", "d2"]
    vectors = spark.createDataFrame([("a b a",), ("",)], "t string").select(retrieval.sparse_vector(F.col("t")).alias("s"), retrieval.dense_vector("t").alias("d")).collect()
    assert sorted(vectors[0].s.values()) == [1.0, 2.0] and list(vectors[1].s) == [0] and sum(x * x for x in vectors[0].d) == pytest.approx(1, abs=1e-5)


def test_sessions(spark):
    at = lambda k: datetime(2026, 1, 1, 0, 0, k)
    messages = spark.createDataFrame([("s", "user" if k % 2 == 0 else "assistant", f"m{k}" + "x" * 300, at(k)) for k in range(10)], "session_id string, role string, text string, created_at timestamp")
    last = sessions.last_turns(messages).orderBy("at").collect()
    assert [r.text[:2] for r in last] == ["m4", "m5", "m6", "m7", "m8", "m9"]
    history = sessions.history_text(sessions.last_turns(messages)).first().history.split("\n")
    assert history[0].startswith("用户：m4x") and len(history[1]) == 3 + 200
    assert sessions.titles(messages).first().title == ("m0" + "x" * 300)[:40]
    turn = spark.createDataFrame([("s", "q", "a", "answer", at(1))], "session_id string, question string, answer string, kind string, asked_at timestamp")
    assert [(r.role, r.text, r.created_at.microsecond) for r in sessions.turn_messages(turn).collect()] == [("user", "q", 0), ("assistant", "a", 1000)]
    state = lambda kind, ids: spark.range(1).select(sessions.next_state(F.array(F.lit("f")), F.lit(kind), ids, F.array(F.lit("c")), F.lit("plan")).alias("s")).first().s
    assert state("clarify", F.array(F.lit("e"))).focus == ["f"] and state("clarify", F.array(F.lit("e"))).pending.options == ["c"]
    assert state("answer", F.array(F.lit("e"))).focus == ["e"] and state("answer", F.lit(None).cast("array<string>")).focus == ["f"] and state("answer", F.array(F.lit("e"))).pending is None
    events = spark.createDataFrame([("t", 0, at(0)), ("t", 1, at(2)), ("t", 2, at(5))], "task_id string, seq int, at timestamp")
    assert [r.seconds for r in sessions.node_seconds(events).orderBy("seq").collect()] == [2.0, 3.0]
    assert sessions.without_sessions(messages, spark.createDataFrame([("s",)], "session_id string")).count() == 0
    assert spark.range(1).select(sessions.friendly_error(F.lit("x"), [(("x",), "slow")], "failed")).first()[0] == "slow"


def test_registry(spark):
    files = spark.createDataFrame([("a.md", "1" * 64, 1), ("a.md", "2" * 64, 2), ("b.md", "3" * 64, 3)], "file_name string, file_hash string, seen_at int")
    known = spark.createDataFrame([("1" * 16, "a.md", "ready", None), ("3" * 16, "b.md", "failed", "e")], "doc_id string, file_name string, status string, error string")
    decided = registry.decisions(files, known)
    assert {r.doc_id[0]: r.action for r in decided.collect()} == {"1": "skip", "2": "new", "3": "redo"}
    assert {r.action for r in registry.decisions(files, known, force=True).collect()} == {"redo", "new"}
    assert {r.file_name: r.file_hash[0] for r in registry.latest(decided).collect()} == {"a.md": "2", "b.md": "3"}
    assert [r.doc_id[0] for r in registry.without_replaced(known, decided).collect()] == ["3"]
    changed = registry.updated(known, spark.createDataFrame([("3" * 16, "ready"), ("4" * 16, "running")], "doc_id string, status string"))
    assert {r.doc_id[0]: r.status for r in changed.collect()} == {"1": "ready", "3": "ready", "4": "running"}
    report = registry.report(decided, spark.createDataFrame([("a.md", "ready", None), ("b.md", "failed", "bad")], "file_name string, status string, error string")).first()
    assert (report.scanned, report.new, report.redo, report.skip, report.ready, report.failed) == (3, ["a.md"], ["b.md"], ["a.md"], ["a.md"], {"b.md": "bad"})
    pages = registry.page_counts(spark.createDataFrame([("1" * 16, 4)], "doc_id string, page_idx int"), known)
    assert {r.doc_id[0]: r.page_count for r in pages.collect()} == {"1": 5, "3": 1}
    names = spark.createDataFrame([("x/a.PDF",), ("a.exe",), ("",)], "n string").select(registry.upload_check(F.col("n"), rules.EXTENSIONS).alias("c")).collect()
    assert [r.c.ok for r in names] == [True, False, False]
    asked = spark.createDataFrame([("问",), (" 　",), ("x" * 501,)], "q string").select(registry.question_check(F.col("q"), 500)["ok"]).collect()
    assert [r[0] for r in asked] == [True, False, False]


def test_violations_of_long_sentences(spark):
    """The column form against the Python form on random sentences, overlapping phrases and one of many matches."""
    import random

    rng = random.Random(4)
    guard = answers.Guard(banned=("aa", "aba", "b"), negations=("x", "xyz", "yyyyy"), warnings=("zzzzzz",), advice="a(?:b|c)a", window=4)
    texts = ["".join(rng.choices("aabbcxyz\n", k=rng.randrange(0, 60))) for _ in range(300)] + ["xaaaaa", "aaa", "yyyyyaa", "b" * 3000 + "x" + "aab" * 1000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", answers.violations(F.col("t"), guard=guard).alias("v")).collect()
    assert {r.i: r.v for r in rows} == {i: guard.violations(t) for i, t in enumerate(texts)}


def test_mentions_by_substrings_are_those_by_comparison(spark):
    """The equi joins of codes and labels against every pair compared."""
    import random

    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("ABC", k=n))
    known = [(f"e{k}", word(rng.randrange(2, 7)), "fund", [word(rng.randrange(2, 5))], [word(rng.randrange(1, 5))], []) for k in range(25)]
    asked = sorted({word(rng.randrange(1, 9)) for _ in range(60)})
    frame = spark.createDataFrame(known, fields.ENTITY)
    rows = spark.createDataFrame([(m, m) for m in asked], "mention string, text string")
    codes = {(r.mention, r.id) for r in ent.by_code(rows, frame).collect()}
    assert codes == {(m, e[0]) for m in asked for e in known if any(c in m for c in e[3])}
    best = {}
    for m in asked:
        for e in known:
            for label in (e[1], *e[4]):
                n = len(label) if label in m else len(m) if len(m) >= 2 and m in label else 0
                if n:
                    best.setdefault(m, []).append((n, e[0]))
    want = {(m, i) for m, some in best.items() for n, i in some if n == max(some)[0]}
    assert {(r.mention, r.id) for r in ent.by_label(rows, ent.labels(frame)).collect()} == want


@pytest.mark.parametrize("name", ["entity_evidence", "permuted_hits"])
def test_hits_of_a_nation_are_ranked_before_they_meet_its_customers(spark, name):
    """No window or shuffle holds a row a customer and supplier: their number grows with the square of the tables."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    for n, line in enumerate(plan):
        if line.lstrip(" :+-").startswith("Window "):
            below = next((m for m in range(n + 1, len(plan)) if depth[m] <= depth[n]), len(plan))
            assert not any("c_custkey" in x for x in plan[n:below])
    if name == "entity_evidence":
        assert not any(w in line for line in plan for w in ("Window", "Aggregate", "Sort"))


def test_entity_evidence_of_a_large_nation_is_made_by_many_tasks(spark, tmp_path, monkeypatch):
    """Customers of one small file, nearly all of one nation: the same rows as the SQL's, and no task with many of them."""
    monkeypatch.setattr(catalogue, "_EVIDENCE_PART", 3, raising=False)
    monkeypatch.setattr(catalogue, "_EVIDENCE_ASKED", 5, raising=False)
    nation = lambda n: None if n % 17 == 0 else 7 if n % 5 else n % 3
    spark.createDataFrame([(n, nation(n)) for n in range(60)], "c_custkey bigint, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n, f"Supplier#{n:09}", nation(n) or 9) for n in range(40)], "s_suppkey bigint, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = catalogue.QUERIES["entity_evidence"](spark, str(tmp_path))
    want = con.sql(catalogue.ORACLES["entity_evidence"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == len(want) and max(sizes) <= len(want) / 10


def test_resolve_status_equals_its_sql_for_long_numbers(spark, tmp_path):
    """Codes with many digits hold runs of suppliers' names, which no step but the fuzzy one compares."""
    spark.createDataFrame([(n, 1) for n in (4, 5, 6, 7, 10000, 10008, 10001, 12000)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n, f"Supplier#{n:09}", 1) for n in (1, 2, 4, 10, 120)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, catalogue.QUERIES["resolve_status"](spark, str(tmp_path)).collect())) == sorted(con.sql(catalogue.ORACLES["resolve_status"]).fetchall())


def test_candidates_of_a_shared_name_are_not_listed_for_every_customer(spark, tmp_path):
    """A quarter of the customers means all suppliers: they get a count, and the list is never theirs, also of keys that are null or repeated."""
    spark.createDataFrame([(n, 1) for n in (*range(120), 6, None, None)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n, f"Supplier#{n:09}", 1) for n in range(90)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = catalogue.QUERIES["resolve_status"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(con.sql(catalogue.ORACLES["resolve_status"]).fetchall(), key=str)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_requests_of_one_list_of_mentions_get_the_same(spark):
    """Lists with nulls, without anything, and in parts of one request; known ids come in the order of their mentions."""
    known = spark.createDataFrame(BASE, fields.ENTITY)
    asked = [(1, ["华夏债券C", "华夏的那只基金"]), (2, ["华夏的那只基金"]), (3, None), (4, []), (5, [None, "宁德时代", None]), (6, ["华夏的那只基金"]), (7, ["茅台", "001003"]), (8, ["001003", "茅台"]), (9, ["宁德时代"]), (9, ["茅台"]), (10, [None])]
    found = {r.request_id: tuple(r)[1:] for r in ent.resolve(spark.createDataFrame(asked, "request_id int, mentions array<string>"), known).collect()}
    alone, both, nothing = ("ambiguous", [], ["bond", "fcf"], []), ["maotai", "bond"], ("none", [], [], [])
    assert found == {1: ("confirmed", ["bond"], [], []), 2: alone, 3: nothing, 4: nothing, 5: ("unknown", [], [], ["宁德时代"]), 6: alone, 7: ("confirmed", both, [], []), 8: ("confirmed", both[::-1], [], []), 9: ("confirmed", ["maotai"], [], ["宁德时代"]), 10: nothing}
