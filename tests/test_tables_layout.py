"""HTML tables, layout blocks, chunks and facts on small documents with known results."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fields, rules
from quillspark.functions import text as tx
from quillspark.functions.tables import Table, merged, parse
from quillspark.operators import layout as lay


def grid(*rows, tag="td"):
    return "<table>" + "".join("<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in r) + "</tr>" for r in rows) + "</table>"


REPORT = grid(("项目", "本报告期", "上年同期", "增减变动幅度(%)"), ("营业收入", "53,909,252,220.51", "50,600,957,885.78", "6.54"), ("基本每股收益", "0.00", "0.00", "不适用"))


def test_simple_header():
    t = Table(REPORT)
    assert (t.header_rows, t.n_cols, t.kv) == (1, 4, False)
    assert t.lines() == ["项目=营业收入；本报告期=53,909,252,220.51；上年同期=50,600,957,885.78；增减变动幅度(%)=6.54", "项目=基本每股收益；本报告期=0.00；上年同期=0.00；增减变动幅度(%)=不适用"]


def test_spans():
    t = Table('<table><tr><td rowspan="2">项目</td><td colspan="2">2026年3月31日</td></tr><tr><td>金额</td><td>占比</td></tr><tr><td rowspan="2">贷款</td><td>100</td><td>50%</td></tr><tr><td>200</td><td>30%</td></tr></table>')
    assert t.header_rows == 2 and t.columns == ["项目", "2026年3月31日·金额", "2026年3月31日·占比"]
    assert t.grid == [["项目", "2026年3月31日", "2026年3月31日"], ["项目", "金额", "占比"], ["贷款", "100", "50%"], ["贷款", "200", "30%"]]
    assert t.lines()[1] == "项目=贷款；2026年3月31日·金额=200；2026年3月31日·占比=30%"
    t = Table('<table><tr><td>项目</td><td>本期</td><td>上期</td></tr><tr><td>合计</td><td colspan="2">不适用</td></tr><tr><td colspan="3">非经常性损益项目</td></tr></table>')
    assert t.lines() == ["项目=合计；本期=不适用", "非经常性损益项目"]
    assert Table('<table><tr><td>a</td><td>b</td><td rowspan="2">c</td></tr><tr><td>d</td><td>e</td></tr></table>').grid[1] == ["d", "e", "c"]


def test_cells_and_headers():
    t = Table("<table><tr><td>托管费<br>（年费率）</td><td>0.10&#37;</td></tr></table>")
    assert t.grid == [["托管费 （年费率）", "0.10%"]]
    assert Table(grid(("a", "b"), ("c", "d"), tag="th").replace("</table>", "<tr><td>1</td><td>2</td></tr></table>")).header_rows == 2
    t = Table(grid(("基金代码", "001001")))
    assert (t.header_rows, t.lines()) == (0, ["基金代码=001001"])
    assert not Table(grid(("本期", "(1,234)"), ("上期", "x"))).header_rows
    nested = Table("<table><tr><td>a<table><tr><td>b</td><td>c</td></tr></table></td><td>d</td></tr></table>")
    assert nested.grid == [["a b c", "d"]]
    assert Table("").grid == [] and Table("").markdown() == "" and Table(None).lines() == []


def test_pairs():
    t = Table(
        "<table><tr><td>基金简称</td><td>华夏债券</td><td>基金代码</td><td>001001</td></tr><tr><td>下属基金简称</td><td>华夏债券C</td><td>下属基金代码</td><td>001003</td></tr>"
        '<tr><td>其他</td><td colspan="3">存续期间内基金份额持有人数量连续60个工作日达不到100人</td></tr></table>'
    )
    assert t.kv and t.lines() == ["基金简称=华夏债券；基金代码=001001", "下属基金简称=华夏债券C；下属基金代码=001003", "其他=存续期间内基金份额持有人数量连续60个工作日达不到100人"]
    assert list(t.facts())[0] == ("基金简称", "", "华夏债券")
    t = Table(grid(("报告期末普通股股东总数", "243,159", "表决权恢复的优先股股东总数", "0"), ("股东名称", "持股数量", "持股比例(%)", "股份性质"), ("茅台集团", "678,291,955", "54.07", "无限售")))
    assert not t.header_rows and not t.kv


def test_second_header_and_unit():
    t = Table(grid(("项目", "本报告期", "上年同期"), ("营业收入", "53", "50"), ("", "本报告期末", "上年度末"), ("总资产", "319", "303")))
    assert t.lines() == ["项目=营业收入；本报告期=53；上年同期=50", "项目=总资产；本报告期末=319；上年度末=303"]
    assert list(t.facts()) == [("营业收入", "本报告期", "53"), ("营业收入", "上年同期", "50"), ("总资产", "本报告期末", "319"), ("总资产", "上年度末", "303")]
    t = Table(grid(("(人民币百万元,特别注明除外)", "2026年1-3月"), ("营业收入", "86,940")))
    assert t.unit == "(人民币百万元,特别注明除外)" and t.lines() == ["项目=营业收入；2026年1-3月=86,940"]


def test_parts_and_merge():
    t = Table(grid(("序号", "名称"), *((str(k), f"公司{k}") for k in range(1, 41))))
    parts = t.parts(120)
    assert [y for p in parts for y in p] == list(range(1, 41)) and all(sum(len(x) + 1 for x in t.lines(p)) <= 120 for p in parts)
    first = grid(("项目", "金额"), ("收入", "1"))
    for more in (grid(("利润", "2")), grid(("项目", "金额"), ("利润", "2"))):
        assert Table(merged(first, more)).grid == [["项目", "金额"], ["收入", "1"], ["利润", "2"]]
    assert "a\\|b" in Table(grid(("x", "y"), ("a|b", "c"))).markdown()


def test_parse_column(spark):
    row = spark.createDataFrame([(REPORT,), (None,)], "html string").select(parse("html").alias("t")).select("t.*").collect()
    assert row[0].header_rows == 1 and row[0].columns[0] == "项目" and row[1].grid == []


def test_levels():
    want = {
        "第一部分 货币信贷概况": 2, "第一节 主要财务数据": 3, "一、主要财务数据": 3, "三 工业和建筑业": 3, "(一)主要会计数据": 4, "（二） 基金运作": 4,
        "1.1 主要会计数据": 4, "1.5.1 总体业绩": 5, "1、认购": 5, "1. 人工智能行业": 5, "（1）贷款业务": 6, "① 市场风险": 7, "重要内容提示": None,
    }
    assert {t: lay.style_level(t) for t in want} == want


def test_outline():
    o = lay.Outline()
    for title, level in [("2026年第一季度报告", 1), ("第一节 主要财务数据", 2), ("1.5 管理层讨论", 2), ("1.5.2 零售业务", 2), ("（2）大财富管理业务", 2), ("存款业务", 2)]:
        o.enter(title, level)
    assert o.path == ["第一节 主要财务数据", "1.5 管理层讨论", "1.5.2 零售业务", "（2）大财富管理业务", "存款业务"]
    o.enter("私行财富", 2)
    assert o.path[-2:] == ["（2）大财富管理业务", "私行财富"]
    o.enter("1.5.3 对公业务", 2)
    assert o.path == ["第一节 主要财务数据", "1.5 管理层讨论", "1.5.3 对公业务"]
    o.enter("附：产品说明书", 1)
    assert o.path == ["附：产品说明书"]


def blocks_of(spark, *raw):
    shape = spark.createDataFrame([], fields.RAW_BLOCK).schema
    rows = [{f.name: None for f in shape} | {"doc_id": "d", "pos": k, "type": "text", "page_idx": 0} | r for k, r in enumerate(raw)]
    return [r.asDict() for r in lay.layout(spark.createDataFrame([tuple(r[f.name] for f in shape) for r in rows], shape)).orderBy("seq").collect()]


def test_paragraphs_over_pages(spark):
    found = blocks_of(
        spark, {"text": "但不保证", "page_idx": 3}, {"type": "page_number", "text": "4", "page_idx": 3}, {"type": "header", "text": "页眉", "page_idx": 4},
        {"text": "基金一定盈利。", "page_idx": 4}, {"text": "过往业绩不代表未来表现。", "page_idx": 4},
    )
    assert [b["text"] for b in found] == ["但不保证基金一定盈利。", "过往业绩不代表未来表现。"] and (found[0]["page"], found[0]["page_end"]) == (4, 5)
    found = blocks_of(spark, {"text": "零售客户数达到", "page_idx": 6}, {"type": "page_footnote", "text": "<sup>1</sup> 含借记卡。", "page_idx": 6}, {"text": "1.3亿户。", "page_idx": 7})
    assert [b["text"] for b in found] == ["零售客户数达到1.3亿户。", "注：1 含借记卡。"]


def test_units_and_continuations(spark):
    body = grid(("项目", "金额"), ("营业收入", "1"))
    found = blocks_of(
        spark, {"text": "1.1 主要会计数据", "text_level": 2}, {"text": "（货币单位：人民币百万元）"}, {"type": "table", "table_body": body},
        {"type": "table", "page_idx": 1}, {"type": "table", "table_body": body, "table_caption": ["表"]}, {"text": "1.2 其他", "text_level": 2}, {"type": "table", "table_body": body},
    )
    assert found[1]["absorbed"] and [b["context"] for b in found if b["type"] == "table"] == ["（货币单位：人民币百万元）"] * 2 + [""]
    assert found[2]["page_end"] == 2 and found[2]["section_path"] == ["1.1 主要会计数据"]
    found = blocks_of(spark, {"type": "table", "table_body": body}, {"type": "footer", "text": "x"}, {"type": "table", "table_body": grid(("净利润", "2")), "page_idx": 1})
    assert len(found) == 1 and "净利润" in found[0]["table_html"] and found[0]["page_end"] == 2
    found = blocks_of(spark, {"text": "不代表其未来表现，", "text_level": 2}, {"text": "√适用 □不适用", "text_level": 2}, {"type": "list", "list_items": ["**a**", "", "b"]}, {"type": "image", "img_path": "p.png", "image_caption": ["图1"]})
    assert [b["type"] for b in found] == ["text", "text", "text", "image"] and found[2]["text"] == "a\nb" and found[3]["derived"]


def block(kind="text", text="", **given):
    return {"seq": 0, "type": kind, "text": text, "level": None, "page": 1, "page_end": None, "section_path": ["s"], "table_html": None, "caption": "", "footnote": "", "context": "", "img_path": None, "derived": False, "absorbed": False} | given


def test_pieces():
    text = "".join(f"第{k}句话" + "很长" * 20 + "。" for k in range(60))
    found = lay.pieces(text)
    assert "".join(found) == text and all(len(p) <= rules.CHUNK_MOST for p in found) and all(len(p) >= rules.CHUNK_TARGET for p in found[:-1])
    assert [len(p) for p in lay.pieces("字" * 2400)] == [1000, 1000, 400] and lay.pieces(" \n ") == []


def test_packing():
    found = lay.packed([block(text=f"{k}" * 250, page=k + 1) for k in range(6)])
    assert all(len(c["text"]) <= rules.CHUNK_MOST for c in found) and (found[0]["page_start"], found[0]["page_end"]) == (1, 3)
    small = [block("heading", "1.1 甲", level=4), block(text="甲" * 50), block("heading", "1.2 乙", level=4), block(text="乙" * 50)]
    assert [c["text"] for c in lay.packed(small)] == ["\n".join(b["text"] for b in small)]
    html = grid(("a", "b"), ("1", "2"))
    found = lay.packed([block(text="□是"), block("table", table_html=html, page=1), block(text="后文", page=2)])
    assert [c["kind"] for c in found] == ["table", "text"] and (found[1]["page_start"], found[1]["page_end"]) == (1, 2)
    found = lay.packed([block("heading", "1 旧", level=5), block("heading", "一、新", level=3), block("table", table_html=html), block("heading", "尾", level=3)])
    assert [c["kind"] for c in found] == ["table"]
    found = lay.packed([block("heading", "1.1 题", level=4), block(text="句子。" * 500)])
    assert found[0]["text"].startswith("1.1 题\n") and all(len(c["text"]) <= rules.CHUNK_MOST + 10 for c in found)
    image = lay.packed([block("image", "上涨", caption="走势", footnote="来源")])[0]
    assert (image["text"], image["kind"], image["derived"]) == ("[图表] 走势\n上涨\n来源", "image_desc", True)


def test_table_chunks():
    html = grid(("代码", "名称"), *((f"{k}", f"名称{k}") for k in range(200)))
    found = lay.packed([block("table", table_html=html, caption="表1", footnote="注", context="单位：元")], table_most=500)
    n = len(found)
    assert n > 1 and found[0]["text"].startswith(f"表1 （续表 1/{n}）\n单位：元\n| 代码 | 名称 |") and found[-1]["text"].endswith("\n注") and "\n注" not in found[0]["text"]
    assert found[0]["embed_body"].startswith("[表1 · 单位：元]\n代码=0；名称=名称0") and found[0]["table_html"] is None
    assert len(lay.packed([block("table", table_html=grid(("a", "b"), tag="th"))])) == 1


def test_facts_and_assembly(spark):
    raw = [{"text": "主要会计数据", "text_level": 2}, {"text": "单位：元"}, {"type": "table", "table_body": REPORT}, {"text": "其他", "text_level": 2}, {"type": "table", "table_body": REPORT}]
    shape = spark.createDataFrame([], fields.RAW_BLOCK).schema
    rows = [{f.name: None for f in shape} | {"doc_id": "d", "pos": k, "type": "text", "page_idx": 0} | r for k, r in enumerate(raw)]
    blocks = lay.layout(spark.createDataFrame([tuple(r[f.name] for f in shape) for r in rows], shape))
    facts = lay.table_facts(blocks)
    assert facts.count() == 6
    texts = [r.text for r in lay.fact_chunks(facts).orderBy("ord").collect()]
    assert texts[0] == "营业收入：本报告期=53,909,252,220.51；上年同期=50,600,957,885.78；增减变动幅度(%)=6.54（单位：元）〔主要会计数据〕"
    docs = spark.createDataFrame([("d", rules.FACT_TYPE)], "doc_id string, content_type string")
    summaries = spark.createDataFrame([("d", "总之")], "doc_id string, summary string")
    every = lay.all_chunks(docs, lay.chunk(blocks), facts, summaries).orderBy("seq").collect()
    assert [c.seq for c in every] == list(range(len(every))) and [c.kind for c in every] == ["table", "table", "fact", "fact", "summary"] and every[-1].text == "（文档摘要）总之"
    parts = spark.createDataFrame([("d", k, "text", "x" * 40) for k in range(10)], "doc_id string, seq int, kind string, text string")
    assert lay.assembled(parts, 100).first().text == "\n".join(["x" * 40] * 3)[:100]
    head = spark.createDataFrame([("d", 0, "header", "代码600519", 0), ("d", 1, "header", "代码600519", 1), ("d", 2, "header", "晚", 2)], "doc_id string, pos int, type string, text string, page_idx int")
    assert lay.entity_input(head, parts, 60).first().text == ("代码600519\n" + "x" * 40 + "\n" + "x" * 40)[:60]


def test_images(spark):
    blocks = spark.createDataFrame([("d", 0, "text", "a", None), ("d", 1, "image", "", "1.png"), ("d", 2, "image", "", "2.png"), ("d", 3, "image", "", "3.png")], "doc_id string, seq int, type string, text string, img_path string")
    told = spark.createDataFrame([("d", "1.png", "图示上涨"), ("d", "2.png", rules.NO_CONTENT)], "doc_id string, img_path string, description string")
    assert [(r.seq, r.text) for r in lay.described(blocks, told).orderBy("seq").collect()] == [(0, "a"), (1, "图示上涨")]


def test_text_functions(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]

    spaced = "沪深3 0 0 指 数 上 涨 1 2 1 <sub>.</sub> 0 2 %，开 放 式 股 票 型 基 金 上 涨 1 2 1 . 4 %"
    assert one(tx.cleaned, spaced) == "沪深300指数上涨121.02%，开放式股票型基金上涨121.4%"
    assert one(tx.cleaned, "2026 年 3 月 **加粗** [链接](http://x)") == "2026 年 3 月 加粗 链接"
    assert one(tx.cleaned, None) == "" and one(tx.strip, "　 a b\n\x1c") == "a b"
    assert one(tx.normal, "营业收入 （元）\n53,909") == one(tx.normal, "营业收入(元)53,909")
    emoji = "汉字😀字"
    assert [one(lambda c, n=n: tx.fit_bytes(c, n), emoji) for n in (3, 4, 5, 6, 7, 9, 10, 11)] == ["汉", "汉", "汉", "汉字", "汉字", "汉字", "汉字😀", "汉字😀"]
    assert one(lambda c: tx.is_subsequence(c, F.lit("招商银行股份有限公司")), "招行") and not one(lambda c: tx.is_subsequence(c, F.lit("招商银行")), "行招")
    assert one(tx.first_sentence_end, "a。b！") == 1 and one(tx.first_sentence_end, "abc") == -1
    assert one(lambda c: tx.public_url(F.lit("http://h/b"), c), "a b/ü~*.pdf") == "http://h/b/a%20b/%C3%BC~%2A.pdf"
    assert one(tx.squashed, "华夏（债券） C") == "华夏(债券)C" and one(tx.title, "2026-04-25 季报 ") == "季报"
    kinds = [("上市公司年报/x", "贵州茅台.pdf", "公司定期报告"), ("", "消费者权益保护实施办法.pdf", "法规制度"), ("用户FAQ", "调查报告.md", "调查报告"), ("用户FAQ/a", "b.md", "投资者教育FAQ"), ("x", "y.md", "其他")]
    got = spark.createDataFrame(kinds, "d string, n string, want string").where(tx.content_type(F.col("d"), F.col("n")) == F.col("want"))
    assert got.count() == len(kinds)
    assert spark.range(1).select(tx.embed_text(F.lit("题"), F.lit(""), F.lit("路"), F.lit("文"))).first()[0] == "题 · 路\n文"


@pytest.mark.parametrize("value", ["53", "-1,2", "(1,234)", "6.54%", "+3"])
def test_numbers(value):
    from quillspark.functions.tables import is_number

    assert is_number(value) and not is_number(f"{value}元")
