"""File sources, sinks, streams; the registered queries against their oracles."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fields, rules
from quillspark.functions import text as tx
from quillspark.operators import answers
from quillspark.plans import catalogue, registry, stored  # noqa: F401  stored adds its queries
from quillspark.sources import files, sinks
from quillspark.sources.snapshots import Store
from quillspark.streaming import guard as live
from quillspark.streaming import ingest

TEXT = "# 题目 #\n\n第一段\n继续\n\n| a | b |\n|---|:---:|\n| 1 | 2 |\n| 3 | 4 |\n\n## 一、节\n尾"


def test_scan(spark, tmp_path):
    for name in ("b.pdf", "a.MD", "note.txt", "~$tmp.docx", ".hidden.pdf", "子目录/c.docx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = files.scan(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.folder, r.file_name, r.file_ext) for r in rows] == [("", "a.MD", ".md"), ("", "b.pdf", ".pdf"), ("子目录", "c.docx", ".docx")]
    assert [r.file_name for r in files.scan(spark, str(tmp_path), only="b.").collect()] == ["b.pdf"]


def test_markdown(spark):
    found = list(files.markdown_blocks(TEXT))
    assert [b["type"] for b in found] == ["text", "text", "table", "text", "text"] and (found[0]["text"], found[0]["text_level"]) == ("题目", 1)
    assert found[1]["text"] == "第一段\n继续" and found[2]["table_body"] == "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    df = spark.createDataFrame([("d", bytearray(TEXT.encode()))], "doc_id string, content binary")
    rows = files.markdown(df).orderBy("pos").collect()
    assert [r.pos for r in rows] == [0, 1, 2, 3, 4] and rows[3].text_level == 2 and rows[1].text_level is None
    listed = spark.createDataFrame([("d", bytearray(json.dumps([{"type": "list", "list_items": ["x"], "page_idx": 2}]).encode()))], "doc_id string, content binary")
    assert files.content_list(listed).first().list_items == ["x"]
    assert files.unparsed(df, files.markdown(df)).count() == 0 and files.unparsed(df, files.markdown(df), again=True).count() == 1


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 300, 1) + b"\0" * 5
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 7, 9) + b"\0" * 8
    df = spark.createDataFrame([(0, bytearray(png)), (1, bytearray(jpeg)), (2, bytearray(b"no")), (3, None)], "k int, c binary")
    assert [tuple(r.s or (None, None)) for r in df.select("k", files.image_size("c").alias("s")).orderBy("k").collect()] == [(300, 1), (9, 7), (None, None), (None, None)]


def test_eval_items(spark, tmp_path):
    good = {"id": "a", "category": "risk", "turns": [{"q": "问", "gold": [{"file": "f", "quote": "q"}]}], "expect": "answer"}
    lines = [json.dumps(good), "", "{bad", json.dumps(good | {"category": "x"}), json.dumps(good | {"turns": [{"q": 1}]}), json.dumps({k: v for k, v in good.items() if k != "turns"}), "[]"]
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    rows = {r.line: r for r in files.eval_items(spark, str(tmp_path / "e.jsonl")).collect()}
    assert set(rows) == {1, 3, 4, 5, 6, 7} and rows[1].error is None and rows[1].turns[0].gold[0].quote == "q" and all(rows[k].error for k in (3, 4, 5, 6, 7))


def test_import_folder(spark, tmp_path):
    root, index = tmp_path / "in", str(tmp_path / "index")
    root.mkdir()
    (root / "2026-01-02 一.md").write_text(TEXT)
    (root / "二.md").write_text("只有一段")
    known = spark.createDataFrame([], "doc_id string, file_name string, content_type string, document_title string, status string, chunk_count int")
    first = spark.createDataFrame(ingest.import_folder(spark, str(root), index, known).collect(), known.schema)
    assert {(r.document_title, r.status) for r in first.collect()} == {("一", "ready"), ("二", "ready")} and all(r.chunk_count > 0 for r in first.collect())
    before = ingest.chunks_of(spark, index).count()
    (root / "二.md").write_text("换了一段")
    second = ingest.import_folder(spark, str(root), index, first).collect()
    assert len(second) == 2 and {r.status for r in second} == {"ready"}
    rows = ingest.chunks_of(spark, index)
    assert rows.where(F.col("text").contains("换了")).count() == 1 and rows.count() == before
    assert rows.select("chunk_id").distinct().count() == rows.count() and rows.where(F.size("dense") == 256).count() == rows.count()


def test_import_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text(TEXT)
    store = str(tmp_path / "store")
    run = lambda: ingest.import_stream(spark, str(root), store, str(tmp_path / "cp")).awaitTermination(120)
    run()
    n = ingest.chunks_of(spark, store).select("doc_id").distinct().count()
    (root / "b.md").write_text("另一个文件")
    (root / "c.md").write_text(TEXT)
    run()
    known = ingest.known_documents(spark, store)
    assert n == 1 and {(r.file_name, r.status) for r in known.collect()} == {("a.md", "ready"), ("b.md", "ready")}
    (root / "a-2").mkdir()
    (root / "a-2" / "b.md").write_text("另一个文件的新版本")
    run()
    rows = ingest.chunks_of(spark, store)
    assert rows.select("doc_id").distinct().count() == 2 and rows.where(F.col("text").contains("新版本")).count() == 1


def test_import_makes_entities_and_summaries(spark, tmp_path):
    """Models' answers reach the registry and the index; a file that cannot be parsed fails alone."""
    root = tmp_path / "in"
    root.mkdir()
    (root / "甲.md").write_text("# 晨星稳健基金\n\n晨星稳健基金（代码 123456）由某公司管理。\n")
    (root / "乙.md").write_text("没有对象的正文\n")
    (root / "坏.md").write_text("BROKEN")

    def lines(content):
        if content.startswith(b"BROKEN"):
            raise ValueError("no such format")
        return ({"page_idx": 0} | b for b in files.markdown_blocks(content.decode()))

    said = '{"type": "fund", "name": "晨星稳健基金", "codes": ["123456", "999999"], "aliases": ["稳健"]}'
    models = ingest.Models(
        parse=lambda df: files.parsed(df, lines),
        summarise=lambda text, title, kind: F.concat(F.lit("讲的是"), title),
        recognise=lambda text, title, kind: F.when(text.contains("晨星"), said).otherwise("no JSON"),
    )
    known = spark.createDataFrame([], fields.REGISTRY)
    now = ingest.import_folder(spark, str(root), str(tmp_path / "index"), known, models=models)
    found = {r.file_name: r for r in now.collect()}
    assert {k: r.status for k, r in found.items()} == {"甲.md": "ready", "乙.md": "ready", "坏.md": "failed"}
    assert found["坏.md"].error == "ValueError: no such format" and found["坏.md"].chunk_count == 0
    assert (found["甲.md"].entity.type, found["甲.md"].entity.codes) == ("fund", ["123456"])
    assert (found["乙.md"].entity.type, found["乙.md"].entity.codes) == ("document", [])
    index = ingest.chunks_of(spark, str(tmp_path / "index"))
    assert {r.text for r in index.where("kind = 'summary'").collect()} == {rules.SUMMARY_PREFIX + "讲的是甲", rules.SUMMARY_PREFIX + "讲的是乙"}
    merged = ingest.entities(now).collect()
    assert {r.id for r in merged} == {"123456", "乙"}
    # The failed file is tried again, the others are skipped.
    docs = ingest.documents(files.scan(spark, str(root)), now)
    assert {r.file_name: r.action for r in docs.collect()} == {"甲.md": "skip", "乙.md": "skip", "坏.md": "redo"}


def test_index_partitions(spark, tmp_path):
    """Many documents share a partition; replacing and dropping some leaves the others."""
    path, schema = str(tmp_path / "i"), "doc_id string, chunk_id string, text string"
    make = lambda docs, text: spark.createDataFrame([(d, f"{d}-{k}", text) for d in docs for k in range(2)], schema)
    assert sinks.write_index(make([f"d{k}" for k in range(60)], "old"), path) == 120
    gone = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    assert sinks.write_index(make(["d0"], "new"), path, gone) == 2
    rows = Store(spark, path).read("index")
    assert rows.count() == 116 and rows.where("text = 'new'").count() == 2 and rows.where("doc_id in ('d1', 'd2')").count() == 0
    assert sinks.write_index(make([], "none"), path, rows.select("doc_id").distinct()) == 0
    assert sinks.write_index(make(["d5"], "again"), path) == 2 and Store(spark, path).read("index", schema).count() == 2


def test_index_rows(spark):
    docs = spark.createDataFrame([("d", "类")], "doc_id string, content_type string")
    chunks = spark.createDataFrame([("d", 0, "text", "字" * 30000, "路", 1, 1, False)], "doc_id string, seq int, kind string, text string, section_path string, page_start int, page_end int, derived boolean")
    vectors = spark.createDataFrame([("d", 0, [1.0], {})], "doc_id string, seq int, dense array<float>, sparse map<int,float>")
    row = sinks.index_rows(docs, chunks, vectors).first()
    assert row.chunk_id == "d-0000" and len(row.text.encode()) <= rules.TEXT_BYTES and list(row.sparse) == [0]
    with pytest.raises(Exception, match="no vector"):
        sinks.index_rows(docs, chunks, vectors.where("false")).collect()


def test_write_eval(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    sinks.write_eval(df, df, {"rev": "x"}, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/meta")).first().rev == "x"


DELTAS = ["茅台增长6%。这只", "股票稳赚", "不赔！历史业绩", "不代表未来", "<<<ME", 'TA>>>{"kind": "answer"}', "后文"]


def delta_rows(spark):
    rows = [(s, k, "问", d, k == len(DELTAS) - 1) for s in ("s1", "s2") for k, d in enumerate(DELTAS)]
    return spark.createDataFrame(rows, "session_id string, seq bigint, question string, delta string, last boolean")


def test_guarded_batch(spark):
    rows = live.guarded_batch(delta_rows(spark)).orderBy("session_id", "seq").collect()
    for s in ("s1", "s2"):
        shown = "".join(r.shown for r in rows if r.session_id == s)
        assert shown == "茅台增长6%。" + rules.GUARD_REPLACEMENT + "历史业绩不代表未来"
        assert [h for r in rows if r.session_id == s for h in r.hits] == ["稳赚不赔", "稳赚"]
    assert all("<" not in r.shown for r in rows)
    state, whole = live.begun("问", answers.Guard()), ""
    for char in "".join(DELTAS):
        state, out, _ = live.step(state, char, False, answers.Guard())
        whole += out
        assert len(state[0]) + len(state[2]) < 40
    assert whole == "".join(r.shown for r in rows if r.session_id == "s1")


def streamed(spark, tmp_path, rows, function):
    source = tmp_path / "deltas"
    ordered = rows.orderBy("seq")
    for k in range(3):
        ordered.where(F.floor(F.col("seq") / 3) == k).coalesce(1).write.mode("append").parquet(str(source))
        query = function(spark.readStream.schema(rows.schema).parquet(str(source))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_guarded_stream_is_the_batch(spark, tmp_path):
    rows = delta_rows(spark)
    key = lambda df: sorted(map(str, df.select("session_id", "seq", "shown", "hits").collect()))
    assert key(streamed(spark, tmp_path, rows, live.guarded_stream)) == key(live.guarded_batch(rows))


def test_chat_deltas_are_guarded(spark):
    rows = spark.createDataFrame([("a", "问", "p"), ("b", "问", "")], "session_id string, question string, prompt string")
    deltas = live.chat_deltas(rows, lambda prompt: DELTAS if prompt else [])
    assert sorted(map(tuple, deltas.where("session_id = 'a'").collect())) == [("a", k, "问", d, k == len(DELTAS) - 1) for k, d in enumerate(DELTAS)]
    shown = live.guarded_batch(deltas).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("shown")), "").alias("t")).collect()
    assert {r.session_id: rules.GUARD_REPLACEMENT in r.t for r in shown} == {"a": True, "b": False}


def test_templates(spark, tmp_path):
    (tmp_path / "plan.txt").write_text("Ask {question} of {focus}.\nDone")
    found = files.templates(spark, str(tmp_path))
    assert found == {"plan": "Ask {question} of {focus}.\nDone"}
    row = spark.range(1).select(tx.filled(found["plan"], question=F.lit("why"), focus=F.lit(None).cast("string")).alias("t")).first()
    assert row.t == "Ask why of .\nDone"


def test_session_states(spark, tmp_path):
    turns = [("s", 0, "answer", ["e1"], [], "q0"), ("s", 3, "clarify", [], ["a", "b"], "q1"), ("s", 6, "answer", [], [], "q2")]
    rows = spark.createDataFrame(turns, "session_id string, seq bigint, kind string, entity_ids array<string>, candidate_ids array<string>, standalone_query string")
    found = streamed(spark, tmp_path, rows, live.session_states).orderBy("seq").collect()
    assert [(r.focus, r.options, r.pending_query) for r in found] == [(["e1"], [], None), (["e1"], ["a", "b"], "q1"), (["e1"], [], None)]


def test_events(spark):
    rows = spark.createDataFrame([("s", k, t, "{}") for k, t in enumerate(("delta", "values", "sources", "final"))], "session_id string, seq int, type string, payload string")
    assert [r.event for r in live.shown_events(rows).orderBy("seq").collect()] == ["delta", "sources", "final"]


def test_queries_match_their_oracles(spark):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{folder}/{name}')")
    plain = lambda rows: sorted(str(tuple(rows_ if not hasattr(rows_, "asDict") else rows_)) for rows_ in rows)
    for name, run in catalogue.QUERIES.items():
        df = run(spark, folder)
        rows = df.select(*sorted(df.columns)).collect()
        if name in catalogue.ORACLES:
            found = con.execute(catalogue.ORACLES[name])
            columns = [c[0] for c in found.description]
            order = sorted(range(len(columns)), key=columns.__getitem__)
            assert sorted(df.columns) == sorted(columns), name
            assert plain(rows) == plain([tuple(r[k] for k in order) for r in found.fetchall()]), name
        else:
            assert rows, name


def test_the_rest_stands_alone():
    """Nothing outside the subpackage of training-data operators imports it."""
    from pathlib import Path

    root = Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quillspark.llm" not in path.read_text(), path
