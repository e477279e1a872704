"""Archives of an outer parser, and lines numbered over splits."""

import json
import zipfile

from quillspark.sources import archives, files


def packed(path, entries):
    with zipfile.ZipFile(path, "w") as out:
        for name, text in entries.items():
            out.writestr(name, text)


def blocks(text):
    return json.dumps([{"type": "text", "text": text, "page_idx": 0}, {"type": "text", "text": "more", "page_idx": 1}])


def test_archives(spark, tmp_path):
    folder = tmp_path / "zips"
    (folder / "sub").mkdir(parents=True)
    packed(folder / "a.zip", {"x/a_content_list.json": blocks("first"), "x/b_content_list.json": blocks("second"), "x/a_content_list_v2.json": "{}", "x/a.md": "text"})
    packed(folder / "sub" / "b.ZIP", {"b_content_list_v2.json": blocks("only the second format"), "img/1.png": "x"})
    packed(folder / "c.zip", {"c_content_list.json": "[not JSON"})
    (folder / "broken.zip").write_bytes(b"PK no archive")
    rows = {r.name: r for r in archives.archives(spark, str(folder)).collect()}
    assert set(rows) == {"a", "b", "c", "broken"} and rows["a"].entry == "x/a_content_list.json"
    assert rows["b"].error == "no content_list.json" and rows["broken"].error and rows["broken"].content is None
    assert archives.archives(spark, str(folder)).rdd.getNumPartitions() == 4

    docs = spark.createDataFrame([("1", "a.pdf"), ("2", "b.pdf"), ("3", "c.docx"), ("4", "missing.pdf")], "doc_id string, file_name string")
    kept = str(tmp_path / "kept")
    run = lambda again=False: {(r.doc_id, r.pos): (r.type, r.text) for r in archives.archived_blocks(docs, str(folder), kept, again).collect()}
    first = run()
    assert first["1", 0] == ("text", "first") and first["1", 1] == ("text", "more") and first["4", 0] == ("error", "no archive")
    assert first["2", 0] == ("error", "no content_list.json") and first["3", 0][0] == "error" and len(first) == 5
    packed(folder / "a.zip", {"a_content_list.json": blocks("changed")})
    packed(folder / "c.zip", {"c_content_list.json": blocks("mended")})
    second = run()
    assert second["1", 0] == ("text", "first") and second["3", 0] == ("text", "mended")  # kept, and tried again
    assert run(again=True)["1", 0] == ("text", "changed") and run()["1", 0] == ("text", "changed")
    empty = tmp_path / "none"
    empty.mkdir()
    assert archives.archives(spark, str(empty)).count() == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"{k} " + "x" * (k % 90) for k in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\n\nthree")
    (tmp_path / "c.txt").write_text("")
    before = [spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    found = files.numbered_lines(spark, str(tmp_path)).collect()
    for c, v in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before, strict=True):
        spark.conf.set(c, v)
    of = lambda name: [r.value for r in sorted(found, key=lambda r: r.line) if r.path.endswith(name)]
    assert of("a.txt") == lines and of("b.txt") == ["one", "", "three"] and of("c.txt") == []
    assert sorted(r.line for r in found if r.path.endswith("a.txt")) == list(range(1, 5001))
