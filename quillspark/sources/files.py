"""Sources: file trees, Markdown, parsed content lists, evaluation questions, image headers."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import fields, rules
from quillspark.functions.lazy import lazy_udf
from quillspark.session import staged

SEPARATOR = re.compile(r"\s*:?-{3,}:?\s*\Z")


def scan(spark: SparkSession, root: str, only: str | None = None, extensions: list[str] = rules.EXTENSIONS) -> DataFrame:
    """Files under root, in no order: path, folder, file_name, file_ext, file_hash, content.

    Of the types taken in, whatever their case; names that begin with a skipped prefix are passed over, and
    with only all names that do not contain it. Spark's reader hides names that begin with ``_`` as well.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    keep = ext.isin(extensions) & ~F.exists(F.array(*map(F.lit, rules.SKIPPED_PREFIXES)), lambda p: F.startswith(name, p))
    if only:
        keep &= name.contains(only)
    base = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/"))
    local = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    folder = F.regexp_replace(F.substring(local, len(base) + 2, 1 << 20), r"/?[^/]*$", "")
    return rows.where(keep).select("path", folder.alias("folder"), name.alias("file_name"), ext.alias("file_ext"), F.sha2("content", 256).alias("file_hash"), "content")


def markdown_blocks(text: str) -> Iterator[dict]:
    """Raw blocks of a Markdown text: headings, pipe tables as HTML, paragraphs."""
    lines, held, at = (text or "").splitlines(), [], 0

    def cells(line: str) -> list[str]:
        return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]

    def flushed() -> Iterator[dict]:
        if held:
            yield {"type": "text", "text": "\n".join(held)}
            held.clear()

    while at < len(lines):
        line, at = lines[at], at + 1
        plain = line.strip()
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*\Z", plain):
            yield from flushed()
            yield {"type": "text", "text": m[2], "text_level": len(m[1])}
        elif "|" in plain and at < len(lines) and "|" in lines[at] and all(SEPARATOR.match(c) for c in cells(lines[at])):
            yield from flushed()
            rows, at = [cells(plain)], at + 1
            while at < len(lines) and lines[at].strip() and "|" in lines[at]:
                rows.append(cells(lines[at]))
                at += 1
            row = lambda values, tag: f"<tr>{''.join(f'<{tag}>{v}</{tag}>' for v in values)}</tr>"
            yield {"type": "table", "table_body": f"<table>{row(rows[0], 'th')}{''.join(row(r, 'td') for r in rows[1:])}</table>"}
        elif plain:
            held.append(plain)
        else:
            yield from flushed()
    yield from flushed()


def parsed(files: DataFrame, parser: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Raw blocks (D2) of files (doc_id, content) by a parser of their bytes: the place for an outer parser.

    A file that the parser fails on gives one block of type ``error`` with what it said, and no others.
    """
    names = [c.split()[0] for c in fields.RAW_BLOCK.split(", ")]

    def blocks(content: bytes) -> list[dict]:
        try:
            return [dict(b) for b in parser(content)]
        except Exception as e:  # noqa: BLE001  whatever an outer parser raises concerns this file alone
            return [{"type": "error", "text": f"{type(e).__name__}: {e}"}]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [b | {"doc_id": d, "pos": k} for d, content in zip(pdf["doc_id"], pdf["content"], strict=True) for k, b in enumerate(blocks(content))]
            yield pd.DataFrame(rows, columns=names).astype({"text_level": "Int32", "page_idx": "Int32"}).astype(object).where(lambda x: x.notna(), None)

    return files.select("doc_id", "content").mapInPandas(each, fields.RAW_BLOCK)


def markdown(files: DataFrame) -> DataFrame:
    return parsed(files, lambda content: ({"page_idx": 0} | b for b in markdown_blocks(content.decode("utf-8", "replace"))))


def content_list(files: DataFrame) -> DataFrame:
    """Raw blocks of files that hold an outer parser's content list, a JSON array."""
    return parsed(files, lambda content: iter(json.loads(content)))


def unparsed(docs: DataFrame, raw: DataFrame, again: bool = False) -> DataFrame:
    """Documents whose blocks are not there yet; all of them again."""
    return docs if again else docs.join(raw.select("doc_id").distinct(), "doc_id", "left_anti")


def image_side(content: bytes | None) -> tuple[int, int] | None:
    """Width and height from a PNG or JPEG header; None for anything else."""
    data = content or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


@lazy_udf("struct<width:int,height:int>")
def image_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_side(c) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")


def templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """The text files of a folder by their names without ending: prompts as data, for functions.text.filled()."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    return {r["name"].removesuffix(".txt"): r["value"] for r in rows.collect()}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line from 1, value of every line of text files, read in splits.

    Lines are counted a split, counts are added up in the order of splits, and a line's number is the lines of the
    splits before it and its place in its own. The sums are one row a split.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value")
    rows, _ = staged(read, "lines")
    splits = rows.groupBy("path", "split").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "split", "first", before.alias("before"))
    return rows.join(F.broadcast(splits), ["path", "split"]).select("path", (F.col("before") + F.col("n") - F.col("first") + 1).alias("line"), "value")


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSONL file with their line number and error, null where the line is good."""

    def check(line: str) -> tuple[dict, str | None]:
        try:
            return _item(json.loads(line)), None
        except (ValueError, AttributeError) as e:
            return {}, str(e)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "category", "turns", "expect", "gold", "must_include", "must_not_include", "note"]
        for pdf in batches:
            out = []
            for n, line in zip(pdf["line"], pdf["value"], strict=True):
                if line.strip():
                    item, error = check(line)
                    out.append({"line": n, "error": error} | dict.fromkeys(names) | item)
            yield pd.DataFrame(out, columns=["line", "error", *names])

    lines = numbered_lines(spark, path).select(F.col("line").cast("int").alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))
    return lines.mapInPandas(each, f"line int, error string, {fields.EVAL_ITEM}")


def _field(data: dict, key: str, kind: type, default: object = ...) -> object:
    value = data.get(key, default)
    if value is ...:
        raise ValueError(f"no {key}")
    if not isinstance(value, kind):
        raise ValueError(f"{key} is not a {kind.__name__}")
    return value


def _some(data: dict, key: str, kind: type, default: object = ()) -> list:
    value = _field(data, key, (list, tuple) if default is not ... else list, default) if kind else None
    if not all(isinstance(v, kind) for v in value):
        raise ValueError(f"{key} is not a list of {kind.__name__}")
    return list(value)


def _shared(data: dict) -> dict:
    expect = data.get("expect")
    if expect is not None and expect not in rules.EXPECTS:
        raise ValueError(f"unknown expect {expect!r}")
    gold = [{"file": _field(g, "file", str), "quote": _field(g, "quote", str)} for g in _some(data, "gold", dict)]
    return {"expect": expect, "gold": gold, "must_include": _some(data, "must_include", str), "must_not_include": _some(data, "must_not_include", str)}


def _item(data: object) -> dict:
    if not isinstance(data, dict):
        raise ValueError("not an object")
    if _field(data, "category", str) not in rules.CATEGORIES:
        raise ValueError(f"unknown category {data['category']!r}")
    turns = [{"q": _field(t, "q", str)} | _shared(t) for t in _some(data, "turns", dict, ...)]
    return {"id": _field(data, "id", str), "category": data["category"], "turns": turns, "note": _field(data, "note", str, "")} | _shared(data)
