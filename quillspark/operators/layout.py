"""From parsed blocks to layout blocks, chunks and facts; a document is the unit of work.

The folds carry state from block to block, so they run once per document, in its order; documents do not
depend on each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions import fields, rules, text as tx
from quillspark.functions.tables import Table, merged
from quillspark.session import partitions

STYLES = [(re.compile(p), n) for p, n in rules.HEADING_LEVELS]
UNIT_LINE = re.compile(rules.UNIT_LINE)


def style_level(title: str) -> int | None:
    return next((n for p, n in STYLES if p.match(title)), None)


def heading_like(text: str) -> bool:
    return 0 < len(text) <= rules.HEADING_MOST and text[-1] not in rules.HEADING_BAD_ENDS and rules.HEADING_BAD_MARK not in text


@dataclass
class Outline:
    """Open headings as (level, title, whether numbered). The first level-1 heading is the document's title."""

    open: list[tuple[int, str, bool]] = field(default_factory=list)
    titled: bool = False

    def enter(self, title: str, given: int) -> int:
        numbered = True
        if given == 1 and not self.titled:
            self.titled, self.open = True, []
            return 1
        if given == 1:
            level = 1
        elif (level := style_level(title)) is None:
            numbered = False
            above = [n for n, _, known in self.open if known and n > 1]
            level = min(above[-1] + 1, rules.DEEPEST_CHILD) if above else rules.ORPHAN_LEVEL
        keep = next((k for k in range(len(self.open), 0, -1) if self.open[k - 1][0] < level), 0)
        self.open = [*self.open[:keep], (level, title, numbered)]
        return level

    @property
    def path(self) -> list[str]:
        return [t for _, t, _ in self.open]


@dataclass
class Layout:
    """Layout blocks of one document, from cleaned raw blocks in order."""

    blocks: list[dict] = field(default_factory=list)
    outline: Outline = field(default_factory=Outline)
    paragraph: dict | None = None
    unit: tuple[list[str], str] | None = None

    def add(self, raw: dict) -> None:
        kind, page = raw["type"] or "text", int(raw["page_idx"] or 0) + 1
        if kind in rules.DROPPED_BLOCKS:
            return
        if kind == "table":
            self.table(raw, page)
        elif kind in rules.IMAGE_BLOCKS:
            self.new("image", page, text=raw["content"], caption=raw["image_caption"] or raw["chart_caption"], footnote=raw["image_footnote"] or raw["chart_footnote"], img_path=raw["img_path"] or None, derived=True)
            self.paragraph = None
        elif raw["text"]:
            self.words(raw, kind, page)

    def new(self, kind: str, page: int, **given: object) -> dict:
        empty = {"text": "", "level": None, "page_end": None, "table_html": None, "caption": "", "footnote": "", "context": "", "img_path": None, "derived": False, "absorbed": False}
        self.blocks.append(empty | given | {"seq": len(self.blocks), "type": kind, "page": page, "section_path": self.outline.path})
        return self.blocks[-1]

    def table(self, raw: dict, page: int) -> None:
        last, body = self.blocks[-1] if self.blocks else None, raw["table_body"] or ""
        follows = last is not None and last["type"] == "table"
        if not body.strip():
            if follows:
                last["page_end"] = max(last["page_end"] or last["page"], page)
            return
        caption, footnote = raw["table_caption"], raw["table_footnote"]
        if follows and not caption and page == (last["page_end"] or last["page"]) + 1 and Table(body).n_cols == Table(last["table_html"]).n_cols:
            last |= {"table_html": merged(last["table_html"], body), "page_end": page, "footnote": " ".join(filter(None, [last["footnote"], footnote]))}
            return
        path, context = self.outline.path, ""
        if last is not None and last["type"] == "text" and len(last["text"]) <= rules.UNIT_LINE_MOST and UNIT_LINE.match(last["text"]):
            last["absorbed"], context = True, last["text"]
            self.unit = (path, context)
        elif self.unit and self.unit[0] == path:
            context = self.unit[1]
        self.new("table", page, table_html=body, caption=caption, footnote=footnote, context=context)
        self.paragraph = None

    def words(self, raw: dict, kind: str, page: int) -> None:
        text, given, before = raw["text"], raw["text_level"], self.paragraph
        if kind == "text" and given and heading_like(text):
            level = self.outline.enter(text, int(given))
            if self.outline.open:
                self.new("heading", page, text=text, level=level)
                self.paragraph = None
        elif kind == "page_footnote":
            self.new("text", page, text=f"注：{text}")
        elif before and page > (before["page_end"] or before["page"]) and before["text"][-1] not in rules.PARAGRAPH_ENDS:
            before |= {"text": before["text"] + text, "page_end": page}
        else:
            self.paragraph = self.new("text", page, text=text)


def cleaned_raw(raw: DataFrame) -> DataFrame:
    """Raw blocks with one cleaned text each: list items by lines, code only trimmed; captions joined."""
    have = set(raw.columns)
    get = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    arrays = lambda c: F.coalesce(tx.cleaned(F.array_join(F.filter(get(c, "array<string>"), lambda x: x != ""), " ")), F.lit(""))
    items = F.array_join(F.transform(F.filter(get("list_items", "array<string>"), lambda x: x != ""), tx.cleaned), "\n")
    text = F.when(F.col("type") == "list", F.coalesce(items, F.lit(""))).when(F.col("type") == "code", tx.strip(F.coalesce(get("code_body", "string"), F.lit("")))).otherwise(tx.cleaned(get("text", "string")))
    return raw.select(
        "doc_id", "pos", F.coalesce("type", F.lit("text")).alias("type"), text.alias("text"), get("text_level", "int").alias("text_level"), get("page_idx", "int").alias("page_idx"),
        get("table_body", "string").alias("table_body"), tx.cleaned(get("content", "string")).alias("content"), get("img_path", "string").alias("img_path"),
        *[arrays(c).alias(c) for c in ("table_caption", "table_footnote", "image_caption", "chart_caption", "image_footnote", "chart_footnote")],
    )


def layout_blocks(rows: Iterable[dict]) -> list[dict]:
    out = Layout()
    for raw in rows:
        out.add(raw)
    return out.blocks


def each_document(rows: DataFrame, order: str, fold: Callable[[list[dict]], list[dict]], ddl: str) -> DataFrame:
    """Rows of every document, in its order, through a fold; one exchange by document, then a stream of documents.

    A task holds the rows of one document at a time.
    """
    spark = rows.sparkSession
    shape = spark.createDataFrame([], ddl).schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def finished() -> list[dict]:
            return [r | {"doc_id": key} for r in fold(held)] if held else []

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["doc_id"] != key:
                    out += finished()
                    held = []
                key = row["doc_id"]
                held.append(row)
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out + finished(), schema=arrow)

    return rows.repartition(partitions(spark), "doc_id").sortWithinPartitions("doc_id", order).mapInArrow(run, shape)


def layout(raw: DataFrame) -> DataFrame:
    """Layout blocks of every document of raw blocks (doc_id, pos, type, ...)."""
    return each_document(cleaned_raw(raw), "pos", layout_blocks, fields.BLOCK)


def images_to_describe(blocks: DataFrame, captions: DataFrame, images: DataFrame) -> DataFrame:
    """Image blocks without a caption yet, with what a captioner is told of their place; small and unreadable ones not.

    images: doc_id, img_path, width, height. The context is the caption, else the last two headings above.
    """
    rows = blocks.where((F.col("type") == "image") & F.col("img_path").isNotNull()).join(captions.select("doc_id", "img_path"), ["doc_id", "img_path"], "left_anti")
    rows = rows.join(images, ["doc_id", "img_path"], "left").where(F.greatest("width", "height") >= rules.LEAST_IMAGE_SIDE)
    above = tx.section(F.reverse(F.slice(F.reverse("section_path"), 1, 2)))
    return rows.withColumn("about", F.coalesce(F.nullif("caption", F.lit("")), above)).select("doc_id", "seq", "img_path", "about")


def captioned(wanted: DataFrame, contents: DataFrame, captioner: Callable[[Column, Column], Column]) -> DataFrame:
    """doc_id, img_path, description of images_to_describe() by a captioner of their bytes (doc_id, img_path, content) and place."""
    told = wanted.dropDuplicates(["doc_id", "img_path"]).join(contents, ["doc_id", "img_path"])
    return told.select("doc_id", "img_path", captioner(F.col("content"), F.col("about")).alias("description"))


def described(blocks: DataFrame, captions: DataFrame) -> DataFrame:
    """Images with their descriptions (doc_id, img_path, description); those without one, or with none that
    tells anything, are dropped and the others numbered anew."""
    told = blocks.join(captions, ["doc_id", "img_path"], "left")
    text = F.when(F.col("type") == "image", F.col("description")).otherwise(F.col("text"))
    kept = told.withColumn("text", text).where((F.col("type") != "image") | ((F.coalesce("text", F.lit("")) != "") & ~F.coalesce("text", F.lit("")).contains(rules.NO_CONTENT)))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return kept.withColumn("seq", number).select(*blocks.columns)


def pieces(text: str, target: int = rules.CHUNK_TARGET, most: int = rules.CHUNK_MOST) -> list[str]:
    """A long text in trimmed pieces of whole sentences: each ends at target and none is above most."""
    out = [""]
    for sentence in re.findall(rf"[^{rules.CHUNK_SENTENCE_ENDS}]*[{rules.CHUNK_SENTENCE_ENDS}]|[^{rules.CHUNK_SENTENCE_ENDS}]+$", text):
        whole, rest = divmod(max(len(sentence) - 1, 0), most)
        if whole:
            out += [sentence[k * most : (k + 1) * most] for k in range(whole)]
            out.append("")
            sentence = sentence[whole * most :]
        if len(out[-1]) + len(sentence) > most:
            out.append("")
        out[-1] += sentence
        if len(out[-1]) >= target:
            out.append("")
    return [p for p in map(str.strip, out) if p]


@dataclass
class Packer:
    """Chunks of one document. held: headings and short texts that wait to become one chunk."""

    target: int = rules.CHUNK_TARGET
    most: int = rules.CHUNK_MOST
    least: int = rules.CHUNK_LEAST
    table_most: int = rules.TABLE_MOST
    chunks: list[dict] = field(default_factory=list)
    held: list[dict] = field(default_factory=list)

    @property
    def size(self) -> int:
        return sum(len(b["text"]) + 1 for b in self.held)

    @property
    def only_headings(self) -> bool:
        return all(b["type"] == "heading" for b in self.held)

    def emit(self, kind: str, text: str, body: str, blocks: list[dict], **given: object) -> None:
        pages = [(b["page"], b["page_end"] or b["page"]) for b in blocks]
        self.chunks.append({"seq": len(self.chunks), "kind": kind, "text": text, "embed_body": body, "section_path": " > ".join(blocks[0]["section_path"]), "page_start": min(p for p, _ in pages), "page_end": max(p for _, p in pages), "derived": False, "table_html": None} | given)

    def release(self) -> None:
        if not self.only_headings:
            text = "\n".join(b["text"] for b in self.held)
            self.emit("text", text, text, self.held)
            self.held = []

    def add(self, block: dict) -> None:
        if not block["absorbed"]:
            getattr(self, block["type"])(block)

    def table(self, block: dict) -> None:
        if self.only_headings:
            self.held = []
        elif self.size >= self.least:
            self.release()
        self.emit_table(block)

    def image(self, block: dict) -> None:
        if self.only_headings:
            self.held = []
        text = "\n".join(filter(None, [" ".join(filter(None, ["[图表]", block["caption"]])), block["text"], block["footnote"]]))
        self.emit("image_desc", text, text, [block], derived=True)

    def heading(self, block: dict) -> None:
        if self.size >= self.least:
            self.release()
        elif self.only_headings and block["level"] is not None:
            self.held = [b for b in self.held if (b["level"] or 0) < block["level"]]
        self.held.append(block)

    def text(self, block: dict) -> None:
        long = len(block["text"]) > self.most
        if long or self.size + len(block["text"]) > self.most:
            self.release()
        if long:
            found = pieces(block["text"], self.target, self.most)
            for k, piece in enumerate(found):
                whole = "\n".join([*(b["text"] for b in self.held if not k), piece])
                self.emit("text", whole, whole, [block])
            self.held = []
            return
        self.held.append(block)
        if self.size >= self.target:
            self.release()

    def emit_table(self, block: dict) -> None:
        table = Table(block["table_html"])
        if not table.grid:
            return
        label = " · ".join(filter(None, [block["caption"], block["context"] or table.unit]))
        groups = table.parts(self.table_most) or [[]]
        for k, rows in enumerate(groups, 1):
            part = f"（续表 {k}/{len(groups)}）" if len(groups) > 1 else ""
            head = " ".join(filter(None, [block["caption"], part]))
            shown = [head, block["context"], table.markdown(rows), block["footnote"] if k == len(groups) else ""]
            body = [*([f"[{label}]"] if label else []), *table.lines(rows)]
            self.emit("table", "\n".join(filter(None, shown)), "\n".join(body), [block], table_html=block["table_html"] if len(groups) == 1 else None)


def packed(blocks: Iterable[dict], **limits: int) -> list[dict]:
    out = Packer(**limits)
    for block in blocks:
        out.add(block)
    out.release()
    return out.chunks


def chunk(blocks: DataFrame, **limits: int) -> DataFrame:
    """Chunks of every document of layout blocks."""
    return each_document(blocks, "seq", lambda rows: packed(rows, **limits), fields.CHUNK)


def table_facts(blocks: DataFrame) -> DataFrame:
    """Facts of the tables in the sections on main accounting data, in order within their document."""
    columns = [c.split()[0] for c in fields.FACT.split(", ")]
    tables = blocks.where((F.col("type") == "table") & tx.section("section_path").contains(rules.FACT_SECTION))
    rows = tables.select("doc_id", "seq", "table_html", "context", tx.section("section_path").alias("section"), "page", F.coalesce("page_end", "page").alias("last"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                table = Table(r.table_html)
                for k, (item, column, value) in enumerate(table.facts()):
                    out.append((r.doc_id, (int(r.seq) << 32) + k, r.context or table.unit, r.section, r.page, r.last, item, column, value))
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(each, fields.FACT)


def fact_chunks(facts: DataFrame, keys: tuple[str, ...] = ("doc_id", "section", "page_start", "item")) -> DataFrame:
    """Facts of one row as one text ``item：column=value；…（unit）〔section〕``, in order of first appearance."""
    cell = F.when(F.col("column") != "", F.concat_ws("=", "column", "value")).otherwise(F.col("value"))
    groups = facts.groupBy(*keys).agg(
        F.min("ord").alias("ord"), F.min_by("unit", "ord").alias("unit"), F.min_by("page_end", "ord").alias("page_end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", cell.alias("cell")))), lambda x: x["cell"]), "；").alias("cells"),
    )
    unit = F.when(F.coalesce("unit", F.lit("")) != "", F.concat(F.lit("（"), "unit", F.lit("）"))).otherwise("")
    return groups.withColumn("text", F.concat("item", F.lit("："), "cells", unit, F.lit("〔"), "section", F.lit("〕")))


def assembled(chunks: DataFrame, most: int, kinds: tuple[str, ...] = ("text",), id_col: str = "doc_id", order_col: str = "seq", text_col: str = "text") -> DataFrame:
    """The texts of each document in order, by lines, up to and with the one that reaches most, cut at most."""
    rows = chunks.where(F.col("kind").isin(*kinds)) if kinds else chunks
    before = Window.partitionBy(id_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.length(text_col)).over(before), F.lit(0))).where(F.col("_before") < most)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col])
    return rows.groupBy(id_col).agg(F.substring(F.array_join(parts, "\n"), 1, most).alias(text_col))


def entity_input(raw: DataFrame, chunks: DataFrame, most: int = rules.ENTITY_MOST) -> DataFrame:
    """What an entity recogniser reads: distinct page headers of the first two pages, then texts and tables in order, cut at most."""
    heads = raw.where((F.col("type") == "header") & (F.coalesce("page_idx", F.lit(0)) < 2)).select("doc_id", "pos", tx.strip(F.col("text")).alias("text"))
    heads = heads.where("text <> ''").groupBy("doc_id", "text").agg(F.min("pos").alias("seq")).withColumn("part", F.lit(0))
    body = chunks.where(F.col("kind").isin("text", "table")).select("doc_id", "text", "seq").withColumn("part", F.lit(1))
    rows = heads.unionByName(body)
    before = Window.partitionBy("doc_id").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where((F.col("part") == 0) | (F.col("_before") < most))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id").agg(F.substring(F.array_join(parts, "\n"), 1, most).alias("text"))


def all_chunks(docs: DataFrame, chunks: DataFrame, facts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Body chunks, then facts of company reports, then the summary (doc_id, summary), numbered from 0."""
    report = docs.where(F.col("content_type") == rules.FACT_TYPE).select("doc_id")
    fact = fact_chunks(facts).join(report, "doc_id", "left_semi").select(
        "doc_id", F.col("ord").alias("seq"), F.lit("fact").alias("kind"), "text", F.col("text").alias("embed_body"), F.col("section").alias("section_path"), "page_start", "page_end",
        F.lit(False).alias("derived"), F.lit(None).cast("string").alias("table_html"),
    )
    text = F.concat(F.lit(rules.SUMMARY_PREFIX), "summary")
    summary = summaries.where("summary <> ''").select(
        "doc_id", F.lit(0).alias("seq"), F.lit("summary").alias("kind"), text.alias("text"), F.col("summary").alias("embed_body"), F.lit("").alias("section_path"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"),
        F.lit(False).alias("derived"), F.lit(None).cast("string").alias("table_html"),
    )
    every = chunks.withColumn("_o", F.lit(0)).unionByName(fact.withColumn("_o", F.lit(1))).unionByName(summary.withColumn("_o", F.lit(2)))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_o", "seq")) - 1
    return every.withColumn("seq", number).drop("_o")
