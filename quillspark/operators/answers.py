"""Rules on answers: guarded sentences, citations, model output, notices, rendering."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules, text as tx
from quillspark.functions.lazy import lazy_udf


@dataclass(frozen=True)
class Guard:
    """Phrases that no answer may hold, the words that negate them and those that tell of a fraud."""

    banned: tuple[str, ...] = tuple(rules.BANNED)
    negations: tuple[str, ...] = tuple(rules.NEGATIONS)
    warnings: tuple[str, ...] = tuple(rules.WARNINGS)
    advice: str = rules.ADVICE
    ends: str = rules.GUARD_SENTENCE_ENDS
    replacement: str = rules.GUARD_REPLACEMENT
    window: int = rules.NEGATION_CHARS

    def negated(self, text: str, at: int) -> bool:
        before = text[max(at - self.window, 0) : at]
        return any(n in before for n in self.negations)

    def violations(self, sentence: str, context: str = "") -> list[str]:
        """Banned phrases in list order, then advice; each occurrence that is not negated. Words of warning in
        the sentence or before it lift the ban on phrases, not on advice."""
        told = any(w in t for w in self.warnings for t in (sentence, context))
        patterns = [*([] if told else map(re.escape, self.banned)), *([self.advice] if self.advice else [])]
        return [m[0] for p in patterns for m in re.finditer(p, sentence) if not self.negated(sentence, m.start())]

    def kept(self, context: str) -> str:
        """As much of a context as matters for what follows: a word of warning, or an end that may begin one."""
        longest = max(map(len, self.warnings), default=1)
        return next((w for w in self.warnings if w in context), context[len(context) - min(len(context), longest - 1) :])

    def sentences(self, text: str) -> list[str]:
        return re.findall(rf"[^{self.ends}]*[{self.ends}]|[^{self.ends}]+\Z", text)


@dataclass
class GuardedStream:
    """Whole sentences of a stream, a violating one replaced; what has been seen is context for what follows."""

    guard: Guard
    context: str = ""
    waiting: str = ""
    hits: list[str] = field(default_factory=list)

    def take(self, delta: str, last: bool = False) -> str:
        found = self.guard.sentences(self.waiting + delta)
        open_end = bool(found) and found[-1][-1] not in self.guard.ends
        self.waiting = found.pop() if open_end and not last else ""
        return "".join(map(self._checked, found))

    def _checked(self, sentence: str) -> str:
        bad = self.guard.violations(sentence, self.context)
        self.context = self.guard.kept(self.context + sentence)
        self.hits += bad
        return self.guard.replacement + "\n" * sentence.endswith("\n") if bad else sentence


def violations(sentence: Column, context: Column | None = None, guard: Guard = Guard()) -> Column:
    """Guard.violations over columns, without Python: positions of each phrase, less the negated ones."""
    context = F.lit("") if context is None else F.coalesce(context, F.lit(""))
    told = reduce(lambda a, b: a | b, [t.contains(w) for w in guard.warnings for t in (sentence, context)], F.lit(False))
    # A negation that begins within the window before a match; a negated match is passed over whole.
    free = "".join(rf"(?<!{re.escape(n)}[\s\S]{{0,{guard.window - len(n)}}})" for n in guard.negations if len(n) <= guard.window)

    def occurrences(pattern: str) -> Column:
        found = F.regexp_extract_all(sentence, F.lit(f"(?={pattern}){free}({pattern})|(?:{pattern})"), 1)
        return F.filter(found, lambda t: t != "")

    none = F.array().cast("array<string>")
    parts = [F.when(~told & sentence.contains(b), occurrences(re.escape(b))).otherwise(none) for b in guard.banned]
    if guard.advice:
        parts.append(F.when(sentence.rlike(guard.advice), occurrences(guard.advice)).otherwise(none))
    return F.flatten(F.array(*parts))


def guarded(answers: DataFrame, guard: Guard = Guard(), id_col: str = "answer_id", text_col: str = "text", question_col: str = "question") -> DataFrame:
    """id_col, guarded text and hits of whole answers; the question is the first context."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, question in zip(pdf["k"], pdf["t"], pdf["q"], strict=True):
                stream = GuardedStream(guard, question or "")
                out.append((key, stream.take(text or "", last=True), stream.hits))
            yield pd.DataFrame(out, columns=[id_col, "guarded", "hits"])

    kind = answers.schema[id_col].dataType.simpleString()
    rows = answers.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(question_col).alias("q"))
    return rows.mapInPandas(each, f"`{id_col}` {kind}, guarded string, hits array<string>")


def excluded(answer: Column, phrases: Column, guard: Guard = Guard()) -> Column:
    """The phrases of an array that the answer has anywhere without a negation shortly before."""
    no = "|".join(map(re.escape, guard.negations))

    def bare(p: Column) -> Column:
        pieces = F.split(answer, F.concat(F.lit("\\Q"), p, F.lit("\\E")), -1)
        before = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x, i: F.concat(F.when(i > 0, p).otherwise(""), x))
        return F.exists(before, lambda b: ~F.substring(b, -guard.window, guard.window).rlike(no))

    return F.filter(phrases, bare)


def cited(text: Column) -> Column:
    """Numbers of citation marks in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(rules.CITATION), 1), lambda n: n.try_cast("int"))


def citations(text: Column, known: Column) -> Column:
    """struct<text, used>: marks of known numbers as [En], others dropped; used ones by first appearance."""
    numbers = F.array_distinct(cited(text))
    used = F.filter(numbers, lambda n: F.array_contains(known, n))
    spelt = F.regexp_replace(F.regexp_replace(text, rules.CITATION, "\u0001$1\u0002"), "\u00010*(?=\\d)", "\u0001")
    fixed = F.aggregate(used, spelt, lambda s, n: F.replace(s, F.concat(F.lit("\u0001"), n.cast("string"), F.lit("\u0002")), F.concat(F.lit("[E"), n.cast("string"), F.lit("]"))))
    return F.struct(F.regexp_replace(fixed, "\u0001\\d+\u0002", "").alias("text"), used.alias("used"))


def body_and_meta(raw: Column) -> Column:
    """struct<body, meta>: what stands before and after the first separator, trimmed."""
    parts = F.split(raw, f"\\Q{rules.META_MARK}\\E", 2)
    return F.struct(tx.strip(F.get(parts, F.lit(0))).alias("body"), F.coalesce(tx.strip(F.get(parts, F.lit(1))), F.lit("")).alias("meta"))


def meta_of(meta: str | None, body: str | None) -> tuple[str, list[int], list[str], bool]:
    """kind, cited, notices and whether the model's own account could be read; else those of a plain answer."""
    try:
        found = re.search(r"\{.*\}", meta or "", re.S)
        data = json.loads(found[0]) if found else None
    except ValueError:
        data = None
    if not isinstance(data, dict) or data.get("kind") not in rules.KINDS:
        return "answer", [int(n) for n in re.findall(rules.CITATION, body or "")], [], False
    as_list = lambda v: v if isinstance(v, list) else []
    numbers = [int(v) for v in as_list(data.get("cited")) if (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, str) and v.strip().isdigit())]
    names = dict.fromkeys(v.strip() for v in as_list(data.get("notices")) if isinstance(v, str))
    return data["kind"], numbers, [n for n in names if n in rules.NOTICES], True


@lazy_udf("struct<kind:string,cited:array<bigint>,notices:array<string>,meta_ok:boolean>")
def parsed_meta(meta: pd.Series, body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([meta_of(m, b) for m, b in zip(meta, body, strict=True)], columns=["kind", "cited", "notices", "meta_ok"])


def plan_of(output: str | None, question: str) -> tuple[str, list[str]]:
    """The plan a model gave as JSON; the question itself, without mentions, where it cannot be read."""
    try:
        found = re.search(r"\{.*\}", output or "", re.S)
        data = json.loads(found[0] if found else output or "")
        query, mentions = data["standalone_query"], data.get("entity_mentions", [])
        if isinstance(query, str) and isinstance(mentions, list) and all(isinstance(m, str) for m in mentions):
            return query, mentions
    except (ValueError, KeyError, TypeError):
        pass
    return question, []


@lazy_udf("struct<standalone_query:string,entity_mentions:array<string>>")
def parsed_plan(output: pd.Series, question: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([plan_of(o, q) for o, q in zip(output, question, strict=True)], columns=["standalone_query", "entity_mentions"])


def with_notices(answer: Column, notices: Column) -> Column:
    """The answer with the texts of its notices that it does not have yet."""
    texts = F.filter(tx.hit_list(notices, rules.NOTICES), lambda t: ~answer.contains(t))
    return F.when(F.size(texts) > 0, F.concat(answer, F.lit("\n\n"), F.array_join(texts, "\n"))).otherwise(answer)


def clarification(names: Column) -> Column:
    lines = F.transform(names, lambda n, i: F.concat((i + 1).cast("string"), F.lit(". "), n))
    return F.concat_ws("\n", F.lit(rules.CLARIFY_HEAD), F.array_join(lines, "\n"), F.lit(rules.CLARIFY_TAIL))


def _pages(first: Column, last: Column) -> Column:
    return F.concat(F.lit("第"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("页"))


def prompt_block(chars: int = rules.PROMPT_CHARS) -> Column:
    """An evidence row as a model reads it."""
    c = F.col
    pages = F.when(c("page_start") != 0, F.concat(F.lit("｜"), _pages(c("page_start"), c("page_end")))).otherwise("")
    drawn = F.when(c("derived"), "｜据图表示意").otherwise("")
    return F.concat(F.lit("[E"), c("eid").cast("string"), F.lit("] 〔"), c("document_title"), F.lit("｜"), c("content_type"), pages, drawn, F.lit("〕\n"), F.substring("text", 1, chars))


def source_line() -> Column:
    """An evidence row as a line of the list of sources."""
    c = F.col
    codes = F.when(F.size("entity_codes") > 0, F.concat(F.lit("（"), F.array_join("entity_codes", "、"), F.lit("）"))).otherwise("")
    who = F.when(c("entity_name") != "", F.concat(c("entity_name"), codes))
    one = F.concat(F.lit("第"), c("page_start").cast("string"), F.lit("页"))
    pages = F.when(c("page_start") != 0, F.when(c("page_start") == c("page_end"), one).otherwise(_pages(c("page_start"), c("page_end"))))
    return F.concat(F.lit("[E"), c("eid").cast("string"), F.lit("] "), F.concat_ws("｜", c("document_title"), c("content_type"), who, c("file_name"), pages))


def guarded_sentences(sentences: DataFrame, guard: Guard, id_col: str, at_col: str = "at", text_col: str = "sentence") -> DataFrame:
    """Sentences of answers with their hits, each with all sentences before it as context: the batch form of a stream."""
    before = Window.partitionBy(id_col).orderBy(at_col).rowsBetween(Window.unboundedPreceding, -1)
    # Of the context only whether a warning has come before matters.
    warned = reduce(lambda a, b: a | b, [F.col(text_col).contains(w) for w in guard.warnings], F.lit(False))
    rows = sentences.withColumn("_told", F.coalesce(F.bool_or(warned).over(before), F.lit(False)))
    context = F.when(F.col("_told"), guard.warnings[0] if guard.warnings else "").otherwise("")
    return rows.withColumn("hits", violations(F.col(text_col), context, guard)).drop("_told")
