"""Questions to answers, a table at a time: plan, resolve, retrieve, generate, guard, cite, remember.

The models are functions of columns: ``planner(question, history, focus)`` gives a model's JSON, focus being the
names of what the session is about, ``generator(prompt, question)`` its raw output, ``embed(text)`` a vector and ``scorer(query, text)`` a reranker's score. The
defaults need no model: questions stand for themselves, mentions are the labels and codes they contain, and
the answer is the first sentence of the first evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions import text as tx
from quillspark.operators import answers, evaluation, registry, retrieval, sessions
from quillspark.operators import entities as ent
from quillspark.operators.dictionary import occurrences
from quillspark.session import staged


def _strings() -> Column:
    return F.array().cast("array<string>")


def accepted(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (request_id, session_id, question) that can be asked, trimmed, and the others with a reason."""
    rows = questions.withColumn("_check", registry.question_check(F.col("question"), rules.QUESTION_MOST))
    good = rows.where("_check.ok").withColumn("question", tx.strip(F.col("question"))).drop("_check")
    return good, rows.where("not _check.ok").withColumn("reason", F.col("_check.reason")).drop("_check")


def dictionary_mentions(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(request_id, mentions): labels of two characters at least, and codes, that a question contains; longest first."""
    words = ent.labels(entities).select("label").unionByName(entities.select(F.explode("codes").alias("label"))).where(F.length("label") >= 2).distinct()
    words, _ = staged(words.withColumn("_label", F.upper("label")), "words")
    met = occurrences(questions.select("request_id", F.upper("question").alias("_text")), "_text", words, "_label").join(words, "_label")
    order = F.sort_array(F.collect_list(F.struct((-F.length("label")).alias("n"), "label")))
    return met.groupBy("request_id").agg(F.transform(order, lambda x: x["label"]).alias("mentions"))


def clarified(questions: DataFrame, state: DataFrame, entities: DataFrame) -> DataFrame:
    """(request_id, entity_id, standalone_query) of replies that pick one of their session's pending options."""
    asked = questions.join(state.where("pending is not null"), "session_id")
    options = asked.select("request_id", "question", F.col("pending.plan.standalone_query").alias("before"), F.posexplode("pending.options").alias("at", "id")).join(entities.select("id", "name", "aliases"), "id")
    listed = options.groupBy("request_id", "question", "before").agg(F.sort_array(F.collect_list(F.struct("at", "id", "name", "aliases"))).alias("o"))
    picked = listed.withColumn("k", ent.picked_option("question", F.transform("o", lambda x: F.struct(x["name"].alias("name"), x["aliases"].alias("aliases"))))).where("k is not null")
    chosen = F.get("o", F.col("k"))
    return picked.select("request_id", chosen["id"].alias("entity_id"), sessions.clarified_query(chosen["name"], F.col("before")).alias("standalone_query"))


def focus_names(state: DataFrame, entities: DataFrame) -> DataFrame:
    """(session_id, focus_names): names of the entities in focus, in order; those that are gone are passed over."""
    rows = state.select("session_id", F.posexplode("focus").alias("at", "id")).join(entities.select("id", "name"), "id")
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    return rows.groupBy("session_id").agg(F.array_join(names, "、").alias("focus_names"))


def plan_prompt(question: Column, history: Column, focus: Column) -> Column:
    """What a planning model reads of a question."""
    return tx.filled(rules.PLAN_TEMPLATE, history=history, focus=focus, question=question)


def scoped_hits(queries: DataFrame, scope: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Fused hits of queries whose scope (query_id, doc_id) names their documents: only those chunks are scored."""
    rows = scope.join(chunks, "doc_id").join(queries.select("query_id", F.col("dense").alias("qd"), F.col("sparse").alias("qs")), "query_id")
    shared = F.array_intersect(F.map_keys("qs"), F.map_keys("sparse"))
    sparse = F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.element_at("qs", t).cast("double") * F.element_at("sparse", t).cast("double"))
    scored = rows.select("query_id", "chunk_id", retrieval.dot(F.col("qd"), F.col("dense")).alias("d"), F.size(shared).alias("n"), sparse.alias("s"))
    arms = [scored.withColumnRenamed("d", "score"), scored.where("n > 0").withColumnRenamed("s", "score")]
    return retrieval.fused(*[retrieval.top(a, rules.CANDIDATES) for a in arms], k=k)


def extractive(prompt: Column, question: Column) -> Column:
    """The first sentence of the first evidence with its mark, as a model would write it; nothing without evidence."""
    first = F.regexp_extract(prompt, r"(?s)\A\[E1\][^\n]*\n([^。！？!?\n]*[。！？!?]?)", 1)
    return F.when(first != "", F.concat(first, F.lit('[E1]<<<META>>>{"kind": "answer", "cited": [1], "notices": []}'))).otherwise(F.lit(""))


def ask(
    questions: DataFrame,
    state: DataFrame,
    entities: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    history: DataFrame | None = None,
    planner: Callable[[Column, Column, Column], Column] | None = None,
    generator: Callable[[Column, Column], Column] = extractive,
    embed: Callable[[Column], Column] = retrieval.dense_vector,
    scorer: Callable[[Column, Column], Column] | None = retrieval.overlap,
    indexes: retrieval.Indexes | None = None,
) -> DataFrame:
    """request_id, session_id, question, kind, answer, notices, guard_hits, evidence, sources, plan, focus, pending.

    state: session_id, focus, pending; history: session_id, history text. A question without evidence is
    refused without a model; an empty body is a refusal; citations hold only in answers, and only answers
    keep their evidence. A clarification keeps the focus and stores its options.
    """
    # What several later steps read is staged, so that no step runs twice.
    questions, _ = staged(questions, "questions")
    entities, _ = staged(entities, "entities")
    chosen, _ = staged(clarified(questions, state, entities), "clarified")
    rest = questions.join(chosen, "request_id", "left_anti")
    if planner:
        told = rest.join(history, "session_id", "left") if history is not None else rest.withColumn("history", F.lit(None).cast("string"))
        told = told.join(focus_names(state, entities), "session_id", "left")
        nothing = F.lit(rules.NOTHING)
        said = planner(F.col("question"), F.coalesce("history", nothing), F.coalesce("focus_names", nothing))
        planned = told.withColumn("p", answers.parsed_plan(said, F.col("question"))).select("request_id", F.col("p.standalone_query").alias("standalone_query"), F.col("p.entity_mentions").alias("mentions"))
    else:
        planned = rest.join(dictionary_mentions(rest, entities), "request_id", "left").select("request_id", F.col("question").alias("standalone_query"), F.coalesce("mentions", _strings()).alias("mentions"))
    found = ent.resolve(planned.select("request_id", "mentions"), entities).join(planned, "request_id")
    found = found.unionByName(
        chosen.select("request_id", F.lit("confirmed").alias("status"), F.array("entity_id").alias("entity_ids"), _strings().alias("candidate_ids"), _strings().alias("unknown_mentions"), "standalone_query", _strings().alias("mentions"))
    )
    found, _ = staged(found, "resolved")
    queries = found.select(F.col("request_id").alias("query_id"), F.col("standalone_query").alias("query"), "entity_ids").withColumns({"dense": embed(F.col("query")), "sparse": retrieval.sparse_vector(F.col("query"))})
    queries, _ = staged(queries, "queries")
    confirmed = queries.select("query_id", F.posexplode("entity_ids").alias("at", "id"))
    scope = retrieval.documents_of(confirmed.select("query_id", "id"), entities)
    free = queries.join(scope.select("query_id").distinct(), "query_id", "left_anti")
    hits = scoped_hits(queries, scope, chunks, rules.FUSED).unionByName(retrieval.fused(*retrieval.arms(free, chunks, rules.CANDIDATES, indexes=indexes)))
    hits = retrieval.with_documents(hits.join(chunks.drop("dense", "sparse", "content_type"), "chunk_id"), docs).drop("file_name", "document_title", "source_path")
    numbered = retrieval.evidence(retrieval.reranked(hits, queries, scorer), docs, entities, confirmed)
    fields = ["eid", "kind", "text", "doc_id", "file_name", "document_title", "content_type", "page_start", "page_end", "source_path", "entity_name", "entity_codes", "derived"]
    whole = numbered.withColumn("block", answers.prompt_block()).withColumn("line", answers.source_line())
    gathered = whole.groupBy(F.col("query_id").alias("request_id")).agg(F.sort_array(F.collect_list(F.struct("eid", "block", "line", F.struct(*fields).alias("e")))).alias("g"))
    gathered, _ = staged(gathered, "evidence")
    rows = questions.join(found, "request_id").join(gathered, "request_id", "left")
    note = F.concat_ws("\n", F.when(F.size("unknown_mentions") > 0, F.concat(F.lit("以下对象不在知识库中："), F.array_join("unknown_mentions", "、"))))
    prompt = F.concat(F.array_join(F.transform("g", lambda x: x["block"]), "\n\n"), F.lit("\n\n"), tx.joined_nonempty("\n\n", note, F.concat(F.lit("问题："), "standalone_query")))
    rows = rows.withColumn("raw", F.when(F.col("g").isNotNull(), generator(prompt, F.col("question"))).otherwise(""))
    rows = rows.withColumn("parts", answers.body_and_meta(F.col("raw"))).withColumn("meta", answers.parsed_meta("parts.meta", "parts.body"))
    rows, _ = staged(rows, "outputs")
    safe = answers.guarded(rows.select("request_id", F.col("parts.body").alias("text"), "question"), id_col="request_id")
    rows = rows.join(safe, "request_id")
    empty = tx.strip(F.col("guarded")) == ""
    rows = rows.withColumn("out_kind", F.when(empty, "refuse").otherwise(F.col("meta.kind")))
    rows = rows.withColumn("c", answers.citations(F.col("guarded"), F.coalesce(F.transform("g", lambda x: x["eid"]), F.array().cast("array<int>"))))
    answered = F.col("out_kind") == "answer"
    text = F.when(empty, rules.REFUSE).when(answered, F.col("c.text")).otherwise(F.col("guarded"))
    notices = F.when(empty, _strings()).otherwise(F.col("meta.notices"))
    used = F.when(answered, F.transform("c.used", lambda n: F.get(F.filter("g", lambda x: x["eid"] == n), F.lit(0))["e"].dropFields("text")))
    state = state.select("session_id", F.col("focus").alias("old_focus"))
    plan = F.struct("standalone_query", F.col("mentions").alias("entity_mentions"))
    rows = rows.join(state, "session_id", "left").withColumn("next", sessions.next_state(F.col("old_focus"), F.col("out_kind"), F.col("entity_ids"), F.col("candidate_ids"), plan))
    return rows.select(
        "request_id", "session_id", "question", F.col("out_kind").alias("kind"), answers.with_notices(text, notices).alias("answer"), notices.alias("notices"), F.col("hits").alias("guard_hits"),
        F.when(answered, F.transform("g", lambda x: x["e"])).alias("evidence"), used.alias("sources"), plan.alias("plan"), F.col("next.focus").alias("focus"), F.col("next.pending").alias("pending"),
    )


def answer_records(turns: DataFrame, replies: DataFrame, normal: Callable[[Column], Column], guard: answers.Guard = answers.Guard()) -> DataFrame:
    """Evaluation records: turns (request_id, id, turn, category, q, expect, gold, must_include, must_not_include) against replies of ask().

    Turns without a reply are errors.
    """
    rows = turns.join(replies.drop("question"), "request_id", "left")
    reply = F.coalesce("answer", F.lit(""))
    quotes = rows.select("request_id", F.explode("gold").alias("gold")).select("request_id", F.col("gold.file").alias("file_name"), normal(F.col("gold.quote")).alias("quote"))
    shown = rows.select("request_id", F.explode("evidence").alias("e")).select("request_id", "e.file_name", normal(F.col("e.text")).alias("plain"))
    met = shown.join(quotes, ["request_id", "file_name"]).where(F.col("plain").contains(F.col("quote"))).select("request_id").distinct().withColumn("_met", F.lit(True))
    rows = rows.join(met, "request_id", "left")
    files = F.transform("gold", lambda g: g["file"])
    cited = F.coalesce(F.transform("sources", lambda s: s["file_name"]), _strings())
    kind = F.coalesce("kind", F.lit("error"))
    return rows.select(
        "id", "turn", "category", F.col("q").alias("query"), "expect", kind.alias("kind"), F.coalesce(kind == F.col("expect"), F.lit(False)).alias("behavior_ok"),
        F.when(F.size("must_include") > 0, F.forall("must_include", lambda m: reply.contains(m))).alias("include_ok"),
        answers.excluded(reply, F.col("must_not_include"), guard).alias("exclude_hits"), answers.violations(reply, F.col("q"), guard).alias("guard_violations"),
        F.when(F.size("gold") > 0, F.coalesce("_met", F.lit(False))).alias("evidence_hit"), evaluation.cited_gold(files, kind, cited).alias("cited_gold_file"),
        F.when(F.col("kind").isNull(), "no reply").alias("error"), reply.alias("answer"),
    )


def numbered_history(messages: DataFrame) -> DataFrame:
    """session_id, history of the last turns, for a planner."""
    return sessions.history_text(sessions.last_turns(messages))
