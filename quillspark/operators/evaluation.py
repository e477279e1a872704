"""Evaluation: gold matching, ranks, retrieval and answer metrics, self-check of the questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules

REFUSALS = ("refuse", "realtime_notice")


def turns(items: DataFrame) -> DataFrame:
    """A row per turn: id, category, turn (from 1) and its fields; single-turn items lend theirs where the turn has none."""
    rows = items.select("id", "category", F.posexplode("turns").alias("at", "t"), "expect", "gold", "must_include", "must_not_include")
    rows = rows.where((F.col("category") == "multiturn") | (F.col("at") == 0))
    many = F.col("category") == "multiturn"
    lists = [F.when(many | (F.size(f"t.{c}") > 0), F.col(f"t.{c}")).otherwise(F.col(c)).alias(c) for c in ("gold", "must_include", "must_not_include")]
    expect = F.when(many, F.col("t.expect")).otherwise(F.coalesce("t.expect", "expect"))
    return rows.select("id", "category", (F.col("at") + 1).alias("turn"), F.col("t.q").alias("q"), expect.alias("expect"), *lists)


def followup_queries(rows: DataFrame, id_col: str = "id", turn_col: str = "turn", q_col: str = "q") -> DataFrame:
    """Adds query: all questions of the conversation up to this one, by spaces."""
    upto = Window.partitionBy(id_col).orderBy(turn_col).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("query", F.array_join(F.collect_list(q_col).over(upto), " "))


def first_ranks(hits: DataFrame, gold: DataFrame, key: str = "query_id") -> DataFrame:
    """key, rank, file_rank: the first rank whose normalised text holds a gold quote of its file, and whose file is gold.

    hits: key, rank, file_name, plain; gold: key, file, quote (normalised). Queries that never hit have nulls.
    """
    met = hits.join(gold.withColumnRenamed("file", "file_name"), [key, "file_name"])
    ranks = met.groupBy(key).agg(F.min(F.when(F.col("plain").contains(F.col("quote")), F.col("rank"))).alias("rank"), F.min("rank").alias("file_rank"))
    return gold.select(key).distinct().join(ranks, key, "left")


def retrieval_metrics(rank: str = "rank", levels: tuple = rules.HIT_LEVELS) -> list[Column]:
    """n, hit@k of each level and mrr@10 over ranks, null for a miss."""
    hit = lambda k: F.round(F.avg(F.coalesce((F.col(rank) <= k).cast("int"), F.lit(0))), 4)
    mrr = F.sum(F.when(F.col(rank) <= 10, 1.0 / F.col(rank)).otherwise(0.0)) / F.count("*")
    return [F.count("*").alias("n"), *[hit(k).alias(f"hit_{k}") for k in levels], F.round(mrr, 4).alias("mrr_10")]


def retrieval_summary(records: DataFrame) -> DataFrame:
    """Metrics by category (a conversation's first turn apart from what follows) and overall, by chunk and by file."""
    first = F.when(F.col("turn") == 1, "multiturn_t1").otherwise("multiturn_followup")
    rows = records.where("has_gold").withColumn("category", F.when(F.col("category") == "multiturn", first).otherwise(F.col("category")))
    levels = F.explode(F.array(F.struct(F.lit("chunk").alias("level"), F.col("rank").alias("r")), F.struct(F.lit("file").alias("level"), F.col("file_rank").alias("r"))))
    rows = rows.select("category", levels.alias("x")).select("category", "x.level", F.col("x.r").alias("rank"))
    return rows.rollup("level", "category").agg(*retrieval_metrics()).where("level is not null").withColumn("category", F.coalesce("category", F.lit("overall")))


def distribution(value: str) -> list[Column]:
    """n, least, p10, median, p90, most; a quantile q is the element at the whole part of q * (n - 1)."""
    rows = F.sort_array(F.collect_list(value))
    at = lambda q: F.get(rows, F.floor(F.lit(q) * (F.size(rows) - 1)).cast("int"))
    return [F.count(value).alias("n"), F.min(value).alias("min"), at(0.1).alias("p10"), F.median(value).alias("median"), at(0.9).alias("p90"), F.max(value).alias("max")]


def distribution_by_rank(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """distribution() without gathering a group in one row: distinct values with their counts, in order, then the
    ones at the wanted places. Rows are added up before they are shuffled."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value)
    placed = counted.select(*keys, value, "c", F.sum("c").over(order).alias("upto"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    at = lambda place: F.max(F.when((F.col("upto") - F.col("c") <= place) & (place < F.col("upto")), F.col(value)))
    last = F.col("n") - 1
    places = [at(F.floor(F.lit(q) * last)) for q in (0.1, 0.9)]
    middle = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("min"), places[0].alias("p10"), middle.alias("median"), places[1].alias("p90"), F.max(value).alias("max"))


def rate(value: Column) -> Column:
    """Share of true among what is not null, to four places; null without any."""
    return F.round(F.avg(value.cast("int")), 4)


def answer_summary(records: DataFrame) -> DataFrame:
    """One row of rates and counts over answer records; conversations passed come from chains_passed()."""
    refused = F.col("kind").isin(*REFUSALS)
    return records.agg(
        rate(F.col("behavior_ok")).alias("behavior_accuracy"),
        rate(F.when(F.col("expect").isin(*REFUSALS), refused)).alias("negative_refusal_rate"),
        rate(F.when(F.col("expect") == "answer", refused)).alias("false_refusal_rate"),
        rate(F.col("include_ok")).alias("must_include_pass_rate"),
        F.sum(F.size("exclude_hits")).cast("long").alias("must_not_include_violations"),
        F.sum(F.size("guard_violations")).cast("long").alias("guard_violations"),
        rate(F.col("evidence_hit")).alias("evidence_hit_rate"),
        rate(F.col("cited_gold_file")).alias("cited_gold_file_rate"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )


def behavior_by_category(records: DataFrame) -> DataFrame:
    return records.groupBy("category").agg(F.count("*").alias("n"), rate(F.col("behavior_ok")).alias("behavior_accuracy"))


def chains_passed(records: DataFrame) -> DataFrame:
    """passed, total of conversations whose every turn behaves and misses nothing that it must include."""
    chains = records.where("category = 'multiturn'").groupBy("id").agg(F.bool_and(F.col("behavior_ok") & F.coalesce("include_ok", F.lit(True))).alias("ok"))
    return chains.agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))


def cited_gold(gold_files: Column, kind: Column, source_files: Column) -> Column:
    """Whether an answer cites a gold file; null without gold or where it is no answer."""
    return F.when((F.size(gold_files) > 0) & (kind == "answer"), F.arrays_overlap(source_files, gold_files))


def self_check(items: DataFrame, corpus: DataFrame, normal: object) -> DataFrame:
    """(tag, error) of every fault of the items against corpus (file, plain), any number of rows a file; normal: the text
    normaliser. A quote, which has no white space once normalised, must stand in one of them."""
    many = F.col("category") == "multiturn"
    numbered = items.groupBy("id").agg(F.count("*").alias("n"))
    repeats = numbered.where("n > 1").select(F.col("id").alias("tag"), F.explode(F.array_repeat(F.lit("id repeated"), F.col("n").cast("int") - 1)).alias("error"))
    size = F.size("turns")
    shape = items.select(F.col("id").alias("tag"), F.when(~many & (size != 1), "one turn expected").when(many & (size < 2), "two turns expected").alias("error")).where("error is not null")
    rows = turns(items).withColumn("tag", F.concat_ws("#", "id", "turn"))
    missing = rows.where("expect is null").select("tag", F.lit("no expect").alias("error"))
    bare = rows.where((F.col("expect") == "answer") & (F.size("gold") == 0) & (F.col("category") != "compliance")).select("tag", F.lit("no gold").alias("error"))
    gold = rows.select("tag", F.posexplode("gold").alias("at", "g")).select("tag", "at", "g.file", normal(F.col("g.quote")).alias("plain_quote"))
    length = gold.where(~F.length("plain_quote").between(rules.QUOTE_LEAST, rules.QUOTE_MOST)).select("tag", F.concat(F.lit("quote length "), F.length("plain_quote")).alias("error"))
    held = gold.join(corpus, "file", "left").groupBy("tag", "at", "file").agg(F.count("plain").alias("n"), F.bool_or(F.col("plain").contains(F.col("plain_quote"))).alias("held"))
    absent = F.when(F.col("n") == 0, F.concat(F.lit("no file "), "file")).when(~F.col("held"), F.concat(F.lit("no quote in "), "file"))
    lost = held.select("tag", absent.alias("error")).where("error is not null")
    out = repeats
    for more in (shape, missing, bare, length, lost):
        out = out.unionByName(more)
    return out


def corpus(chunks: DataFrame, docs: DataFrame, normal: object) -> DataFrame:
    """(file, plain): the normalised text of each of a file's chunks."""
    return chunks.join(docs.select("doc_id", F.col("file_name").alias("file")), "doc_id").select("file", normal(F.col("text")).alias("plain"))
