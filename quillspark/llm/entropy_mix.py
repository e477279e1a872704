"""Mixing sources to target weights by entropy balancing.

The mix closest to the corpus in relative entropy, token by token, that meets a token constraint for each
source has exponentially tilted document rates: a document's base rate times exp(dual of its source), none
above a cap. Newton iterations solve the convex dual; each sums over all documents in Spark and moves one dual
per source, inside a bracket, since a document that reaches the cap bends its source's sum. Where all base
rates are equal, as without a column of them, a source's documents share one rate, target / source size, and
the iterations only confirm it. Rates then become copies: documents fold in descending size within blocks of a
source, each carrying its rounding error to the next, smaller one, so that a block ends within about its
smallest document.
"""

from __future__ import annotations

from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import dropped, staged

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Newton stops at this relative error of the constraints; documents in a rounding block, about.
#: FAR is where no dual is.
PRECISION, ROUNDS, BLOCK, FAR = 1e-10, 60, 4096, 60.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target to sources (s, source_size, docs), one row a source: weights in turn by code point, null last.

    The windows without a partition order one row a source, never documents. Filling up from the source that its cap binds first: with the k tightest at their caps, the others
    share the rest by weight; the smallest k at which none is above its cap holds.
    """
    number = F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())) - 1
    rows = sources.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod(number, F.lit(len(weights)))))
    rows = rows.withColumn("top", F.col("source_size") * cap)
    everything = Window.partitionBy()
    tight = Window.orderBy(F.col("top") / F.col("w"), F.col("s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("total"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(tight), F.lit(0.0))).alias("rest_w"),
        F.coalesce(F.sum("top").over(tight), F.lit(0.0)).alias("full"),
    )
    level = (F.col("total") - F.col("full")) / F.col("rest_w")
    rows = rows.withColumn("level", F.min(F.when(F.col("top") / F.col("w") >= level, F.struct("full", level.alias("at")))).over(everything)["at"])
    return rows.select("s", "source_size", "docs", F.least("top", F.coalesce(F.col("level") * F.col("w"), F.col("top"))).alias("target"))


def _rate(cap: float) -> Column:
    return F.least(F.col("base") * F.exp("dual"), F.lit(cap))


def duals(docs: DataFrame, goal: DataFrame, cap: float = CAP) -> DataFrame:
    """goal with dual, by Newton from 0, of documents (s, size, base): their rates base * exp(dual), up to cap, meet the targets.

    Documents without words or with base 0 do not count. A target beyond what the caps allow is met as far as they do.
    """
    # Documents of one source and base rate have one rate: their sizes, summed once, stand for them.
    mass, _ = staged(docs.where("size > 0 and base > 0").groupBy("s", "base").agg(F.sum("size").alias("m")), "mass")
    begin = goal.withColumns({"dual": F.lit(0.0), "low": F.lit(-FAR), "high": F.lit(FAR)})
    state, path = staged(begin, "duals")
    for _ in range(ROUNDS):
        now = mass.join(state.select(F.col("s").alias("_s"), "dual"), F.col("s").eqNullSafe(F.col("_s")))
        # Whole masses of one rate are summed before they are weighed: sums do not depend on their order.
        now = now.select("s", _rate(cap).alias("r"), "m").groupBy("s", "r").agg(F.sum("m").alias("m"))
        taken = now.groupBy(F.col("s").alias("_s")).agg(F.sum(F.col("m") * F.col("r")).alias("f"), F.sum(F.when(F.col("r") < cap, F.col("m") * F.col("r"))).alias("slope"))
        moved = state.join(taken, F.col("s").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("target") - F.col("f")
        moved = moved.withColumns({"low": F.when(gap > 0, F.col("dual")).otherwise(F.col("low")), "high": F.when(gap < 0, F.col("dual")).otherwise(F.col("high"))})
        next_dual = F.col("dual") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gap / F.col("slope")))
        middle = (F.col("low") + F.col("high")) / 2
        inside = (next_dual > F.col("low")) & (next_dual < F.col("high"))
        # With all at the cap only a way down is left.
        off = F.coalesce((F.abs(gap) > F.col("target") * PRECISION) & (F.col("slope").isNotNull() | (gap < 0)), F.lit(False))
        dual = F.when(~off, F.col("dual")).when(inside, next_dual).otherwise(middle)
        before = path
        state, path = staged(moved.select(*goal.columns, dual.alias("dual"), "low", "high", off.alias("off")), "duals")
        dropped(docs.sparkSession, before)
        if state.where("off").isEmpty():
            break
    return state.select(*goal.columns, "dual")


def _round(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["size", "h", "_id"], ascending=[False, True, True], kind="stable")
    carried, copies = 0.0, []
    for size, rate in zip(block["size"].tolist(), block["rate"].tolist(), strict=True):
        if size == 0:
            copies.append(floor(rate + 0.5))
            continue
        low = floor(rate)
        high = low if rate == low else low + 1
        due = rate * size + carried
        n = min(max(floor(due / size + 0.5), low), high)
        carried = due - n * size
        copies.append(n)
    return block.assign(copies=copies)[["_id", "s", "size", "copies"]]


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, base_col: str | None = None
) -> DataFrame:
    """id_col, size, source_size, target, taken and copies for every row of df.

    size counts the words of the whole text (null: 0); a null source is a source. base_col, if any, has rates that
    the mix shall stay close to, 0 or more (null: 1); without it all are 1. copies is 0, 1 or up to cap; a text
    without words gets the copies of its rounded rate and takes nothing. Rows that repeat an id are rounded as
    rows of their own. An empty table gives no rows; one without words has targets 0. Other columns are ignored.
    Reruns agree: sums are of whole numbers, and rows of a block are ordered by size, hash and id.
    """
    kind = df.schema[id_col].dataType.simpleString()
    base = F.coalesce(F.greatest(F.col(base_col).cast("double"), F.lit(0.0)), F.lit(1.0)) if base_col else F.lit(1.0)
    docs, _ = staged(df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("s"), words(F.col(text_col)).alias("size"), base.alias("base")), "sizes")
    sources = docs.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal, _ = staged(duals(docs, targets(sources, weights, share, cap), cap), "rates")
    of = goal.select(F.col("s").alias("_s"), "dual", F.ceil(F.col("docs") / BLOCK).alias("blocks"))
    rated = docs.join(of, F.col("s").eqNullSafe(F.col("_s"))).withColumns({"h": F.xxhash64("_id", "size"), "rate": F.round(_rate(cap), 9)})
    rated = rated.withColumn("block", F.pmod("h", "blocks"))
    copied = rated.select("_id", "s", "size", "rate", "h", "block").groupBy("s", "block").applyInPandas(_round, f"_id {kind}, s string, size bigint, copies int")
    out = copied.join(goal.withColumnRenamed("s", "_s"), F.col("s").eqNullSafe(F.col("_s")))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
