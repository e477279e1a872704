"""Exact dedup by content sort, DataFrame operations only.

Sampled splitters range-partition the normalised text, an external sort inside each range places
equal texts side by side, and each row is compared in full with its neighbour. Of equal texts the
row with the smallest identifier stays.

A text so frequent that it spans whole ranges is split by identifier over several of them; the
pieces of such groups, at most one group per splitter, are stitched afterwards.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import partitions, staged

#: Rows sampled per range, and characters of a text that a splitter keeps before its digest.
SAMPLE_PER_RANGE, SPLITTER_CHARS, SEED = 64, 64, 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def range_of(key: Column, splitters: list[Column]) -> Column:
    """How many of the ascending splitters are at or below key, by a two-level search."""
    if not splitters:
        return F.lit(0)
    step = ceil(sqrt(len(splitters)))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    heads = F.array(*[b[0] for b in blocks])
    block = F.size(F.filter(heads, lambda s: s <= key))
    inner = F.get(F.array(*[F.array(*b) for b in blocks]), block - 1)
    return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(inner, lambda s: s <= key)))


def _splitters(rows: DataFrame, ranges: int) -> tuple[list[Column], list[str]]:
    """At most ranges - 1 ascending keys, and digests of the texts that more than one of them falls in."""
    share = min(1.0, SAMPLE_PER_RANGE * ranges / max(1, rows.count()))
    if ranges < 2:
        return [], []
    sample = rows.where(F.rand(SEED) < share)  # of rows, whatever ids or texts they repeat; splitters decide no result
    order = Window.orderBy("_k")
    at = sample.select("_k", F.row_number().over(order).alias("_n"), F.count("*").over(Window.partitionBy()).alias("_of"))
    step = F.greatest(F.lit(1), (F.col("_of") / ranges).cast("long"))
    keys = at.where((F.col("_n") % step == 0)).select("_k.*").orderBy("p", "h", "o", "i").limit(2 * ranges).collect()
    seen: dict[str, int] = {}
    for k in keys:
        seen[k.h] = seen.get(k.h, 0) + 1
    out, begun = [], set()
    kind = rows.schema["_id"].dataType
    for k in keys:
        first = k.h not in begun
        begun.add(k.h)
        # A group begins a range of its own; only a group that several splitters fall in is cut inside.
        o, i = (None, None) if first else (k.o, k.i)
        out.append(F.struct(F.lit(k.p).alias("p"), F.lit(k.h).alias("h"), F.lit(o).cast("boolean").alias("o"), F.lit(i).cast(kind).alias("i")))
    return out, [h for h, n in seen.items() if n > 1]


def _marked(df: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """_id, _h, _b, _first (of its run in its range), _lead (o, i, b of the row that stays), _size; whole: and _row."""
    spark = df.sparkSession
    ranges = partitions(spark)
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")] if whole else []
    also = ["_row"] if whole else []
    rows = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_t"), *row)
    rows = rows.withColumn("_h", F.sha2("_t", 256))
    rows = rows.withColumn("_k", F.struct(F.substring("_t", 1, SPLITTER_CHARS).alias("p"), F.col("_h").alias("h"), F.col("_id").isNull().alias("o"), F.col("_id").alias("i")))
    splitters, cut = _splitters(rows, ranges)
    placed = rows.withColumn("_b", range_of(F.col("_k"), splitters)).drop("_k")
    placed = placed.repartitionById(len(splitters) + 1, F.col("_b").cast("int"))
    sort = Window.partitionBy("_b").orderBy("_t", F.col("_id").asc_nulls_last())
    found = placed.select(
        "_id", "_h", "_b", *also,
        F.coalesce(F.lag("_t").over(sort) != F.col("_t"), F.lit(True)).alias("_first"),
        F.row_number().over(sort).alias("_n"),
    )
    within = Window.partitionBy("_b").orderBy("_n")
    found = found.withColumn("_run", F.max(F.when(F.col("_first"), F.col("_n"))).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("_b", "_run")
    lead = F.struct(F.col("_id").isNull().alias("o"), F.col("_id").alias("i"), F.col("_b").alias("b"))
    found = found.select("_id", "_h", "_b", *also, "_first", F.min(lead).over(group).alias("_lead"), F.count("*").over(group).alias("_size"))
    if cut:
        found, _ = staged(found, "content-sort")
        # One row per cut group: fewer than there are splitters.
        joint = found.where(F.col("_h").isin(cut)).groupBy("_h").agg(F.min("_lead").alias("_lead2"), F.count("*").alias("_size2"))
        found = found.join(F.broadcast(joint), "_h", "left").select(
            "_id", "_h", "_b", *also, "_first", F.coalesce("_lead2", "_lead").alias("_lead"), F.coalesce("_size2", "_size").alias("_size")
        )
    # Null-safe: a plain equality would push a null test of the range, and with it the range search, to the scan.
    return found.withColumn("_kept", F.col("_first") & F.col("_b").eqNullSafe(F.col("_lead.b")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` becomes one space; null
    counts as empty. Rows with a null id sort last, so that they stay only where a group has no other.
    Of rows that repeat both id and text, exactly one is kept. An empty table gives an empty result.
    Very long texts are sorted and compared whole. Other columns of df are ignored, whatever their names.
    """
    return _marked(df, id_col, text_col, whole=False).select(
        F.col("_id").alias(id_col),
        F.col("_lead.i").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_h").alias("text_sha256"),
    )


def distinct_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns; rows travel with their texts, once."""
    return _marked(df, id_col, text_col, whole=True).where("_kept").select("_row.*")
