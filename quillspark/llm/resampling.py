"""Target-distribution importance resampling over a stored sparse count matrix.

The document-by-bucket counts of hashed features are written as CSR blocks, a row of the table a block. Column sums
of the blocks of the corpus and of the target give two distributions; a bucket's gain is the scaled logarithm of
their ratio; a sparse matrix-vector product of blocks and gains gives each document's weight, and Gumbel noise by a
hash of the identifier turns weights into a draw without replacement.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import staged

#: Words of lower-cased UTF-8: digits, a-z and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A block ends after so many features or documents; a longer text is a block of its own. Blocks of a file: a reader
#: holds all of them, and a task as many files as fit in a partition, with their cells still compressed.
BLOCK_FEATURES, BLOCK_DOCS, FILE_BLOCKS = 1 << 16, 1024, 64
#: Hashes of features that a task remembers.
REMEMBERED = 1 << 17


class _Buckets(dict):
    """The bucket of a feature, remembered."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = crc32(feature) % self.buckets
        return found


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def features(found: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to longest words, joined by one space."""
    out = list(found)
    for n in range(2, longest + 1):
        out += [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
    return out


def count_matrix(df: DataFrame, id_col: str, text_col: str, buckets: int, longest: int = 1) -> DataFrame:
    """CSR blocks of the counts of features: ids, words (a document), starts, cells (columns, then counts); stored and read back.

    Null texts are empty rows of the matrix. Blocks are cut by numbers of features, so a task holds one block and one
    text at most; a lost block is counted anew from its own rows. Cells are compressed by block and only unpacked block by
    block, as Spark's readers and Arrow batches hold thousands of rows at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, ids, sizes, lengths, flat = _Buckets(buckets), [], [], [], []
        kind = None

        def block() -> pa.RecordBatch:
            row = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
            cells, counts = np.unique(row * buckets + np.array(flat, np.int64), return_counts=True)
            starts = np.searchsorted(cells, np.arange(len(ids) + 1, dtype=np.int64) * buckets)
            packed = pa.compress(np.concatenate([cells % buckets, counts]).astype("<i4").tobytes(), codec="zstd", asbytes=True)
            parts = [pa.array([ids], pa.list_(kind)), *(pa.array([a.astype(np.int64)], pa.list_(pa.int64())) for a in (np.array(sizes), starts)), pa.array([packed], pa.binary())]
            for some in (ids, sizes, lengths, flat):
                some.clear()
            return pa.RecordBatch.from_arrays(parts, names=["ids", "words", "starts", "cells"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = words(text.as_py())
                every = features(own, longest) if longest > 1 else own
                ids.append(i)
                sizes.append(len(own))
                lengths.append(len(every))
                flat.extend(map(bucket_of.__getitem__, every))
                if len(flat) >= BLOCK_FEATURES or len(ids) >= BLOCK_DOCS:
                    yield block()
        if ids:
            yield block()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    blocks = rows.mapInArrow(run, f"ids array<{kind}>, words array<bigint>, starts array<bigint>, cells binary")
    return staged(blocks, "csr", rows=FILE_BLOCKS)[0]


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """starts, columns and counts of each block of a batch."""
    at, packed = batch.schema.get_field_index("starts"), batch.schema.get_field_index("cells")
    for k in range(batch.num_rows):
        starts = batch.column(at)[k].values.to_numpy()
        n = int(starts[-1])
        flat = np.frombuffer(pa.decompress(batch.column(packed)[k].as_buffer(), decompressed_size=8 * n, codec="zstd") if n else b"", "<i4")
        yield starts, flat[:n], flat[n:].astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """The sum of each column of the matrix; as many numbers as there are buckets come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, columns, counts in _cells(batch):
                np.add.at(total, columns, counts)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in blocks.select("starts", "cells").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the ratio of the smoothed shares of target and corpus in each bucket, floored."""
    m, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    one = lambda s, t: floor(1000 * log((float(t) + 1) * float(all_s + m) / ((float(s) + 1) * float(all_t + m))))
    return np.array([one(s, t) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray, id_col: str) -> DataFrame:
    """id_col, n_words, n_features, weight: the floored mean of the gains of each document's features (none: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (at, columns, n) in enumerate(_cells(batch)):
                ids, sizes = (batch.column(c)[k].values for c in range(2))
                ends = lambda v, at=at: np.concatenate(([0], np.cumsum(v)))[at]
                held, sums = np.diff(ends(n)), np.diff(ends(n * gain[columns]))
                mean = np.where(held > 0, sums // np.maximum(held, 1), 0)
                yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(held), pa.array(mean)], names=[id_col, "n_words", "n_features", "weight"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_col: Column, seed: int) -> Column:
    """1000 times Gumbel noise, floored, by the first 32 bits of SHA-256 of ``<seed>:<id>``; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(share))).cast("bigint")


def resample(df: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_features, weight, score, rank of every row of df: a draw of percent of 100 of the rows with at least least_words words.

    Features are runs of 1 to longest words of whole texts, hashed to buckets; target has a column text_col. rank
    counts from 1 by score, then id, for rows that are drawn, null for others. Null texts have no words, weight 0 and
    are never drawn; null ids come after others of their score; rows that repeat id and text stand side by side in
    any order. An empty table gives no rows, an empty target flat gains. Other columns are ignored, whatever their names.
    A very long text is a block of its own in one task.

    Scores are whole numbers between about -95,000 and 115,000, so counts by score are a small table: it tells where
    the draw ends and how many rank before each score. Only drawn rows are sorted, score by score.
    """
    held = count_matrix(df, id_col, text_col, buckets, longest)
    wanted = count_matrix(target.select(F.lit(0).alias("_id"), text_col), "_id", text_col, buckets, longest)
    gain = gains(column_sums(held, buckets), column_sums(wanted, buckets))
    scored = weights(held, gain, "_id").withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed))
    scored, _ = staged(scored, "resampling")
    fit = F.col("n_words") >= least_words
    counted = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    counted, _ = staged(counted, "resampling-scores")
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    draw = (counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n * percent) // 100
    ahead = counted.select("score", before.alias("before")).where(F.col("before") < draw)
    last = ahead.agg(F.min("score").alias("s")).first().s
    drawn = fit & (F.col("score") >= last) if last is not None else F.lit(False)
    order = Window.partitionBy("score").orderBy(F.col("_id").asc_nulls_last(), "n_features", "weight")
    ranked = scored.where(drawn).join(F.broadcast(ahead), "score").withColumn("rank", F.col("before") + F.row_number().over(order))
    columns = [F.col("_id").alias(id_col), "n_features", "weight", "score"]
    in_draw = ranked.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).cast("bigint").alias("rank"))
    return in_draw.unionByName(scored.where(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank")))
