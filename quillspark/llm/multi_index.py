"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after several rotations learned on a bounded sample (principal axes turned so that
signs lose least), 64 bits each. Codes are split into substrings, each with an index of its own. A query probes every
substring at all values within a few bits; by the pigeonhole principle no code within the radius
``substrings * (bits + 1) - 1`` is missed. What meets is cut by the Hamming distance of whole codes and ranked by the
vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import partitions, staged

#: Vectors that rotations, widths and thresholds are learned on: those of least hash of their identifiers.
SAMPLE = 8192
#: Rotations, bits that one may give, rounds of turning each, queries that widths are tried on.
ROTATIONS, WORD, ROUNDS, TRIED = 6, 64, 30, 128
#: Widths of substrings, widest first; the first that finds TARGET of the sample's neighbours is taken.
WIDTHS, BITS, TARGET = (16, 14, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1), 1, 0.98
#: Codes of a block and queries of a part, about; queries of a part that are looked up together.
BLOCK, ASKED, TOGETHER = 8192, 4096, 64
#: Columns of code words.
WORDS = [f"w{r}" for r in range(ROTATIONS)]


@dataclass
class Model:
    mean: np.ndarray
    turns: np.ndarray
    width: int
    bits: int
    sample: np.ndarray

    @property
    def used(self) -> int:
        """Bits of a word that are used."""
        return self.turns.shape[1] // ROTATIONS

    @property
    def per_word(self) -> int:
        return self.used // self.width

    @property
    def substrings(self) -> int:
        return ROTATIONS * self.per_word

    @property
    def radius(self) -> int:
        """Every code within so many bits of a query's is met."""
        return self.substrings * (min(self.bits, self.width) + 1) - 1

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A row of ROTATIONS words a vector."""
        signs = ((vectors - self.mean) @ self.turns > 0).reshape(len(vectors), ROTATIONS, self.used)
        padded = np.zeros((len(vectors), ROTATIONS, WORD), np.uint8)
        padded[:, :, : self.used] = signs
        return np.packbits(padded, axis=2, bitorder="little").view(np.uint64)[:, :, 0]

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The number of each substring, and its value, as one number a substring."""
        cut = (codes[:, :, None] >> np.arange(self.per_word, dtype=np.uint64) * np.uint64(self.width)) & np.uint64((1 << self.width) - 1)
        return cut.reshape(len(codes), -1).astype(np.int64) + (np.arange(self.substrings, dtype=np.int64) << self.width)

    def probes(self, codes: np.ndarray) -> np.ndarray:
        """The keys within bits of each substring of each code."""
        flips = [sum(1 << i for i in some) for n in range(min(self.bits, self.width) + 1) for some in combinations(range(self.width), n)]
        return (self.keys(codes)[:, :, None] ^ np.array(flips, np.int64)).reshape(len(codes), -1)


def _turned(rows: np.ndarray, seed: int) -> np.ndarray:
    """A rotation of the rows under which their signs are close to them."""
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(rows.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(rows.T @ np.where(rows @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return turn


def _distances(codes: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes[:, None, :] ^ others[None, :, :]).sum(axis=2, dtype=np.int32)


def fit(vectors: np.ndarray, k: int) -> Model:
    """A model of a sample: rotations, and the widest substrings whose probes find TARGET of the k nearest of some of the sample.

    Neighbours in a sample are further off than in the whole table, so that the whole finds more.
    """
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[: min(WORD, vectors.shape[1])].T
    turns = np.hstack([axes @ _turned(centred @ axes, seed) for seed in range(ROTATIONS)])
    model = Model(mean, turns, 1, BITS, np.zeros((0, ROTATIONS), np.uint64))
    model.sample = codes = model.codes(vectors)
    asked = vectors[:TRIED]
    apart = (asked**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1) - 2 * asked @ vectors.T
    apart[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(apart, axis=1)[:, : min(k, len(vectors) - 1)]
    for width in (w for w in WIDTHS if w <= model.used):
        model.width = width
        own = model.keys(codes)
        gap = np.bitwise_count(own[: len(asked), None, :] ^ own[near]) if near.size else np.zeros((1, 1, 1))
        if (gap.min(axis=2) <= BITS).mean() >= TARGET:
            break
    return model


def _valid(vector: Column) -> Column:
    """Whether no component is null or not finite, and some is not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _coded(rows: DataFrame, model: Model, room: int | None = None) -> DataFrame:
    """_id and code words w0.. of (_id, _v); with room also most, the Hamming distance within which about room of each are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                codes = model.codes(np.array(part.column(1).to_pylist(), np.float64))
                columns = [part.column(0), *(pa.array(codes[:, r].view(np.int64)) for r in range(ROTATIONS))]
                if room is not None:
                    held = len(model.sample)
                    far = np.partition(_distances(codes, model.sample), room - 1, axis=1)[:, room - 1] if room <= held else np.full(len(codes), WORD * ROTATIONS)
                    columns.append(pa.array(far.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", *WORDS, *(["most"] if room is not None else [])])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_v").mapInArrow(run, f"_id {kind}, {', '.join(f'{w} bigint' for w in WORDS)}" + (", most int" if room is not None else ""))


def _meetings(model: Model, asked: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in asked and in codes of those that meet in a substring, each pair once, some queries at a time.

    Each substring has an index of its own over the codes, which a query probes at all its values.
    """
    keys = model.keys(codes)
    orders = [np.argsort(keys[:, s], kind="stable") for s in range(model.substrings)]
    sorted_ = [keys[order, s] for s, order in enumerate(orders)]
    for at in range(0, len(asked), TOGETHER):
        probes = model.probes(asked[at : at + TOGETHER])
        n = len(probes)
        probes = probes.reshape(n, model.substrings, -1)
        met = np.zeros(n * len(codes), bool)
        for s, (order, values) in enumerate(zip(orders, sorted_, strict=True)):
            probe = probes[:, s].ravel()
            low = np.searchsorted(values, probe)
            count = np.searchsorted(values, probe, side="right") - low
            where = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            met[np.repeat(np.repeat(np.arange(n), probes.shape[2]) * len(codes), count) + order[where]] = True
        row, place = np.divmod(np.flatnonzero(met), len(codes))
        yield at + row, place


def _met(asked: DataFrame, held: DataFrame, model: Model, every: bool = False) -> DataFrame:
    """(query_id, _id) of codes that meet in a substring (or all, with every) and are within the query's Hamming distance; each pair once.

    Blocks of codes meet parts of the queries, a task a pair of them: as many rows are shuffled as there are codes a part and
    queries a block, and what meets is never a row before it is within the distance.
    """
    kind = held.schema["_id"].dataType.simpleString()
    blocks, parts = max(1, ceil(held.count() / BLOCK)), max(1, ceil(asked.count() / ASKED))
    dealt = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(each(blocks).alias("block"), dealt(parts).alias("part"), "_id", *WORDS, "most")
    right = held.select(dealt(blocks).alias("block"), each(parts).alias("part"), "_id", *WORDS)

    def pairs(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, c = (np.stack([t[w].to_numpy().view(np.uint64) for w in WORDS]) for t in (queries, rows))
        most = queries["most"].to_numpy()
        ids, others = queries["_id"].combine_chunks(), rows["_id"].combine_chunks()
        own = pc.index_in(ids, value_set=others).fill_null(-1).to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        all_pairs = ((np.full(c.shape[1], i), np.arange(c.shape[1])) for i in range(q.shape[1]))
        for i, j in (all_pairs if every else _meetings(model, q.T, c.T)) if len(ids) and len(others) else ():
            apart = np.zeros(len(i), np.int32)
            for r in range(ROTATIONS):
                apart += np.bitwise_count(q[r][i] ^ c[r][j])
            kept = (apart <= most[i]) & (j != own[i])
            found.append((i[kept], j[kept]))
        i, j = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in range(2))
        return pa.table([ids.take(pa.array(i)), others.take(pa.array(j))], names=["query_id", "_id"])

    n = partitions(held.sparkSession)
    left, right = (side.repartition(n, "block", "part").groupBy("block", "part") for side in (left, right))
    return left.cogroup(right).applyInArrow(pairs, f"query_id {kind}, _id {kind}")


def _ranked(pairs: DataFrame, held: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query's pairs by Euclidean distance in doubles, ties to the smaller id."""
    apart = lambda a, b: F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    asked = queries.select(F.col("_id").alias("query_id"), F.col("_v").alias("_q"))
    scored = pairs.join(held.select("_id", "_v"), "_id").join(asked, "query_id")
    scored = scored.select("query_id", "_id", F.sqrt(F.aggregate(apart(F.col("_q"), F.col("_v")), F.lit(0.0), lambda s, x: s + x)).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(df: DataFrame, queries: Column, k: int = 10, room: int = 600, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id_col, score: the k nearest found of each row that queries marks, by Euclidean distance.

    Vectors that are null or zero, or hold null or non-finite components, or are not of the commonest length (ties:
    the longest), and rows with a null id take no part; of rows that share an id the least vector does. Ties go to the
    smaller id. An empty table gives no rows; other columns are ignored.

    Every other vector is indexed; of equal vectors those of the k + 1 smallest ids, as none else can be among any k
    nearest. About room codes of least Hamming distance are ranked by their vectors; where the sample holds fewer than
    1 in room of all vectors, as many as the nearest of the sample is apart. Queries that meet fewer than k are
    compared with all vectors. The sample (SAMPLE vectors) is all that the driver sees.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.coalesce(queries, F.lit(False)).alias("_asked"))
    rows = rows.where(F.col("_id").isNotNull() & _valid(F.col("_v")))
    common = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = df.schema[id_col].dataType.simpleString()
    if common is None:
        return rows.select(F.col("_id").alias("query_id"), F.lit(0).alias("rank"), F.col("_id").alias(id_col), F.lit(0.0).alias("score"))
    rows, _ = staged(rows.where(F.size("_v") == common.d).groupBy("_id").agg(F.min("_v").alias("_v"), F.bool_or("_asked").alias("_asked")), "vectors")
    copies = Window.partitionBy("_v").orderBy("_id")
    held = rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).select("_id", "_v")
    held, _ = staged(held, "vectors-held")
    total = held.count()
    sample = held.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).collect()
    model = fit(np.array([r["_v"] for r in sample], np.float64), k)
    asked = rows.where("_asked")
    index, _ = staged(_coded(held, model), "codes")
    probes, _ = staged(_coded(asked, model, 1 + ceil(room * len(sample) / total)), "probes")
    found, _ = staged(_ranked(_met(probes, index, model), held, asked, k), "nearest")
    few = asked.join(found.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1)), F.col("_id") == F.col("query_id"), "left_anti").select("_id", "_v")
    few, _ = staged(few, "short-queries")
    if not few.isEmpty():
        all_pairs = _met(_coded(few, model, len(model.sample) + 1), index, model, every=True)
        rest, _ = staged(_ranked(all_pairs, held, few, k), "nearest-rest")
        found = found.join(few, F.col("query_id") == few["_id"], "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").cast(kind).alias(id_col), "score")
