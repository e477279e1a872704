"""A stored index for dense search: vectors in inverted lists by cell, searched cell by cell for a table of queries.

Centroids are fitted on a bounded sample. Every vector lies in the list of its nearest centroid; lists are stored in
blocks of bounded size, so that a cell that holds a third of all vectors is many blocks. A query goes to the blocks of
its nearest cells, is scored there against all their vectors by matrix products, and keeps its best of each block.
Queries stay a table: neither they nor vectors pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.session import staged

#: Numbers in the sample that centroids are fitted on (vectors times dimensions), and cells at most.
SAMPLE_VALUES, MOST_CELLS = 1 << 22, 4096
#: Vectors of the sample a cell has at least, cells of a bin, rounds of fitting, and queries that probes are set on.
PER_CELL, PER_BIN, ROUNDS, TRIED = 16, 64, 8, 256
#: Share of the sample's nearest neighbours that probes must reach.
TARGET = 0.94
#: Vectors of a block and queries that meet it at once, and products that are held at once.
BLOCK, ASKED, AT_ONCE = 4096, 4096, 1 << 21
#: Places of scores: sums of equal vectors may differ beyond, by where they stand in a matrix.
PLACES = 12


def best_of(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller key."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((keys[some], -scores[some]))[:k]]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def block_scores(asked: DataFrame, rows: DataFrame, k: int, on: list[str]) -> DataFrame:
    """query_id, chunk_id, score: the k best rows of each query among those in its cells, in groups that share the keys in on.

    asked: query_id, dense, cells and on; rows: chunk_id, dense, cell and on. Groups must be of bounded size on either side.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, "chunk_id"))]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found, points = [], [], []
        if left.num_rows and right.num_rows:
            queries, vectors = _matrix(left["dense"]), _matrix(right["dense"])
            place = np.empty(len(vectors), np.int64)
            place[np.argsort(np.array(right["chunk_id"].to_pylist(), object), kind="stable")] = np.arange(len(vectors))
            wanted = left["cells"].combine_chunks()
            asker, cell = np.repeat(np.arange(len(queries)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
            home = right["cell"].to_numpy()
            step = max(1, AT_ONCE // len(vectors))
            for at in range(0, len(queries), step):
                scores = np.full((min(step, len(queries) - at), len(vectors)), -np.inf)
                here = (asker >= at) & (asker < at + step)
                for c in np.unique(home).tolist():
                    some, own = asker[here & (cell == c)] - at, np.flatnonzero(home == c)
                    scores[some[:, None], own] = np.round(queries[some + at] @ vectors[own].T, PLACES)
                for n, line in enumerate(scores, at):
                    seen = np.flatnonzero(line > -np.inf)
                    best = seen[best_of(place[seen], line[seen], k)]
                    ids.append(np.full(len(best), n))
                    found.append(best)
                    points.append(line[best])
        taken = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (ids, found)]
        score = pa.array(np.concatenate(points) if points else np.zeros(0))
        return pa.table([left["query_id"].take(pa.array(taken[0])), right["chunk_id"].take(pa.array(taken[1])), score], names=["query_id", "chunk_id", "score"])

    both = asked.select("query_id", "dense", "cells", *on).groupBy(*on).cogroup(rows.select("chunk_id", "dense", "cell", *on).groupBy(*on))
    return both.applyInArrow(scored, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and its inner product, some vectors at a time."""
    homes, close = [], []
    for at in range(0, len(vectors), 4096):
        near = vectors[at : at + 4096] @ centres.T
        homes.append(near.argmax(axis=1))
        close.append(near.max(axis=1))
    return np.concatenate(homes), np.concatenate(close)


def fitted(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of vectors, by rounds of assignment; a centroid without vectors takes the worst served one."""
    rng = np.random.default_rng(1)
    vectors = vectors.astype(np.float32)
    centres = vectors[rng.choice(len(vectors), cells, replace=False)]
    for _ in range(ROUNDS):
        home, close = nearest(vectors, centres)
        order, worst = np.argsort(home, kind="stable"), iter(np.argsort(close).tolist())
        used, begin = np.unique(home[order], return_index=True)
        sums = np.zeros_like(centres)
        sums[used] = np.add.reduceat(vectors[order], begin, axis=0)
        for empty in np.setdiff1d(np.arange(cells), used):
            sums[empty] = vectors[next(worst)]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(size > 0, size, 1)
    return centres.astype(np.float64)


def enough_probes(vectors: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """How many cells a query must probe so that TARGET of the nearest neighbours of some of the vectors are found.

    Neighbours in a sample are further off than in the whole table, so that the whole finds more.
    """
    asked, n = vectors[:TRIED], min(TRIED, len(vectors))
    if len(vectors) < 2:
        return 1
    near = asked @ vectors.T
    near[np.arange(n), np.arange(n)] = -np.inf
    found = np.argsort(-near, axis=1)[:, : min(k, len(vectors) - 1)]
    order = np.argsort(-(asked @ centres.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centres))[None].repeat(n, axis=0), axis=1)
    home, _ = nearest(vectors, centres)
    return int(np.quantile(np.take_along_axis(rank, home[found], axis=1), TARGET, method="higher")) + 1


def _nearest_cells(rows: DataFrame, centres: np.ndarray, n: int, bins: np.ndarray | None = None) -> DataFrame:
    """rows with column cell, the nearest centroid of column dense; with bins: with columns bin and cells, the n nearest by bin."""
    at, names = rows.columns.index("dense"), [*rows.columns, "cell" if bins is None else "to"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    to = pa.list_(pa.struct([("bin", pa.int32()), ("cells", pa.list_(pa.int32()))]))

    def by_bin(cells: np.ndarray) -> list[dict]:
        of = bins[cells]
        return [{"bin": int(b), "cells": cells[of == b].tolist()} for b in np.unique(of)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                near = np.array(part.column(at).to_pylist(), np.float64) @ centres.T
                if bins is None:
                    added = pa.array(near.argmax(axis=1).astype(np.int32))
                else:
                    added = pa.array([by_bin(c) for c in np.argsort(-near, axis=1, kind="stable")[:, :n]], to)
                yield pa.RecordBatch.from_arrays([*part.columns, added], names=names)

    if bins is None:
        return rows.mapInArrow(run, f"{fields}, cell int")
    return rows.mapInArrow(run, f"{fields}, to array<struct<bin:int,cells:array<int>>>").select("*", F.inline("to")).drop("to")


def _of(values: list[int], key: str) -> Column:
    """The entry of a list of at most MOST_CELLS numbers at column key."""
    return F.get(F.array(*map(F.lit, values)), F.col(key))


@dataclass
class DenseIndex:
    """An index at a path: its centroids (at most MOST_CELLS), the bin of each, blocks a bin, and how many cells a query probes.

    Cells that lie close share a bin, so that a query travels once to a bin, however many of its cells it probes.
    """

    spark: SparkSession
    path: str
    centres: np.ndarray
    bins: np.ndarray
    blocks: list[int]
    total: int
    probes: int

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int | None = None) -> DenseIndex:
        """Index the rows of chunks (chunk_id, dense and whatever filters will ask for) at path, which must be new.

        Rows without a vector are left out; an empty table gives an empty index. The sample is of rows with small
        hashes of chunk_id, of SAMPLE_VALUES numbers at most, whatever the table's size.
        """
        spark = chunks.sparkSession
        rows = chunks.where("dense is not null")
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("dense")).alias("d")).first()
        dims = size.d or 1
        room = max(1, SAMPLE_VALUES // dims)
        share = min(1.0, room / max(1, size.n))
        some = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("dense").limit(2 * room).toArrow()
        vectors = _matrix(some["dense"]) if some.num_rows else np.zeros((1, dims))
        n = min(cells or MOST_CELLS, MOST_CELLS, max(1, len(vectors) // PER_CELL))
        centres = fitted(vectors, n)
        bins, _ = nearest(centres, fitted(centres, ceil(n / PER_BIN)))
        placed, _ = staged(_nearest_cells(rows, centres, 1).withColumn("bin", _of(bins.tolist(), "cell")), "dense-cells")
        counts = {r.bin: r["count"] for r in placed.groupBy("bin").count().collect()}
        blocks = [ceil(counts.get(b, 0) / BLOCK) for b in range(int(bins.max()) + 1)]
        placed = placed.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.greatest(_of(blocks, "bin"), F.lit(1))).cast("int"))
        placed.repartition("bin", "block").sortWithinPartitions("bin", "block", "cell").write.parquet(f"{path}/rows")
        about = [(c, v.tolist(), int(b), blocks[b], enough_probes(vectors, centres) if c == 0 else 0, size.n) for c, (v, b) in enumerate(zip(centres, bins, strict=True))]
        spark.createDataFrame(about, "cell int, centre array<double>, bin int, blocks int, probes int, total bigint").coalesce(1).write.parquet(f"{path}/cells")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DenseIndex:
        rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
        of = {r.bin: r.blocks for r in rows}
        return cls(spark, path, np.array([r.centre for r in rows]), np.array([r.bin for r in rows]), [of.get(b, 0) for b in range(max(of) + 1)], rows[0].total, rows[0].probes)

    def search(self, queries: DataFrame, k: int = rules.CANDIDATES, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank by inner product of the vectors in the cells that a query probes.

        where restricts what is scored, inside the probed blocks. A query that finds fewer than k rows, because its
        cells are small or the filter narrow, probes four times as many cells, at last all: it has fewer hits than k
        only where no more rows fit. Queries without a vector have no hits; ids of queries must be distinct.
        """
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if not self.total:
            queries = queries.where("false")
        rows, fit = (rows, self.total) if where is None else (rows.where(where), None)
        asked, n, whole = queries.where("dense is not null").select("query_id", "dense"), probes or self.probes, None
        while True:
            asked, _ = staged(asked, "dense-asked")
            found, _ = staged(ranked(self._scored(asked, rows, min(n, len(self.centres)), k), k), "dense-found")
            if n >= len(self.centres):
                return found if whole is None else whole.unionByName(found)
            fit = rows.count() if fit is None else fit
            full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, fit)).select("query_id")
            done = found.join(full, "query_id", "left_semi").select(*found.columns)
            whole = done if whole is None else whole.unionByName(done)
            asked = asked.join(full, "query_id", "left_anti")
            if asked.isEmpty():
                return whole
            n *= 4

    def routed(self, asked: DataFrame, probes: int) -> DataFrame:
        """query_id, dense, bin, cells: where each query goes."""
        return _nearest_cells(asked, self.centres, probes, self.bins)

    def _scored(self, asked: DataFrame, rows: DataFrame, probes: int, k: int) -> DataFrame:
        """Scores in the probed cells; a bin that very many queries go to meets them in parts."""
        to, _ = staged(self.routed(asked, probes), "dense-routes")
        counts = {r.bin: r["count"] for r in to.groupBy("bin").count().collect()}
        parts = _of([ceil(counts.get(b, 0) / ASKED) for b in range(len(self.blocks))], "bin")
        steps = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
        to = to.withColumn("part", F.pmod(F.xxhash64("query_id"), F.greatest(parts, F.lit(1))).cast("int")).withColumn("block", steps(_of(self.blocks, "bin")))
        return block_scores(to, rows.withColumn("part", steps(parts)), k, ["bin", "block", "part"])
