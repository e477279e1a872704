"""A stored inverted index for sparse search: postings by term and block, with bounds that let searches skip blocks.

Chunks lie in blocks of bounded size, alike in their total weight, so that a few blocks hold the greatest scores. A
posting is a term's places and weights in one block, with the greatest and least weight; a term that all chunks have is
as many postings as there are blocks. A search adds up bounds from these heads, scores the most promising blocks of
each query, and then only those whose bound reaches the score of its k-th hit. Queries stay a table: neither they nor
postings pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.operators.dense_index import best_of, ranked
from quillspark.session import staged

#: Chunks of a block at least, and blocks of equal ones about at most; queries that meet a block at once.
BLOCK, MOST_BLOCKS, ASKED = 512, 8192, 4096
#: Weights of a block about at most: a task holds a block's.
WEIGHTS = 1 << 19
#: Blocks of a query that are scored first, and how far a bound may lie below a sum by rounding.
FIRST, SLACK = 2, 1e-9


def block_hits(asked: DataFrame, held: DataFrame, k: int, common: bool) -> DataFrame:
    """query_id, chunk_id, score: each query's k best chunks of each of its blocks.

    asked: block, part, query_id, term, weight; held: block, part and either term, places, weights of a posting, or
    places and chunk_ids of the chunks that may be found. Groups must be of bounded size.
    """
    kind, id_kind = asked.schema["query_id"].dataType.simpleString(), held.schema["chunk_ids"].dataType.elementType.simpleString()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        postings: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        places, ids = np.zeros(0, np.int64), pa.array([], right.schema.field("chunk_ids").type.value_type)
        for n, term in enumerate(right["term"].to_pylist()):
            at = right["places"][n].values.to_numpy()
            if term is None:
                places, ids = at, right["chunk_ids"][n].values
            else:
                postings[term] = at, right["weights"][n].values.to_numpy()
        size = 1 + max([int(a.max()) for a, _ in postings.values()] + [int(places.max(initial=0))], default=0)
        asker = left["query_id"].combine_chunks().dictionary_encode()
        queries, terms, weights = asker.indices.to_numpy(), left["term"].to_pylist(), left["weight"].to_numpy()
        order = np.argsort(queries, kind="stable")
        begin = np.searchsorted(queries[order], np.arange(len(asker.dictionary) + 1))
        out: list[list[np.ndarray]] = [[], [], []]
        for q in range(len(asker.dictionary)):
            total = np.zeros(size)
            for n in order[begin[q] : begin[q + 1]].tolist():
                if (held := postings.get(terms[n])) is not None:
                    total[held[0]] += 1.0 if common else weights[n] * held[1]
            score = total[places]
            some = np.flatnonzero(score > 0)
            best = some[best_of(places[some], score[some], k)]
            for column, values in zip(out, (np.full(len(best), q), best, score[best]), strict=True):
                column.append(values)
        q, at = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out[:2])
        points = np.concatenate(out[2]) if out[2] else np.zeros(0)
        return pa.table([asker.dictionary.take(pa.array(q)), ids.take(pa.array(at)), pa.array(points)], names=["query_id", "chunk_id", "score"])

    both = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part"))
    return both.applyInArrow(scored, f"query_id {kind}, chunk_id {id_kind}, score double")


def block_postings(rows: pa.Table) -> pa.Table:
    """The postings of one block of chunks (block, place, terms, weights); pairs with a null term or weight are left out."""
    lists, given = rows["terms"].combine_chunks(), pc.list_flatten(rows["weights"]).combine_chunks()
    coded = lists.flatten().dictionary_encode()
    place = np.repeat(rows["place"].to_numpy(), lists.value_lengths().to_numpy())
    valid = pc.and_(coded.is_valid(), given.is_valid()).to_numpy(zero_copy_only=False)
    term, weight, place = (x[valid] for x in (pc.fill_null(coded.indices, 0).to_numpy().astype(np.int64), given.to_numpy(zero_copy_only=False), place))
    order = np.argsort(term * (1 + place.max(initial=0)) + place)
    term, weight, place = term[order], weight[order], place[order]
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    stops = pa.array(np.append(begin, len(term)).astype(np.int32))
    greatest, least = (f.reduceat(weight, begin) if len(begin) else weight for f in (np.maximum, np.minimum))
    columns = {"term": coded.dictionary.take(pa.array(term[begin])), "block": np.repeat(rows["block"].to_numpy()[:1], len(begin)), "greatest": greatest, "least": least}
    return pa.table(columns | {"places": pa.ListArray.from_arrays(stops, pa.array(place.astype(np.int32))), "weights": pa.ListArray.from_arrays(stops, pa.array(weight))})


@dataclass
class TermIndex:
    """An index at a path: postings, and the chunks of each block with what filters ask for."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, weights: DataFrame, chunks: DataFrame, path: str) -> TermIndex:
        """Index weights (chunk_id, term, weight; a pair once) at path, which must be new; chunks (chunk_id, each once) has columns for filters.

        Rows with a null term or weight, and chunks without weights, are never found and left out.
        """
        rows = weights.where("term is not null and weight is not null").groupBy("chunk_id").agg(F.collect_list(F.struct("term", "weight")).alias("p"))
        return cls.of_lists(rows.select("chunk_id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights")), chunks, path)

    @classmethod
    def of_lists(cls, listed: DataFrame, chunks: DataFrame, path: str) -> TermIndex:
        """The same of listed (chunk_id, terms, weights: arrays of one length, a term once); lists of a repeated chunk_id are added up.

        Lists are shuffled once, to their block, whose postings are made in one task.
        """
        total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + F.coalesce(F.abs(w), F.lit(0.0)))
        band = F.floor(2 * F.log2(F.greatest(total, F.lit(1e-9)))).cast("int").alias("band")
        lists = listed.where("chunk_id is not null and size(terms) > 0").select("chunk_id", "terms", F.col("weights").cast("array<double>").alias("weights"))
        lists, _ = staged(lists.select("*", F.size("terms").alias("size"), band), "term-lists")
        again, _ = staged(lists.groupBy("chunk_id").count().where("count > 1").select("chunk_id"), "term-again")
        if not again.isEmpty():
            pairs = lists.join(again, "chunk_id", "left_semi").select("chunk_id", F.explode(F.arrays_zip("terms", "weights")).alias("p"))
            sums = pairs.groupBy("chunk_id", F.col("p.terms").alias("term")).agg(F.sum("p.weights").alias("weight"))
            sums = sums.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "weight")).alias("p")).select("chunk_id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))
            lists, _ = staged(lists.join(again, "chunk_id", "left_anti").unionByName(sums.select("*", F.size("terms").alias("size"), band)), "term-lists")
        counts = sorted(((r.band, r.n, r.size) for r in lists.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()), reverse=True)
        room = max(BLOCK, sum(n for _, n, _ in counts) // MOST_BLOCKS)
        begin, at = {}, 0
        for number, n, size in counts:
            begin[number] = (at, max(ceil(n / room), ceil(size / WEIGHTS)))
            at += begin[number][1]
        # At most about two thousand bands: a double has no more halved powers of two.
        known = F.broadcast(cls._table(listed.sparkSession, [(b, *x) for b, x in begin.items()], "band int, first int, parts int"))
        block = (F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).cast("int").alias("block")
        place = (F.row_number().over(Window.partitionBy("block").orderBy("chunk_id")) - 1).alias("place")
        placed, _ = staged(lists.join(known, "band").select("chunk_id", block).select("*", place), "term-places")
        rows = lists.join(known, "band").select("chunk_id", block, "terms", "weights").select("block", place, "terms", "weights")
        kind = listed.schema["terms"].dataType.elementType.simpleString()
        postings = rows.groupBy("block").applyInArrow(block_postings, f"term {kind}, block int, greatest double, least double, places array<int>, weights array<double>")
        postings.write.parquet(f"{path}/postings")
        chunks.join(placed, "chunk_id").repartition("block").sortWithinPartitions("block", "place").write.parquet(f"{path}/chunks")
        return cls(listed.sparkSession, path)

    @staticmethod
    def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema)

    def search(self, asked: DataFrame, k: int = rules.CANDIDATES, where: Column | None = None, common: bool = False) -> DataFrame:
        """query_id, chunk_id, score, rank by the sum over common terms of both weights, if above zero; exact.

        asked: query_id, term, weight, a pair once. With common the score is the number of common terms. where restricts
        which chunks are found. Queries without hits, and empty tables, give no rows.
        """
        asked, _ = staged(asked.where("term is not null and weight is not null").select("query_id", "term", F.col("weight").cast("double").alias("weight")), "term-asked")
        bounds, _ = staged(self.bounds(asked, common), "term-bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = bounds.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST).select("query_id", "block")
        first, _ = staged(first, "term-first")
        hits, _ = staged(ranked(self._scored(asked, first, k, where, common), k), "term-hits")
        rest, _ = staged(self.promising(bounds, first, hits, k), "term-rest")
        more = self._scored(asked, rest, k, where, common)
        return ranked(hits.select("query_id", "chunk_id", "score").unionByName(more), k)

    def bounds(self, asked: DataFrame, common: bool = False) -> DataFrame:
        """query_id, block, bound: no chunk of the block scores higher; blocks without a term of the query are left out."""
        heads = self.spark.read.parquet(f"{self.path}/postings").select("term", "block", "greatest", "least")
        most = F.lit(1.0) if common else F.greatest(F.col("weight") * F.col("greatest"), F.col("weight") * F.col("least"), F.lit(0.0))
        return heads.join(asked, "term").groupBy("query_id", "block").agg((F.sum(most) * (1 + SLACK)).alias("bound")).where("bound > 0")

    @staticmethod
    def promising(bounds: DataFrame, seen: DataFrame, hits: DataFrame, k: int) -> DataFrame:
        """(query_id, block) not seen whose bound reaches the k-th hit so far."""
        least = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        left = bounds.join(seen, ["query_id", "block"], "left_anti").join(least, "query_id", "left")
        return left.where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_id", "block")

    def _scored(self, asked: DataFrame, pairs: DataFrame, k: int, where: Column | None, common: bool) -> DataFrame:
        """Hits of the pairs (query_id, block); a block that very many queries go to meets them in parts."""
        per_block = pairs.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
        per_block, _ = staged(per_block, "term-blocks")  # a row a block: fewer than MOST_BLOCKS, bands, and weights by WEIGHTS
        per_block = F.broadcast(per_block)
        left = pairs.join(per_block, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        left = left.join(asked, "query_id").select("block", "part", "query_id", "term", "weight")
        in_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        chunks = self.spark.read.parquet(f"{self.path}/chunks")
        chunks = chunks if where is None else chunks.where(where)
        ids = chunks.join(per_block, "block").groupBy("block", "parts").agg(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))).alias("c"))
        ids = ids.select("block", in_parts, F.lit(None).cast(asked.schema["term"].dataType).alias("term"), F.transform("c", lambda x: x["place"]).alias("places"), F.lit(None).cast("array<double>").alias("weights"), F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"))
        postings = self.spark.read.parquet(f"{self.path}/postings").join(per_block, "block").join(asked.select("term").distinct(), "term", "left_semi")
        postings = postings.select("block", in_parts, "term", "places", "weights", F.lit(None).cast(ids.schema["chunk_ids"].dataType).alias("chunk_ids"))
        return block_hits(left, postings.unionByName(ids), k, common)
