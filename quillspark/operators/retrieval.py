"""Hybrid retrieval: exact dense and sparse top-k, reciprocal rank fusion, reranking, numbered evidence.

Everything runs for a table of queries at once; every order is total (score, then chunk id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.lazy import lazy_arrow_udf, lazy_udf
from quillspark.operators.dense_index import PLACES, DenseIndex
from quillspark.operators.term_index import TermIndex

DIMENSIONS = 256
#: Scores of rows and queries, or their parts, that a task makes at once.
SCORES = 1 << 19
#: Bytes of text whose terms are counted at once.
TEXT = 1 << 21


def terms(text: Column) -> Column:
    """Lower-cased words of a text, as white space parts them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([^\x20\x09-\x0D]+)"), 1)


def term_weights(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, term, weight): the counts of the terms of each text, added up before they are shuffled."""
    every = rows.select(id_col, F.explode(terms(F.col(text_col))).alias("term"))
    return every.groupBy(id_col, "term").agg(F.count("*").cast("double").alias("weight"))


def term_lists(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, terms, weights): the distinct terms of each text and their counts, made where the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some megabytes of text at once, however many a batch has.
            piece = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)) // TEXT
            borders = [*np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), batch.num_rows]
            for at, to in pairwise(borders):
                some = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([some.column(0), *_counted_terms(some.column(1))], names=[id_col, "terms", "weights"])

    return rows.select(id_col, F.lower(text_col)).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, terms array<string>, weights array<double>")


def _counted_terms(text: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
    """Of each text its distinct terms, as white space parts them, and their counts; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    coded, lengths = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy()
    code, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary) + 1
    filled = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[code]  # white space at an end leaves an empty piece
    cells, counts = np.unique((np.repeat(np.arange(len(lists)), lengths) * n + code)[filled], return_counts=True)
    starts = pa.array(np.searchsorted(cells, np.arange(len(lists) + 1) * n).astype(np.int32))
    terms = pa.ListArray.from_arrays(starts, coded.dictionary.take(pa.array(cells % n)))
    return terms, pa.ListArray.from_arrays(starts, pa.array(counts.astype(np.float64)))


def sparse_vector(text: Column) -> Column:
    """map<int,float> of hashed terms and their counts; a text without terms gets one vanishing weight."""
    return _counts(F.transform(terms(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(1 << 31)).cast("int")))


def _counted(lists: pa.ListArray) -> pa.MapArray:
    """Distinct numbers of each list in ascending order, with their counts."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    row, value, weight = np.concatenate([row, np.flatnonzero(np.diff(offsets) == 0)]), values, np.float32(1e-6)
    cells, counts = np.unique(row * (1 << 31) + np.concatenate([value, np.zeros(len(row) - len(value), np.int64)]), return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(lists) + 1) * (1 << 31))
    weights = np.where((np.diff(offsets) == 0)[cells >> 31], weight, counts.astype(np.float32))
    return pa.MapArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array((cells % (1 << 31)).astype(np.int32)), pa.array(weights.astype(np.float32)))


@lazy_arrow_udf("map<int,float>")
def _counts(hashed: pa.Array) -> pa.Array:
    return _counted(hashed)


@lazy_udf("array<float>")
def dense_vector(text: pd.Series) -> pd.Series:
    """Signed hashed projection of words, of unit length: the offline stand-in for an embedder."""
    import zlib

    def one(t: str | None) -> np.ndarray:
        out = np.zeros(DIMENSIONS, np.float32)
        for word in (t or "").lower().split():
            h = zlib.crc32(word.encode())
            out[h % DIMENSIONS] += 1 if h >> 16 & 1 else -1
        return out / (np.linalg.norm(out) or 1)

    return text.map(one)


def scalar_filter(kinds: Iterable | None = None, content_types: Iterable | None = None, doc_ids: Iterable | None = None) -> Column:
    """All of the given membership tests; an empty or missing one restricts nothing."""
    out = F.lit(True)
    for name, values in (("kind", kinds), ("content_type", content_types), ("doc_id", doc_ids)):
        if values := list(values or []):
            out &= F.col(name).isin(values)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top(scored: DataFrame, k: int, group: str = "query_id", score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The k best rows of each group, with rank from 1."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Best:
    """The k best rows of each of n queries, by score, then key."""

    def __init__(self, n: int, k: int, least: float) -> None:
        self.k, self.least = k, np.full(n, least)
        self.keys, self.scores = [np.zeros(0, object)] * n, [np.zeros(0)] * n

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """keys of rows, and their scores, a column a query."""
        hit = scores >= self.least
        for n in np.flatnonzero(hit.any(axis=0)).tolist():
            rows = np.flatnonzero(hit[:, n])
            some, names = np.concatenate([self.scores[n], scores[rows, n]]), np.concatenate([self.keys[n], keys[rows]])
            order = np.lexsort((names, -some))[: self.k]
            self.scores[n], self.keys[n] = some[order], names[order]
            if len(order) == self.k:
                self.least[n] = max(self.least[n], some[order[-1]])


def _searched(ids: pa.Array, rows: DataFrame, kind: str, scorer: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], k: int, least: float) -> DataFrame:
    """query_id, chunk_id, score: each task's k best rows of each query; scorer gives blocks of rows (from, scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key_type = _Best(len(ids), k, least), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys = np.array(batch.column(0).to_pylist(), object)
            for at, scores in scorer(batch):
                best.add(keys[at : at + len(scores)], scores)
        for n in range(len(ids)):
            if size := len(best.keys[n]):
                yield pa.RecordBatch.from_arrays([pa.repeat(ids[n], size), pa.array(best.keys[n].tolist(), key_type), pa.array(best.scores[n])], names=["query_id", "chunk_id", "score"])

    return rows.mapInArrow(run, f"query_id {kind}, chunk_id {rows.schema[0].dataType.simpleString()}, score double")


def _blocks(queries: DataFrame, block: int) -> list[DataFrame]:
    count = -(-queries.select("query_id").distinct().count() // block)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == n) if count > 1 else queries for n in range(max(1, count))]


def dense_search(queries: DataFrame, chunks: DataFrame, k: int = rules.CANDIDATES, block: int = 2048) -> DataFrame:
    """query_id, chunk_id, score, rank by inner product of unit vectors: exact, for a stated set of queries. Rows
    without a vector take no part.

    Queries go in blocks of about block rows, which travel with the tasks; each block reads the chunks once. Each
    task scores its rows against a block by one matrix product and keeps its k best of each query, so that what is
    shuffled is at most k rows a query and task.
    """
    kind = queries.schema["query_id"].dataType.simpleString()

    def scores(part: DataFrame) -> DataFrame:
        asked = part.where("dense is not null").select("query_id", "dense").toArrow()
        vectors = np.array(asked.column("dense").to_pylist(), np.float64)

        def products(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            rows = batch.column(1)
            at_once = max(1, SCORES // max(1, len(vectors)))
            for at in range(0, len(rows) if len(vectors) else 0, at_once):
                some = rows.slice(at, at_once)
                yield at, np.round(some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1) @ vectors.T, PLACES)

        return _searched(asked.column("query_id").combine_chunks(), chunks.where("dense is not null").select("chunk_id", "dense"), kind, products, k, -np.inf)

    return top(reduce(DataFrame.unionByName, map(scores, _blocks(queries, block))), k)


def sparse_search(queries: DataFrame, chunks: DataFrame, k: int = rules.CANDIDATES) -> DataFrame:
    """query_id, chunk_id, score, rank by inner product of the maps of term weights in column sparse."""
    asked = queries.select("query_id", F.explode("sparse").alias("term", "weight"))
    return term_search(asked, chunks.select("chunk_id", F.map_keys("sparse").alias("terms"), F.map_values("sparse").alias("weights")), k)


def term_search(asked: DataFrame, held: DataFrame, k: int = rules.CANDIDATES, block: int = 2048, common: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank by the sum over common terms of both weights; without any a pair does not count.

    asked: query_id, term, weight, a stated set of queries; held: chunk_id, terms (array, repeats add up) and
    weights (array; missing: 1 each). With common the score is the number of distinct common terms. The terms of
    a block of queries travel with the tasks as an inverted index; chunks are scored where they are.
    """
    kind = asked.schema["query_id"].dataType.simpleString()
    rows = held.select("chunk_id", "terms", *(["weights"] if "weights" in held.columns else []))

    def scores(part: DataFrame) -> DataFrame:
        listed = part.select("query_id", "term", F.col("weight").cast("double").alias("weight")).toArrow().combine_chunks()
        ids, terms_of = (listed.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        order = np.argsort(terms_of.indices.to_numpy(), kind="stable")
        query = ids.indices.to_numpy()[order].astype(np.int64)
        weight = listed.column("weight").to_numpy()[order]
        words, n = terms_of.dictionary, len(ids.dictionary)
        size = np.bincount(terms_of.indices.to_numpy(), minlength=len(words))
        begin = np.cumsum(size) - size
        at_once = min(1024, max(1, SCORES // max(1, n)))

        def sums(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            lists = batch.column(1)
            stops = lists.offsets.to_numpy()
            term = pc.index_in(lists.values, value_set=words).to_numpy(zero_copy_only=False)
            own = batch.column(2).values.to_numpy(zero_copy_only=False).astype(np.float64) if batch.num_columns > 2 else np.ones(len(term))
            for at in range(0, batch.num_rows, at_once):
                to = min(at + at_once, batch.num_rows)
                i, j = int(stops[at]), int(stops[to])
                row = np.repeat(np.arange(to - at), np.diff(stops[at : to + 1]))
                known = ~np.isnan(term[i:j].astype(np.float64))
                place = row[known] * len(words) + term[i:j][known].astype(np.int64)
                places, back = np.unique(place, return_inverse=True)
                total = np.bincount(back, weights=own[i:j][known], minlength=len(places))
                row, t = places // max(1, len(words)), places % max(1, len(words))
                # A common term meets nearly all queries in nearly all rows: pairs are made some at a time.
                out = np.zeros((to - at) * n)
                piece = np.cumsum(size[t]) // SCORES
                borders = [*np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), len(places)]
                for a, b in pairwise(borders):
                    count = size[t[a:b]]
                    each = np.repeat(np.arange(a, b), count)
                    hit = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[t[a:b]], count)
                    np.add.at(out, row[each] * n + query[hit], 1.0 if common else weight[hit] * total[each])
                yield at, out.reshape(to - at, n)

        return _searched(ids.dictionary, rows, kind, sums if n else (lambda _: iter(())), k, np.nextafter(0, 1))

    return top(reduce(DataFrame.unionByName, map(scores, _blocks(asked, block))), k)


def fused(*arms: DataFrame, k: int = rules.FUSED, constant: int = rules.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked arms: the sum of 1 / (constant + rank)."""
    rows = [a.select("query_id", "chunk_id", (1.0 / (constant + F.col("rank"))).alias("part")) for a in arms]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    # Parts are summed in a fixed order, so that equal ranks give equal scores.
    parts = F.sort_array(F.collect_list("part"), asc=False)
    return top(every.groupBy("query_id", "chunk_id").agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("score")), k)


def with_documents(hits: DataFrame, docs: DataFrame, ready_only: bool = False) -> DataFrame:
    """Hits with their document's fields; hits without a document are dropped."""
    known = docs.where("status = 'ready'") if ready_only else docs
    return hits.join(known.select("doc_id", "file_name", "document_title", "source_path"), "doc_id")


@dataclass
class Indexes:
    """The stored indexes of both arms below one path."""

    dense: DenseIndex
    terms: TermIndex

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> Indexes:
        """Index chunks (chunk_id, dense, sparse, and kind, content_type, doc_id for filters) at path, which must be new."""
        filters = [c for c in ("kind", "content_type", "doc_id") if c in chunks.columns]
        listed = chunks.select("chunk_id", F.map_keys("sparse").alias("terms"), F.map_values("sparse").alias("weights"))
        dense = DenseIndex.build(chunks.select("chunk_id", "dense", *filters), f"{path}/dense")
        return cls(dense, TermIndex.of_lists(listed, chunks.select("chunk_id", *filters), f"{path}/terms"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Indexes:
        return cls(DenseIndex.open(spark, f"{path}/dense"), TermIndex(spark, f"{path}/terms"))


def arms(queries: DataFrame, chunks: DataFrame, candidates: int, where: Column | None = None, indexes: Indexes | None = None) -> list[DataFrame]:
    """Hits of queries (query_id, dense, sparse) by vectors and by terms: from indexes, else by comparing all chunks."""
    if indexes:
        asked = queries.select("query_id", F.explode("sparse").alias("term", "weight"))
        return [indexes.dense.search(queries, candidates, where), indexes.terms.search(asked, candidates, where)]
    pool = chunks if where is None else chunks.where(where)
    return [dense_search(queries, pool, candidates), sparse_search(queries, pool, candidates)]


def search(queries: DataFrame, chunks: DataFrame, docs: DataFrame, k: int = rules.TOP_K, candidates: int = rules.CANDIDATES, where: Column | None = None, indexes: Indexes | None = None) -> DataFrame:
    """Hybrid search of queries (query_id, dense, sparse); scores to five places. With indexes of the chunks nothing else is scored."""
    hits = fused(*arms(queries, chunks, candidates, where, indexes), k=k)
    return with_documents(hits.join(chunks.drop("dense", "sparse"), "chunk_id"), docs).withColumn("score", F.round("score", 5))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has: the offline stand-in for a reranker."""
    asked, held = (terms(F.coalesce(c, F.lit(""))) for c in (query, text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, held)), F.size(F.array_distinct(asked))), F.lit(0.0))


def reranked(hits: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] | None = overlap, k: int = rules.FINAL, chars: int = rules.RERANK_CHARS) -> DataFrame:
    """The k best hits by scorer of query and text; where it gives null, by fusion order, after the others."""
    rows = hits.withColumnRenamed("rank", "fused_rank").join(queries.select("query_id", "query"), "query_id")
    rows = rows.withColumn("rerank", scorer(F.col("query"), F.substring("text", 1, chars)) if scorer else F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank").desc_nulls_last(), "fused_rank")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def permuted(hits: DataFrame, order: DataFrame) -> DataFrame:
    """Hits in the order of a reranker's answer (query_id, order: array of indices from 0 into the fused ranks)."""
    places = order.select("query_id", F.posexplode("order").alias("at", "index"))
    return hits.withColumn("index", F.col("rank") - 1).drop("rank").join(places, ["query_id", "index"]).withColumn("rank", F.col("at") + 1).drop("at", "index")


def evidence(hits: DataFrame, docs: DataFrame, entities: DataFrame | None = None, confirmed: DataFrame | None = None) -> DataFrame:
    """Numbered evidence E1..En of ranked hits, with the confirmed entity (query_id, at, id) of its document.

    Of several, the last holds; entities that are only documents leave name and codes empty.
    """
    rows = hits.join(docs.select("doc_id", F.col("content_type").alias("doc_type"), "document_title", "file_name", "source_path"), "doc_id")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = rows.withColumn("eid", number).withColumn("content_type", F.col("doc_type")).drop("doc_type")
    blank = F.array().cast("array<string>")
    if entities is None or confirmed is None:
        return rows.withColumn("entity_name", F.lit("")).withColumn("entity_codes", blank)
    real = F.col("type") != "document"
    of = confirmed.join(entities, "id").select("query_id", "at", F.explode("doc_ids").alias("doc_id"), F.when(real, F.col("name")).otherwise("").alias("entity_name"), F.when(real, F.col("codes")).otherwise(blank).alias("entity_codes"))
    last = of.groupBy("query_id", "doc_id").agg(F.max_by(F.struct("entity_name", "entity_codes"), "at").alias("e")).select("query_id", "doc_id", "e.*")
    return rows.join(last, ["query_id", "doc_id"], "left").withColumns({"entity_name": F.coalesce("entity_name", F.lit("")), "entity_codes": F.coalesce("entity_codes", blank)})


def documents_of(entity_ids: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, doc_id) of entity ids (query_id, id); unknown ones are passed over."""
    return entity_ids.join(entities.select("id", "doc_ids"), "id").select("query_id", F.explode("doc_ids").alias("doc_id")).distinct()
