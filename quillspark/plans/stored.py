"""Registered queries over stored indexes, dictionaries and merged entities, with their SQL oracles where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import dictionary, entities, retrieval
from quillspark.operators.dense_index import DenseIndex
from quillspark.operators.term_index import TermIndex
from quillspark.plans.registry import TERMS, query
from quillspark.session import new_path, table


@query()
def dense_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest, by a stored index of cells, of every vector whose id 20 divides; tests hold its recall to 0.9."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"))
    index = DenseIndex.build(rows, new_path(spark, "dense-index"))
    return index.search(rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {TERMS} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM a WHERE rank <= 10")
def sparse_topk_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against all documents by a stored inverted index that skips blocks."""
    docs = table(spark, sf_dir, "documents")
    listed = retrieval.term_lists(docs, "doc_id", "text").withColumnRenamed("doc_id", "chunk_id")
    index = TermIndex.of_lists(listed, docs.select(F.col("doc_id").alias("chunk_id"), "lang").dropDuplicates(["chunk_id"]), new_path(spark, "term-index"))
    asked = retrieval.term_weights(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    return index.search(asked, 10)


@query("""
    WITH p AS (SELECT DISTINCT lower(p_name) AS name FROM part), w AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS word FROM p)
    SELECT word, count(doc_id) AS documents, min(doc_id) AS first FROM w LEFT JOIN documents ON contains(lower(text), word) WHERE word <> '' GROUP BY word
""")
def words_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each word of a part's name stands, as any run of characters: one pass over whole texts."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where("word <> ''").distinct()
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    found = dictionary.occurrences(texts, "text", words, "word").groupBy("word").agg(F.count("doc_id").alias("documents"), F.min("doc_id").alias("first"))
    return words.join(found, "word", "left").select("word", F.coalesce("documents", F.lit(0)).alias("documents"), "first")


@query("""
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey // 50 AS g, o_orderpriority AS p FROM orders),
    f AS (SELECT g, min(k) AS k FROM o GROUP BY g)
    SELECT 'all' || f.g AS id, 'customer ' || o.c AS name, n.docs AS documents, n.codes AS codes, n.aliases AS aliases, CAST(f.k AS VARCHAR) AS first
    FROM f JOIN o ON o.k = f.k JOIN (SELECT g, count(*) AS docs, 1 + count(DISTINCT c) AS codes, count(DISTINCT p) AS aliases FROM o GROUP BY g) n ON n.g = f.g
""")
def entity_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents about their customer, whose name and code others share: fifty customers have one code in common."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_custkey")
    codes = F.array(F.concat(F.lit("own"), key), F.concat(F.lit("all"), F.floor(key / 50)))
    entity = F.struct(F.lit("company").alias("type"), F.concat(F.lit("customer "), key).alias("name"), codes.alias("codes"), F.array("o_orderpriority").alias("aliases"))
    docs = orders.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file_name"), entity.alias("entity"))
    found = entities.merge(docs)
    return found.select("id", "name", F.size("doc_ids").cast("long").alias("documents"), F.size("codes").cast("long").alias("codes"), F.size("aliases").cast("long").alias("aliases"), F.get("doc_ids", F.lit(0)).alias("first"))
