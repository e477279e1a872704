"""Stored search indexes, dictionaries and entity merging against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import fields
from quillspark.operators import dense_index, dictionary, retrieval, term_index
from quillspark.operators import entities as ent
from quillspark.plans import stored
from quillspark.session import new_path, staged

ENTITY = "doc_id string, file_name string, entity struct<type:string,name:string,codes:array<string>,aliases:array<string>>"


def keyed(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"), "label")


def test_dense_recall(spark, vectors):
    index = dense_index.DenseIndex.build(vectors, new_path(spark, "dense-index"))
    assert spark.read.parquet(f"{index.path}/rows").count() == vectors.count() == index.total
    asked = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    found, true = keyed(index.search(asked, 10)), keyed(retrieval.dense_search(asked, vectors, 10))
    assert len(found) == len(true) and len({x[::2] for x in found} & {x[::2] for x in true}) >= 0.9 * len(true)
    routes = index.routed(asked.select("query_id", "dense"), index.probes).select("query_id", F.explode("cells").alias("cell"))
    sizes = spark.read.parquet(f"{index.path}/rows").groupBy("cell").count()
    scored = routes.join(sizes, "cell").agg(F.sum("count")).first()[0]
    assert scored < 0.65 * vectors.count() * asked.count()
    assert keyed(index.search(asked, 10, probes=len(index.centres))) == true
    reopened = dense_index.DenseIndex.open(spark, index.path)
    assert (reopened.probes, reopened.blocks) == (index.probes, index.blocks) and np.array_equal(reopened.centres, index.centres)


def test_dense_filters_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(dense_index, "BLOCK", 40)
    monkeypatch.setattr(dense_index, "ASKED", 7)
    rng = np.random.default_rng(4)
    points = rng.normal(size=(500, 12))
    points[100:300] = points[0]  # copies fill one cell
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(k, points[k].tolist(), k % 50) for k in range(500)] + [(900, None, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, dense array<double>, label int")
    index = dense_index.DenseIndex.build(chunks, new_path(spark, "dense-index"), cells=20)
    assert max(index.blocks) > 1
    asked = chunks.where("chunk_id < 40 or chunk_id = 900").withColumnRenamed("chunk_id", "query_id")
    rare = F.col("label") == 7  # ten rows: fewer than asked for
    assert keyed(index.search(asked, 25, where=rare, probes=1)) == keyed(retrieval.dense_search(asked, chunks.where(rare), 25))
    assert keyed(index.search(asked, 5, probes=len(index.centres))) == keyed(retrieval.dense_search(asked, chunks, 5))
    empty = dense_index.DenseIndex.build(chunks.where("dense is null"), new_path(spark, "dense-index"))
    assert empty.search(asked, 5).count() == 0
    assert index.search(asked.where("false"), 5).count() == 0


def test_term_index_is_exact(spark, monkeypatch):
    monkeypatch.setattr(term_index, "BLOCK", 16)
    monkeypatch.setattr(term_index, "ASKED", 3)
    rng = random.Random(2)
    weights = [(c, f"t{int(rng.paretovariate(0.6)) % 60}", round(rng.uniform(-0.5, 3), 2)) for c in range(300) for _ in range(rng.choice([1, 4, 40]))]
    held = {(c, t): w for c, t, w in weights}
    weights = spark.createDataFrame([(c, t, w) for (c, t), w in held.items()] + [(5, None, 1.0), (6, "t1x", None)], "chunk_id bigint, term string, weight double")
    asked = {(q, f"t{rng.randrange(60)}"): round(rng.uniform(0.1, 2), 2) for q in range(25) for _ in range(rng.choice([1, 3, 9]))}
    queries = spark.createDataFrame([(q, t, w) for (q, t), w in asked.items()] + [(99, "unknown", 1.0)], "query_id bigint, term string, weight double")
    index = term_index.TermIndex.build(weights, spark.range(300).select(F.col("id").alias("chunk_id"), (F.col("id") % 3).alias("kind")), new_path(spark, "term-index"))

    def brute(fit, k, common):
        out = []
        for q in range(25):
            score = {}
            for (c, t), w in held.items():
                if (q, t) in asked and fit(c):
                    score[c] = score.get(c, 0) + (1 if common else w * asked[q, t])
            some = sorted((-s, c) for c, s in score.items() if s > 1e-9)[:k]
            out += [(q, n, c, round(-s, 9)) for n, (s, c) in enumerate(some, 1)]
        return sorted(out)

    assert keyed(index.search(queries, 5)) == brute(lambda c: True, 5, False)
    assert keyed(index.search(queries, 7, where=F.col("kind") == 1)) == brute(lambda c: c % 3 == 1, 7, False)
    assert keyed(index.search(queries, 4, common=True)) == brute(lambda c: True, 4, True)
    bounds = index.bounds(queries)
    hits = index.search(queries, 2)
    assert index.promising(bounds, bounds.limit(0).select("query_id", "block"), hits, 2).count() < 0.7 * bounds.count()
    empty = term_index.TermIndex.build(weights.where("false"), spark.range(0).select(F.col("id").alias("chunk_id")), new_path(spark, "term-index"))
    assert empty.search(queries).count() == 0


def test_term_lists_stay_where_texts_are(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TEXT", 16)
    texts = [(0, None), (1, ""), (2, " \t\x0b\n"), (3, "  Ab ab\u00a0x\x85y AB\x0cab "), (4, "İ ß ΑΣ ΑΣ 漢字 漢 字"), (5, "one " * 70 + "two"), (6, "\x1c \x00 a")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    listed = retrieval.term_lists(rows, "doc_id", "text")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # not a row a term before texts are dealt to their blocks
    got = {(r.doc_id, t): w for r in listed.collect() for t, w in zip(r.terms, r.weights, strict=True)}
    assert got == {(r.doc_id, r.term): r.weight for r in retrieval.term_weights(rows, "doc_id", "text").collect()}
    assert listed.count() == len(texts)


def test_term_lists_of_an_index(spark, monkeypatch):
    monkeypatch.setattr(term_index, "WEIGHTS", 100)
    rng = random.Random(6)
    lists = [(c, {f"t{rng.randrange(80)}": float(rng.randint(1, 9)) for _ in range(20)}) for c in range(120)]
    lists += [(3, {"t1": 5.0, "new": 2.0}), (3, {"t1": 1.0}), (119, {"t2": 4.0}), (7, {}), (None, {"t1": 1.0})]
    rows = [(c, [*w, None], [*w.values(), 1.0]) if w else (c, [], []) for c, w in lists] + [(200, None, None), (201, ["t1"], [None])]
    listed = spark.createDataFrame(rows, "chunk_id bigint, terms array<string>, weights array<double>")
    index = term_index.TermIndex.of_lists(listed, spark.range(300).select(F.col("id").alias("chunk_id")), new_path(spark, "term-index"))
    postings = spark.read.parquet(f"{index.path}/postings")
    assert postings.groupBy("block").agg(F.sum(F.size("places")).alias("n")).where("n > 200").isEmpty()
    asked = spark.createDataFrame([(q, f"t{q}", 1.0) for q in range(40)] + [(40, "new", 1.0)], "query_id bigint, term string, weight double")
    sums = {}
    for c, w in lists:
        for t, x in w.items():
            sums[t, c] = sums.get((t, c), 0) + x
    want = []
    for q, t in [*((q, f"t{q}") for q in range(40)), (40, "new")]:
        best = sorted((-x, c) for (u, c), x in sums.items() if u == t and c is not None)[:6]
        want += [(q, n, c, -x) for n, (x, c) in enumerate(best, 1)]
    assert keyed(index.search(asked, 6)) == sorted(want)


def test_stored_search_of_repeated_documents(spark, tmp_path):
    docs = [(1, "aa bb", "en"), (1, "aa aa", "de"), (2, "aa aa", "en"), (3, None, "en")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "AA")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stored.sparse_topk_stored(spark, str(tmp_path))
    assert keyed(got) == [(9, 1, 1, 3.0), (9, 2, 2, 2.0)]


def test_search_by_indexes(spark):
    rows = [(f"c{k}", f"d{k % 7}", "text" if k % 2 else "table", f"word{k % 5} other{k % 3} common") for k in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, kind string, text string").withColumn("content_type", F.lit("t"))
    chunks = chunks.withColumns({"dense": retrieval.dense_vector("text"), "sparse": retrieval.sparse_vector(F.col("text"))})
    docs = spark.createDataFrame([(f"d{k}", f"f{k}", f"title {k}", "") for k in range(7)], "doc_id string, file_name string, document_title string, source_path string")
    asked = spark.createDataFrame([("q1", "word1 common"), ("q2", "other2")], "query_id string, query string")
    asked = asked.withColumns({"dense": retrieval.dense_vector("query"), "sparse": retrieval.sparse_vector(F.col("query"))})
    indexes = retrieval.Indexes.build(chunks, new_path(spark, "indexes"))
    for where in (None, retrieval.scalar_filter(kinds=["text"])):
        plain, stored = (retrieval.search(asked, chunks, docs, k=6, candidates=60, where=where, indexes=i) for i in (None, indexes))
        assert keyed(plain) == keyed(stored) and plain.count() == 12


def test_dictionary(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abä漢", k=n))
    texts = [(k, word(rng.randrange(0, 60))) for k in range(80)] + [(80, None), (3, "aab"), (81, word(200_000))]
    patterns = sorted({word(rng.randrange(1, 6)) for _ in range(150)})
    df = spark.createDataFrame(texts, "k int, t string")
    held = spark.createDataFrame([(p,) for p in [*patterns, patterns[0], "", None]], "p string")
    want = sorted((k, p) for k, t in texts for p in patterns if t and p in t)
    for room in (1 << 20, 100):
        assert sorted((r.k, r.p) for r in dictionary.occurrences(df, "t", held, "p", room).collect()) == want
    assert dictionary.occurrences(df, "t", held.where("false"), "p").count() == 0
    assert dictionary.occurrences(df.where("false"), "t", held, "p").columns == ["k", "t", "p"]


def test_fuzzy_matches_of_labels_with_a_common_word(spark):
    """Labels and mentions that end in one word: pairs are made only where they fit."""
    labels = spark.createDataFrame([(f"e{k}", "fund", f"{k:08d} HOLDING") for k in range(600)], "id string, type string, label string")
    mentions = spark.createDataFrame([(f"{k:08d}XYZ HOLDING",) for k in range(1000, 1600)], "mention string").withColumn("text", F.col("mention"))
    found = {}
    for r in ent.by_fuzzy(mentions, labels).collect():
        found.setdefault(r.mention, set()).add(r.id)
    for m in [f"{k:08d}XYZ HOLDING" for k in range(1000, 1600, 97)]:
        best = [(ent.longest_common(m, f"{k:08d} HOLDING"), f"e{k}") for k in range(600)]
        top = max(best)[0]
        want = {i for n, i in best if n == top} if top >= max(4, -(-len(m) // 2)) else set()
        assert found.get(m, set()) == want


def fold(docs):
    """The fold as stated: (name, type, codes, aliases, doc_ids) of each group."""
    groups = []
    for key, _, entity in sorted(docs, key=lambda d: (d[1], d[0])):
        if entity is None:
            continue
        kind, name, codes, aliases = entity
        met = [g for g in groups if g["name"] == name or set(g["codes"]) & set(codes or [])]
        home = met[0] if met else {"name": name, "type": kind, "codes": [], "aliases": [], "ids": []}
        groups = [g for g in groups if all(g is not m for m in met[1:])] + ([] if met else [home])
        for part in [*met[1:], {"codes": codes or [], "aliases": aliases or [], "ids": [key]}]:
            for k in ("codes", "aliases", "ids"):
                home[k] += [x for x in dict.fromkeys(part[k]) if x not in home[k]]
    return sorted((min(g["codes"], default=g["name"]), g["name"], g["type"], g["codes"], g["aliases"], g["ids"]) for g in groups)


def chains(rng, n, names, codes):
    pick = lambda stem, most, k: [f"{stem}{rng.randrange(most)}" for _ in range(rng.randrange(k))]
    return [(f"d{k:04d}", f"{rng.randrange(n):04d}", (f"k{k % 3}", f"n{rng.randrange(names)}", pick("c", codes, 3) or None, pick("a", 30, 4))) for k in range(n)] + [("none", "0000", None)]


@pytest.mark.parametrize(("names", "codes"), [(40, 60), (6, 200), (200, 20), (300, 3)])
def test_merge_with_chains(spark, names, codes):
    docs = chains(random.Random(names), 250, names, codes)
    df = spark.createDataFrame(docs, ENTITY)
    assert sorted(tuple(r) for r in ent.merge(df).collect()) == fold(docs)
    assert ent.merge(df).columns == [f.split()[0] for f in fields.ENTITY.split(", ")]


def test_one_giant_part_is_added_up(spark):
    """Names of all kinds that share a code, or one that follows another, are one group from the first document on."""
    docs = [(f"d{k:04d}", f"{k:04d}", ("fund", f"n{k}", ["c0", f"c{k}"] if k % 2 else [f"c{k - 1}", f"x{k}"], [f"a{k % 9}"])) for k in range(1, 400)]
    df = spark.createDataFrame(docs, ENTITY)
    together = df.select("doc_id", "file_name", "entity.*").join(ent.linked_parts(df), "doc_id")
    assert together.select("part").distinct().count() == 1 and ent.begin_again(together).count() == 0
    assert sorted(tuple(r) for r in ent.merge(df).collect()) == fold(docs)


def test_documents_without_codes_meet_no_code(spark):
    """Looking for parts that begin again, no outer join deals rows by a missing code: they would all be one task's."""
    rows = [(f"d{i}", f"f{i:03}", ("company", f"n{i % 7}", ["c1"] if i % 7 == 0 else [], [])) for i in range(60)]
    docs = spark.createDataFrame(rows, ENTITY)
    together = docs.select("doc_id", "file_name", "entity.*").join(ent.linked_parts(docs), "doc_id")
    again = ent.begin_again(staged(together, "together")[0])
    assert "LeftOuter" not in again._jdf.queryExecution().optimizedPlan().toString()
    assert again.count() == 0 and ent.merge(docs).count() == 7


def test_pairs_of_rows_and_queries_are_made_some_at_a_time(spark, monkeypatch):
    """A term of all queries and rows makes as many pairs as there are of them; results do not depend on how many are made at once."""
    rng = np.random.default_rng(6)
    rows = [(i, ["the", *(f"w{w}" for w in rng.integers(0, 40, 12))]) for i in range(300)]
    held = spark.createDataFrame(rows, "chunk_id bigint, terms array<string>").repartition(2)
    asked = spark.createDataFrame([(q, t, float(w)) for q in range(60) for t, w in (("the", 3), (f"w{q % 40}", 1), (f"w{(q + 7) % 40}", 2))], "query_id bigint, term string, weight double")
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "chunk_id bigint, dense array<float>").repartition(2)
    questions = vectors.where("chunk_id < 60").withColumnRenamed("chunk_id", "query_id")
    whole = [keyed(retrieval.term_search(asked, held, 9)), keyed(retrieval.term_search(asked, held, 9, common=True)), keyed(retrieval.dense_search(questions, vectors, 9))]
    monkeypatch.setattr(retrieval, "SCORES", 70)
    small = [keyed(retrieval.term_search(asked, held, 9)), keyed(retrieval.term_search(asked, held, 9, common=True)), keyed(retrieval.dense_search(questions, vectors, 9))]
    assert whole == small and all(len(x) == 540 for x in whole)
    score = lambda q, t: sum({"the": 3, f"w{q % 40}": 1, f"w{(q + 7) % 40}": 2}.get(x, 0) for x in t)
    best = {q: sorted((-score(q, t), i) for i, t in rows)[:9] for q in range(60)}
    assert [(q, n, i, float(-s)) for q in range(60) for n, (s, i) in enumerate(best[q], 1)] == whole[0]


def test_rows_without_a_term_of_any_query_count_for_none(spark):
    """Whole batches without one, too: of rows of other terms, of none, and of queries without rows."""
    held = spark.createDataFrame([(1, ["b", "c"]), (2, []), (3, ["d"])], "chunk_id bigint, terms array<string>").coalesce(1)
    asked = spark.createDataFrame([(1, "a", 1.0), (2, "x", 2.0)], "query_id bigint, term string, weight double")
    assert retrieval.term_search(asked, held, 3).collect() == [] and retrieval.term_search(asked, held, 3, common=True).collect() == []
    more = held.union(spark.createDataFrame([(4, ["x", "b"])], held.schema))
    assert [tuple(r) for r in retrieval.term_search(asked, more, 3).select("query_id", "chunk_id", "score").collect()] == [(2, 4, 2.0)]


def test_counts_of_lists_are_maps_without_python_objects(spark):
    texts = [("b a b",), ("",), (None,), ("a",), ("c " * 300,)]
    got = [r.s for r in spark.createDataFrame(texts, "t string").coalesce(1).select(retrieval.sparse_vector(F.col("t")).alias("s")).collect()]
    assert [sorted(round(v, 6) for v in m.values()) for m in got] == [[1.0, 2.0], [1e-6], [1e-6], [1.0], [300.0]]
    assert got[1] == got[2] and list(got[1]) == [0]


def test_merging_looks_at_each_name_and_codes_once(spark, monkeypatch):
    seen, plain = [], ent.begin_again
    monkeypatch.setattr(ent, "begin_again", lambda rows: seen.append(rows.count()) or plain(rows))
    rng = random.Random(11)
    rows = []
    for k in range(900):
        n = rng.randrange(30)
        codes = [] if n % 7 == 0 else [f"own{n}", f"all{n // 5}", *([f"own{n}"] if n % 4 == 0 else [])]
        rows.append((f"d{k}", f"f{rng.randrange(400):04}", ("company", f"n{n if n % 3 else 0}", codes, [f"a{rng.randrange(4)}" for _ in range(rng.randrange(3))])))
    docs = spark.createDataFrame(rows, ENTITY)
    got = sorted((r.id, r.name, r.codes, r.doc_ids) for r in ent.merge(docs).collect())
    pdf = docs.select("doc_id", "file_name", "entity.*").toPandas().assign(part="all")
    want = ent.folded_part(pdf)
    assert got == sorted((r.id, r.name, r.codes, r.doc_ids) for r in want.itertuples())
    assert seen == [docs.select("entity.name", "entity.codes").distinct().count()] and seen[0] < 60
