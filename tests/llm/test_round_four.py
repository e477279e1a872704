"""Importance resampling, nearest neighbours by codes and spelling variants against brute force and on hard tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import multi_index, resampling, spelling

SF = "/root/testdata/sf0.001"
LETTER = "[A-Za-zÀ-ÿ]"
LONG = " ".join(f"wordnumber{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(50_000))
HARD = [(0, None), (1, ""), (2, " \t"), (3, LONG), (3, LONG), (None, "some words here"), (None, None), (4, "some words here"), (5, "漢字 字 Ünïcode ÀÉ"), (6, "1234 !!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, "doc_id bigint, text string")
    for name in ("word", "n", "score", "weight", "_id", "_t", "_i", "ids", "rank", "key"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def resampled(rows, target, buckets=10_000, longest=1, least=20, percent=10, seed=2024):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text) in plain Python."""

    def found(text):
        small = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)

    def features(words):
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = (Counter(b for x in texts for b in features(found(x))) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        own = features(found(text))
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(found(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for at, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = at
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 60)])
def test_resampling(spark, docs, longest, percent):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = [tuple(r) for r in resampling.resample(docs, target, longest=longest, percent=percent).collect()]
    expected = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest=longest, percent=percent)
    assert sorted(got) == sorted(expected, key=lambda r: r[:1]) and any(r[4] for r in got)


def test_resampling_blocks(docs, monkeypatch):
    whole = resampling.count_matrix(docs, "doc_id", "text", 500)
    monkeypatch.setattr(resampling, "BLOCK_DOCS", 3)
    small = resampling.count_matrix(docs, "doc_id", "text", 500)
    assert small.count() > 10 * whole.count()
    assert np.array_equal(resampling.column_sums(whole, 500), resampling.column_sums(small, 500))
    gain = np.arange(500) - 250
    rows = [sorted(map(tuple, resampling.weights(b, gain, "doc_id").collect())) for b in (whole, small)]
    assert rows[0] == rows[1] and len(rows[0]) == docs.count()


def test_blocks_that_are_read_together_are_small(spark):
    """A reader takes 4,096 blocks of a file at once, a task all files of a partition."""
    rows = spark.range(1200).repartition(1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(100_000)).cast("string")))).alias("text"))
    blocks = resampling.count_matrix(rows, "doc_id", "text", 10_000)
    cells = F.sum(sum(F.length(c) if t == "binary" else F.size(c) * 8 for c, t in blocks.dtypes))
    assert blocks.groupBy(F.input_file_name()).agg(cells.alias("n")).agg(F.max("n")).first()[0] < 8 << 20
    gain = np.arange(10_000)
    sums = resampling.column_sums(blocks, 10_000)
    assert sums.sum() == 2_400_000 and resampling.weights(blocks, gain, "doc_id").agg(F.sum("n_features")).first()[0] == 2_400_000


def test_resampling_hard(spark, hard):
    target = spark.createDataFrame([("some words",), (None,), ("",)], "text string")
    got = [tuple(r) for r in resampling.resample(hard, target, least_words=3, percent=70).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4] or 0)
    assert sorted(got, key=key) == sorted(resampled(HARD, ["some words", None, ""], least=3, percent=70), key=key)
    nothing = hard.where("false")
    assert resampling.resample(nothing, target).count() == 0
    flat = resampling.resample(hard, target.where("false"), least_words=1, percent=100).collect()
    assert len(flat) == len(HARD) and sum(r["rank"] is not None for r in flat) == 6


def exact(rows, asked, k):
    """(query_id, rank, vec_id) by brute force over valid rows (id, vector)."""
    out = []
    for q in asked:
        order = sorted((math.dist(rows[q], v), i) for i, v in rows.items() if i != q)
        out += [(q, n, i, d) for n, (d, i) in enumerate(order[:k], 1)]
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = multi_index.nearest(df, F.col("vec_id") % 20 == 0).collect()
    rows = {r.vec_id: list(map(float, r.embedding)) for r in df.collect()}
    true = exact(rows, [i for i in rows if i % 20 == 0], 10)
    assert len(got) == len(true)
    hits = {(q, i): d for q, _, i, d in true}
    assert sum((r.query_id, r.vec_id) in hits for r in got) >= 0.95 * len(true)
    assert all(abs(r.score - hits[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in hits)


def test_every_code_within_the_radius_meets(spark):
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(600, 32))
    model = multi_index.fit(sample, 5)
    codes = model.codes(sample)
    probes, keys = model.probes(codes), model.keys(codes)
    assert model.radius >= model.substrings and keys.shape == (600, model.substrings)
    apart = multi_index._distances(codes, codes)
    near = apart <= model.radius
    for q in range(0, 600, 7):
        met = np.isin(keys, probes[q]).any(axis=1)
        assert met[near[q]].all()


def test_codes_that_meet_are_no_rows_before_the_cut(spark, monkeypatch):
    """Substrings so narrow that most pairs meet many times: what is joined are blocks, and the pairs are those of brute force."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 16))
    model = multi_index.fit(vectors, 5)
    model.width = 4
    monkeypatch.setattr(multi_index, "BLOCK", 100)
    monkeypatch.setattr(multi_index, "ASKED", 20)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "_id bigint, _v array<double>")
    found = multi_index._met(multi_index._coded(rows.where("_id % 10 = 0"), model, 200), multi_index._coded(rows, model), model)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    codes = model.codes(vectors)
    apart = multi_index._distances(codes, codes)
    met = np.stack([np.isin(model.keys(codes), model.probes(codes[q : q + 1])).any(axis=1) for q in range(0, 900, 10)])
    most = np.partition(apart[::10], 199, axis=1)[:, 199:200]
    expected = [(10 * q, i) for q, i in np.argwhere(met & (apart[::10] <= most)).tolist() if 10 * q != i]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_nearest_hard(spark):
    rng = random.Random(3)
    some = [(i, [rng.gauss(0, 1) for _ in range(8)], i) for i in range(1, 41)]
    copies = [(i, some[0][1], i) for i in range(100, 140)]
    odd = [(200, None, 0), (201, [0.0] * 8, 0), (202, [math.nan] + [1.0] * 7, 0), (203, [math.inf] + [1.0] * 7, 0), (204, [None] + [1.0] * 7, 0), (205, [1.0, 2.0], 0), (206, [], 0), (None, some[1][1], 0), (3, some[2][1], 0)]
    df = spark.createDataFrame(some + copies + odd, "vec_id bigint, embedding array<double>, rank bigint").withColumn("_v", F.lit("x")).withColumn("w0", F.lit(1)).repartition(4)
    got = multi_index.nearest(df, F.col("vec_id") % 20 == 0, k=7).collect()
    rows = {i: v for i, v, _ in some + copies}
    true = exact(rows, [i for i in rows if i % 20 == 0], 7)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(t[:3] for t in true)
    assert multi_index.nearest(df, F.lit(True), k=3).select("query_id").distinct().count() == 80
    assert multi_index.nearest(df.where("vec_id = 5"), F.lit(True)).count() == 0
    assert multi_index.nearest(df.where("vec_id in (5, 6)"), F.lit(True)).count() == 2
    empty = multi_index.nearest(df.where("vec_id >= 200 and vec_id <> 205 and vec_id <> 206"), F.lit(True))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_queries_that_meet_too_few_are_compared_with_all(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(multi_index, "WIDTHS", (6,))
    monkeypatch.setattr(multi_index, "BITS", 0)
    got = multi_index.nearest(df, F.col("vec_id") % 3 == 0, k=40, room=5).collect()
    true = exact(dict(rows), range(0, 300, 3), 40)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(t[:3] for t in true)


def edits(word, letters):
    cuts = range(len(word) + 1)
    return {word[:i] + word[i + 1 :] for i in cuts[:-1]} | {word[:i] + c + word[i + d :] for i in cuts for c in letters for d in (0, 1)} - {word}


def variants(rows, least=7, least_count=2, ratio=10, every=31):
    """word -> (form, root, n, n_near, form_n) in plain Python."""
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall(f"{LETTER}+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            at = h % len(word)
            counts[word[:at] + word[at + 1 :] if h % every == 0 else word] += 1
    held = {w: n for w, n in counts.items() if len(w) >= least and n >= least_count}
    letters = sorted({c for w in held for c in w})
    out = {}
    for w, n in held.items():
        near = [x for x in edits(w, letters) if x in held and x != w]
        best = min(near, key=lambda x: (-held[x], x), default=None)
        form = best if best and held[best] >= ratio * n else None
        out[w] = [form, w, n, len(near), held[form] if form else None]
    for w, found in out.items():
        while out[found[1]][0]:
            found[1] = out[found[1]][0]
    return {w: tuple(x) for w, x in out.items()}


def grouped(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect()}


def test_variants(docs):
    got = grouped(spelling.word_counts(docs, LETTER, 7, 31))
    assert got == variants([(r.doc_id, r.text) for r in docs.collect()]) and any(x[0] for x in got.values())


def test_variants_hard(spark, hard):
    assert grouped(spelling.word_counts(hard, LETTER, 7, 31)) == variants(HARD)
    assert grouped(spelling.word_counts(hard.where("false"), LETTER, 7, 31)) == {}
    chain = [("kkkkkkkaaaa", 20_000), ("kkkkkkkaaa", 2000), ("kkkkkkkaa", 200), ("kkkkkkka", 20), ("kkkkkkk", 2), ("lllllll", 5), ("lllllla", 50), ("llllllb", 50), ("kkkkkkk", 0), (None, 9), ("short", 9)]
    got = grouped(spark.createDataFrame(chain, "word string, n bigint"))
    assert got["kkkkkkk"] == ("kkkkkkka", "kkkkkkkaaaa", 2, 1, 20) and got["kkkkkkkaaaa"] == (None, "kkkkkkkaaaa", 20_000, 1, None)
    assert got["lllllll"] == ("lllllla", "lllllla", 5, 2, 50) and len(got) == 8


def test_near_pairs_of_random_words(spark):
    rng = random.Random(1)
    letters = "abcdeß€漢"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(1500)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    got = sorted((r.a, r.b) for r in spelling.near_pairs(df).collect())
    assert got == sorted((w, x) for w in words for x in edits(w, letters) if x in words and w < x)
