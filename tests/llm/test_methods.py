"""Fits and roundings against plain numpy and Python versions of the same methods."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from quillspark.llm import entropy_mix, rff_quality, zstd_lang  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_mix_meets_the_optimality_conditions(docs, spark):
    """With base rates: rate = min(cap, base * exp(dual)) with one dual a source, and the targets are met exactly."""
    rows = docs.select("doc_id", "source", entropy_mix.words(F.col("text")).alias("size")).withColumn("base", F.element_at(F.array(*map(F.lit, (0.0, 0.5, 1.0, 3.0))), (F.col("doc_id") % 4 + 1).cast("int")))
    kept = rows.select(F.col("source").alias("s"), "size", "base")
    sizes = kept.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.sum(F.when(F.col("base") > 0, F.col("size"))).alias("reach"))
    share = F.element_at(F.array(*map(F.lit, (0.1, 0.9, 1.9, 5.0))), (F.crc32(F.col("s").cast("binary")) % 4 + 1).cast("int"))
    goal = sizes.select("s", "source_size", "docs", (F.coalesce("reach", F.lit(0)) * share).alias("target"))
    found = {r.s: r for r in entropy_mix.duals(kept, goal).collect()}
    taken, reach, bent = defaultdict(float), defaultdict(float), 0
    for r in kept.collect():
        if r.base and r.size:
            rate = min(2.0, r.base * math.exp(found[r.s].dual))
            bent += rate == 2.0
            taken[r.s] += rate * r.size
            reach[r.s] += 2.0 * r.size
    assert bent
    for s, r in found.items():
        assert math.isclose(taken[s], min(r.target, reach[s]), rel_tol=1e-6), s


def test_equal_base_rates_have_the_closed_form(docs):
    sizes = docs.select(F.col("source").alias("s"), entropy_mix.words(F.col("text")).alias("size"), F.lit(1.0).alias("base"))
    goal = entropy_mix.targets(sizes.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    for r in entropy_mix.duals(sizes, goal).collect():
        assert math.isclose(min(2.0, math.exp(r.dual)), r.target / r.source_size, rel_tol=1e-9)


def test_copies_by_hand(docs):
    """Rates and copies again in plain Python, block by block."""
    found = {r.doc_id: r for r in entropy_mix.mix(docs).collect()}
    hashed = {r.doc_id: r for r in docs.select("doc_id", "source", F.xxhash64("doc_id", entropy_mix.words(F.col("text"))).alias("h")).collect()}
    blocks = defaultdict(list)
    of = defaultdict(int)
    for r in hashed.values():
        of[r.source] += 1
    for i, r in hashed.items():
        blocks[r.source, r.h % math.ceil(of[r.source] / entropy_mix.BLOCK)].append(i)
    for (_, _), ids in blocks.items():
        carried = 0.0
        for i in sorted(ids, key=lambda i: (-found[i].size, hashed[i].h, i)):
            rate = round(found[i].target / found[i].source_size, 9)
            if not found[i].size:
                continue
            due = rate * found[i].size + carried
            n = min(max(math.floor(due / found[i].size + 0.5), math.floor(rate)), math.ceil(rate))
            carried = due - n * found[i].size
            assert found[i].copies == n


def test_quality_by_numpy(spark, docs):
    """Random features, normal equations, ridge and pooled bins without Spark."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = {i: rff_quality.statistics(t.encode()).astype(np.float32).astype(np.float64) for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    learn = [i for i in labels if i in x and fold[i] > 1]
    held = [i for i in labels if i in x and fold[i] == 1]
    m = np.stack([x[i] for i in learn])
    scale = m.std(axis=0)
    model = rff_quality.Model(m.mean(axis=0), np.where(scale > 1e-9, scale, 1.0))
    z = np.clip((m - model.mean) / model.scale, -8, 8)
    phi = np.hstack([np.sqrt(2 / rff_quality.FEATURES) * np.cos(z @ model.waves + model.phase), np.ones((len(z), 1))])
    y = np.array([float(labels[i]) for i in learn])
    ridge = np.diag([rff_quality.RIDGE * len(learn) / rff_quality.FEATURES] * rff_quality.FEATURES + [0.0]) + 1e-9 * np.eye(phi.shape[1])
    model.weights = np.linalg.solve(phi.T @ phi + ridge, phi.T @ y)
    bins = defaultdict(list)
    for i in held:
        bins[math.floor((model.raw(x[i][None])[0] + 1) / 3 * rff_quality.BINS)].append(float(labels[i]))
    at = sorted(bins)
    values = [np.mean(bins[b]) for b in at]
    weights = [len(bins[b]) for b in at]
    # Isotonic regression by its min-max formula.
    fitted = [max(min(np.average(values[i : j + 1], weights=weights[i : j + 1]) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    got = {r.doc_id: r for r in rff_quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    centres = [(b + 0.5) / rff_quality.BINS * 3 - 1 for b in at]
    for i in texts:
        raw = model.raw(x[i][None])[0]
        near = [v for c, v in zip(centres, fitted, strict=True) if abs(c - raw) <= 2.0]
        assert min(near, default=0) - 1e-6 <= got[i].score <= max(near, default=1) + 1e-6
        assert got[i].held_out == (fold[i] == 0) and got[i].predicted == (got[i].score >= 0.3)
    # In the middle of a pool the score is the pool's value.
    order = sorted(texts, key=lambda i: model.raw(x[i][None])[0])
    scores = [got[i].score for i in order]
    assert all(a <= b + 1e-6 for a, b in zip(scores, scores[1:], strict=False))
    assert {round(v, 6) for v in fitted} >= {round(min(scores), 6), round(max(scores), 6)}


def test_language_sizes_by_plain_zstandard(docs):
    known = zstd_lang.fit(docs, F.lit(True))
    model = zstd_lang.Classifier(known)
    for r in docs.limit(25).collect():
        raw = r.text.lower().encode()
        if not zstd_lang.LETTER.search(r.text):
            continue
        sizes = {}
        for lang, content in known.items():
            packer = zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=zstd_lang.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            sizes[lang] = sum(len(packer.compress(raw[i : i + zstd_lang.BLOCK])) for i in range(0, len(raw), zstd_lang.BLOCK))
        lang, _, _, found = model.predict(r.text)
        best = min(sizes.values())
        assert sizes[lang] <= best + 8 * (1 + len(raw) // zstd_lang.BLOCK) and all(abs(a - b) <= 0.02 * b + 8 for a, b in zip(found, sizes.values(), strict=True))


def test_language_fit_on_the_hard_table(spark):
    rows = [(None, "ein text", "de"), (1, None, "de"), (2, "a text", None), (3, "", "en"), (3, "", "en"), (4, "same text", "en"), (4, "same text", "en"), (5, "long " * 50_000, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("h", F.lit("clash")).withColumn("t", F.lit("clash"))
    known = zstd_lang.fit(df, F.lit(True))
    # Equal texts teach once, a text beyond the budget nothing.
    assert known["de"] == b"ein text" and sorted(known["en"].split(b"\n")) == [b"", b"same text"]
    assert zstd_lang.fit(df.limit(0), F.lit(True)) == {}
    assert zstd_lang.Classifier({}).predict("text")[0] == zstd_lang.UNKNOWN
