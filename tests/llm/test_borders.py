"""Sizes at which methods once changed: nothing changes there now."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quillspark.llm import content_sort, huffman, pair_bpe, prefix_hash, simhash, zstd_lang  # noqa: E402
from quillspark.session import staged  # noqa: E402


def test_likeness_at_all_lengths():
    """Three parts of the share of spans of 16 code points and one of spans of 4, for any two lengths, without a jump."""
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(97, 123, 3000)))
    lengths = (3, 10, 17, 40, *range(58, 72), 255, 256, 257, 400)
    prints = {n: prefix_hash.Prefixes(text[:n]).fingerprint() for n in lengths}
    spans = lambda t, width: {t[i : i + width] for i in range(max(1, len(t) - width + 1))}

    def dice(n, m, width):
        one, two = spans(text[:n], width), spans(text[:m], width)
        return 2 * len(one & two) / (len(one) + len(two))

    for n in lengths:
        for m in lengths:
            true = 0.75 * dice(n, m, 16) + 0.25 * dice(n, m, 4)
            assert abs(prefix_hash.likeness(prints[n], prints[m]) - true) < (0.25 if n != m else 1e-12)
    last = None
    for n in range(56, 76):  # the same edit on beginnings of one text
        found = prefix_hash.likeness(*(prefix_hash.Prefixes(t).fingerprint() for t in (text[:n], text[: n - n // 4] + "_" * (n // 4))))
        assert last is None or abs(found - last) < 0.08
        last = found
    assert prefix_hash.likeness(prefix_hash.Prefixes("").fingerprint(), prints[40]) == 0


@pytest.mark.parametrize("used", [65_535, 65_536, 65_537, 70_000, 200_000])
def test_codes_of_large_vocabularies(used):
    rng = np.random.default_rng(used)
    counts = rng.integers(1, 1000, used)
    lengths = huffman.code_lengths(counts)
    assert (lengths > 0).all() and lengths.max() <= max(16, (used - 1).bit_length()) and abs((2.0 ** -lengths.astype(float)).sum() - 1) < 1e-9
    code, docs = huffman.Code(lengths), np.array([3, 0, 700, 5000])
    ids = rng.integers(0, used, docs.sum())
    ids[:2] = [0, used - 1]
    payload, _, checks = code.encode(ids, docs)
    assert (code.decode(payload, checks, docs) == ids).all()


def test_bpe_with_ids_beyond_16_bits(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {t: i * 3 + 70_000 for t, i in spec["model"]["vocab"].items()}
    for t in spec["added_tokens"]:
        t["id"] = t["id"] * 3 + 70_000
    path = str(tmp_path / "wide.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library, own = Tokenizer.from_file(path), pair_bpe.PairBpe(path)
    library.no_truncation()
    library.no_padding()
    for text in ("the quick brown fox's jumping over 12 lazy dogs, unbelievably!", "Donaudampfschifffahrt übermäßig", "漢字 😀 x²", "a"):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_language_of_texts_around_200_bytes():
    model = zstd_lang.Classifier({"de": b"der die das und ist nicht ein eine zu mit auf " * 9, "en": b"the and of to in is that it was for on with " * 9})
    for n in (60, 199, 200, 201, 500):
        assert model.predict(("the and of to in is that it was for " * 20)[:n])[0] == "en"


def test_dictionaries_read_whole_texts(spark):
    """Texts of a sample are whole, and as many as the budget holds."""
    rows = [(k, f"{k} " + "x" * 5000 + "y" * 5000, "en") for k in range(60)]
    known = zstd_lang.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))["en"]
    lines = known.decode().split("\n")
    assert set(lines) <= {r[1] for r in rows} and len(lines) == len(set(lines)) == zstd_lang.BUDGET // 10_003


def test_candidates_of_random_fingerprints(spark):
    """Unlike fingerprints hardly meet: about 2 * 17 / 2**32 of all pairs."""
    rng = np.random.default_rng(6)
    prints = rng.integers(-(1 << 63), (1 << 63) - 1, 40_000)
    met = simhash.met(spark.createDataFrame([(int(p),) for p in prints], "fp bigint")).count()
    assert met < 60


def test_cells_are_not_broadcast(spark):
    """Probes are 34 times the fingerprints, which the estimate of their size does not show."""
    prints, _ = staged(spark.range(0, 20_000, 1, 2).select(F.xxhash64("id").alias("fp")), "test")
    met = simhash.met(prints)
    assert met.count() < 60
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_splitters_of_rows_without_ids(spark, monkeypatch):
    """Rows that all lack an id are sampled like any others."""
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("_id"), F.sha2(F.col("id").cast("string"), 256).alias("_h"))
    rows = df.withColumn("_k", F.struct(F.substring("_h", 1, 8).alias("p"), F.col("_h").alias("h"), F.lit(True).alias("o"), F.col("_id").alias("i")))
    monkeypatch.setattr(content_sort, "SAMPLE_PER_RANGE", 16)
    splitters, cut = content_sort._splitters(rows, 4)
    sizes = [r["count"] for r in rows.groupBy(content_sort.range_of(F.col("_k"), splitters).alias("b")).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 12_000 and not cut
