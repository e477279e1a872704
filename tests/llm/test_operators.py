"""The training-data operators against brute force, and every operator on hard tables."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from quillspark.llm import content_sort, entropy_mix, gear_chunks, huffman, pair_bpe, prefix_hash, rff_quality, simhash, warc, zstd_lang  # noqa: E402
from quillspark.operators.components import components  # noqa: E402
from quillspark.llm.word_cache import word_encoder  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "".join(chr(97 + k * k % 23) * (k % 3 + 1) + " " * (k % 5 == 0) for k in range(60_000))
HARD = [
    (0, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", "b"), (3, "Hello  world\n again", "en", "a"),
    (4, "Hello world again", "fr", "a"), (4, "Hello world again", "fr", "a"), (5, LONG, "en", None), (6, LONG, None, "c"),
    (None, "Hello\tworld again", "en", "a"), (None, None, None, None), (7, "1234 !!", "en", "b"), (8, "漢字 😀 <|endoftext|> x²", "zh", "b"),
    (9, "a", "en", "a"), (10, "a", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, SCHEMA)
    for name in ("size", "fp", "h", "_id", "_t", "n", "s", "digest", "count"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_prefix_hashes():
    a, b = prefix_hash.Prefixes("xx the cat sat on the mat"), prefix_hash.Prefixes("the cat sat in the hat" * 9000)
    assert a.span(3, 10) == b.span(0, 7) == b.span(22, 29)
    assert a.same(3, b, 22 * 8000, 12) and not a.same(3, b, 22 * 8000, 14)
    assert a.extension(3, b, 22 * 8999) == len("the cat sat ")
    assert b.extension(0, b, 22) == b.n - 22
    assert prefix_hash.Prefixes("").fingerprint() == prefix_hash.Prefixes("").fingerprint()
    whole = prefix_hash.Prefixes(LONG[:70_000])
    spans = {whole.span(i, i + 16)[0] for i in range(whole.n - 15)}
    mixed = sorted({(s * int(prefix_hash.SPREAD) % (1 << 64)) >> 32 for s in spans})[: prefix_hash.KEEP]
    assert whole.sketch(16).tolist() == mixed


def test_fingerprints(docs, rows):
    found = {r.doc_id: r for r in prefix_hash.fingerprints(docs).collect()}
    assert len(found) == len(rows)
    for row, after in zip(rows, rows[1:] + rows[:1], strict=True):
        text, cut, r = row["text"], len(row["text"]) // 4, found[row["doc_id"]]
        new = text[: len(text) - cut] + after["text"][:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == prefix_hash.Prefixes(text).fingerprint() and r.edited_fingerprint == prefix_hash.Prefixes(new).fingerprint()
        same = next((k for k, (x, y) in enumerate(zip(text, new, strict=False)) if x != y), min(len(text), len(new)))
        assert r.common_prefix == same
        if len(text) > 400 and len(new) > 0.9 * len(text):
            true = 0.0
            for width, share in ((16, 0.75), (4, 0.25)):
                one, two = ({t[i : i + width] for i in range(len(t) - width + 1)} for t in (text, new))
                true += share * 2 * len(one & two) / (len(one) + len(two))
            assert abs(r.near_edited - true) < 0.25
        assert 0 <= r.near_next <= 1


def test_fingerprints_hard(hard, nothing):
    found = prefix_hash.fingerprints(hard).collect()
    assert len(found) == len(HARD) and prefix_hash.fingerprints(nothing).count() == 0
    order = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = sorted(
        hashlib.sha256(prefix_hash.edited(a[1] or "", b[1] or "").encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1], strict=True)
    )
    assert sorted(r.edited_sha256 for r in found) == want
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.fingerprint)
    assert by[5] == by[6] and by[9] == by[10] and by[1] == by[0]


def test_substring_dedup(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))
    passage = text(60)
    made = [(k, f"{text(40)} {passage} {text(30)}" if k % 3 == 0 else text(120)) for k in range(60)]
    found = gear_chunks.substring_dedup(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in found} == set(range(0, 60, 3))
    kept = {}
    for r in found:
        raw = made[r.doc_id][1].encode()[r.start_byte : r.start_byte + r.n_bytes]
        assert raw in f" {passage} ".encode() and r.kept == (r.first_id == r.doc_id) and 2 <= r.copies <= 20
        kept.setdefault(r.kept, []).append(raw)
    assert max(map(len, kept[True])) >= 150 and sum(map(len, kept[True])) < 2 * len(passage)
    whole = defaultdict(int)
    for r in found:
        whole[r.doc_id] += r.n_words
    assert min(whole.values()) >= gear_chunks.WORDS


def test_substring_dedup_hard(hard, nothing):
    assert {r.doc_id for r in gear_chunks.substring_dedup(hard).collect()} == {5, 6}
    assert gear_chunks.substring_dedup(nothing).count() == 0


def test_language(docs, hard, nothing):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    known = zstd_lang.fit(docs, ~held_out)
    assert list(known) == ["de", "en", "es", "fr"]
    found = zstd_lang.predict(docs, known, {"doc_id": F.col("doc_id"), "held_out": held_out}).join(docs, "doc_id")
    assert found.where("held_out and length(text) > 100").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    rows = zstd_lang.predict(hard, known, {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(rows) == len(HARD)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in known) == letters and (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert zstd_lang.fit(nothing, F.lit(True)) == {}
    assert {r.lang_pred for r in zstd_lang.predict(hard, {}, {"doc_id": F.col("doc_id")}).collect()} == {"und"}


def targets_by_rounds(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in names}
        capped |= over


def test_mix(docs, rows):
    found = {r.doc_id: r for r in entropy_mix.mix(docs).collect()}
    sizes, source = defaultdict(int), {r["doc_id"]: r["source"] for r in rows}
    for r in rows:
        n = len(WORDS.findall(r["text"]))
        sizes[r["source"]] += n
        assert found[r["doc_id"]].size == n
    want, taken = targets_by_rounds(sizes), defaultdict(int)
    for k, r in found.items():
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2 and r.source_size == sizes[source[k]]
        assert math.isclose(r.target, want[source[k]], rel_tol=1e-9)
        taken[source[k]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 60 for s in sizes)
    assert {k: r.taken for k, r in found.items()} == {r.doc_id: r.taken for r in entropy_mix.mix(docs.repartition(5)).collect()}


def test_mix_hard(hard, nothing):
    found = entropy_mix.mix(hard).collect()
    assert len(found) == len(HARD) and entropy_mix.mix(nothing).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in found)


def test_quality(docs, spark, hard, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = rff_quality.quality_scores(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    known = [(r.score, truth[r.doc_id]) for r in found if r.doc_id in truth]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in known for b, z in known if y > z]
    assert sum(pairs) / len(pairs) > 0.9
    assert len(rff_quality.quality_scores(hard, labels).collect()) == len(HARD)
    assert {r.score for r in rff_quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert rff_quality.quality_scores(nothing, labels).count() == 0


def test_isotonic():
    at, value = rff_quality.isotonic(np.arange(5.0), np.ones(5), np.array([0.1, 0.5, 0.3, 0.2, 0.9]))
    assert value.tolist() == pytest.approx([0.1, 1 / 3, 0.9]) and at.tolist() == [0, 2, 4]


def test_huffman_code():
    rng = np.random.default_rng(1)
    counts = (rng.zipf(1.3, 5000) % 100_000).astype(np.int64)
    lengths = huffman.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= huffman.LIMIT and (2.0**-used).sum() <= 1 and (lengths > 0).sum() == (counts > 0).sum()
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16]), 3).tolist() == [3, 3, 3, 3, 2, 2]
    code, docs = huffman.Code(lengths), np.array([0, 1, 255, 256, 257, 5000, 0])
    ids = rng.choice(np.flatnonzero(counts), docs.sum())
    payload, offsets, checks = code.encode(ids, docs)
    assert (code.decode(payload, checks, docs) == ids).all() and offsets[-1] == len(payload)
    alone = offsets[5]
    assert (code.decode(payload[alone : offsets[6]], checks[-20:] - np.uint64(8 * alone), np.array([5000])) == ids[-5000:]).all()


def test_huffman_files(docs, rows, hard, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = word_encoder(path).library
    files = huffman.write(docs, lambda: word_encoder(path), word_encoder(path).size, end=2)
    found = {r.doc_id: r for r in huffman.read(files).collect()}
    start = 0
    for r in rows:
        raw = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (found[r["doc_id"]].start, found[r["doc_id"]].n_tokens, found[r["doc_id"]].ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    files = huffman.write(hard, lambda: word_encoder(path), word_encoder(path).size, end=2)
    got = sorted(huffman.read(files, ids=True).collect(), key=lambda r: r.start)
    want = sorted((r[0] is not None, r[0] or 0, [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in HARD)
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert huffman.read(huffman.write(nothing, lambda: word_encoder(path), word_encoder(path).size, end=2)).count() == 0


def fingerprint_by_hand(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_by_hand(pairs):
    prints = [(i, fingerprint_by_hand(t)) for i, t in pairs]
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    low = {}
    for i, f in prints:
        if i is not None:
            low[root(f)] = min(low.get(root(f), i), i)
    return sorted(((i is None, i or 0, f"{f:016x}", low[root(f)]) for i, f in prints))


def test_simhash(docs, rows, hard, nothing):
    some = [(r["doc_id"], r["text"]) for r in rows]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_dedup(docs).collect())
    assert got == near_by_hand(some)
    pairs = [(r[0], r[1]) for r in HARD]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_dedup(hard).collect()) == near_by_hand(pairs)
    assert simhash.near_dedup(hard).count() == len(HARD) and simhash.near_dedup(nothing).count() == 0


def test_simhash_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 200, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 6, 200)], np.uint64)
    prints = sorted({*base.tolist(), *(base ^ flips).tolist(), 0, 1, (1 << 64) - 1, 1 << 63})
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp bigint")
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(df).collect()}
    assert got == {frozenset((a, b)) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 3}


def test_components(spark):
    links = [(k, k + 1) for k in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    found = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert len({found[k] for k in range(101)}) == 1 and len({found[k] for k in (200, 201, 202)}) == 1 and found[0] != found[200]
    assert 300 not in found and components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_bpe(docs, rows, hard, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = pair_bpe.pair_bpe(path).library

    def want(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return (i is None, i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())

    got = lambda df: sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in pair_bpe.round_trip(df, path).collect())
    assert got(docs) == sorted(want(r["doc_id"], r["text"]) for r in rows)
    assert got(hard) == sorted(want(r[0], r[1]) for r in HARD)
    assert got(nothing) == []


def test_exact_dedup(docs, hard, nothing, spark):
    def want(pairs):
        groups = defaultdict(list)
        for i, t in pairs:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        low = {t: min((i for i in v if i is not None), default=None) for t, v in groups.items()}
        return sorted((str(i), str(low[t]), len(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for i in v), len(groups)

    for df in (docs, hard):
        for parts in ("1", "4", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found = content_sort.exact_dedup(df).collect()
            expected, groups = want([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
            assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == expected
            assert sum(r.kept for r in found) == groups and all(r.doc_id == r.keep_id for r in found if r.kept)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    kept = content_sort.distinct_rows(hard)
    assert kept.columns == hard.columns and kept.count() == want([(r[0], r[1]) for r in HARD])[1]
    assert content_sort.exact_dedup(nothing).count() == 0


def test_exact_dedup_cuts_hot_groups(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same  text")).otherwise(F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    found = content_sort.exact_dedup(df)
    assert found.where("keep_id = 1").agg(F.count("*"), F.min("group_size"), F.sum(F.col("kept").cast("int"))).first() == (1333, 1333, 1)
    assert found.where("kept").count() == 668
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_warc(spark):
    body = "<html>é" + "x" * 120
    made = [(1, "http://a/ b\r\nX", body), (2, "http://b", body), (0, None, "short"), (3, "u", "short"), (4, "u", None), (None, "u", body), (5, "u", body + "!"), (6, "u", ""), (1, "again", body)]
    pages = spark.createDataFrame(made, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write(pages)
    assert index.count() == len(made)
    got = sorted(warc.read(index, payloads=True).collect(), key=str)
    want = []
    for i, _, html in made:
        raw = (html or "").encode()
        first = 1 if html == body and i != 1 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first else "response", first, None if first else raw))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got)
    assert {r.page_id for r in warc.read(index, F.col("_id") == 5).collect()} == {5}
    assert warc.read(warc.write(pages.limit(0))).count() == 0
