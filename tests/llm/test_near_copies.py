"""The pipeline's near-dedup against every pair of texts compared by hand."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from quillspark.llm import near_copies  # noqa: E402
from quillspark.operators.components import components  # noqa: E402
from quillspark.session import staged  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows):
    """Smallest id of each row's component, rows of (id, text) with different ids."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i: top(i) for i in root}


def made():
    """A group whose members are often alike only through others, a pair at 0.8, a pair below, short and empty texts."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = words(150)
    texts = []
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 5)):
            copy[at] = words(1)[0]
        texts.append(copy)
    start, more = words(12), words(13)
    texts += [start, [*start, *words(2)], more, [*more, *words(3)], words(3), [], []]  # 8 of 10, 9 of 12 shingles
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_stage_finds_similar_texts(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = by_hand(rows)
    assert want[41] == 40 and want[43] == 43
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == set(want.values())


def test_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = by_hand([tuple(r) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    odd = docs.limit(3).unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, "one two"), (None, "One two"), (7000, None)], docs.schema))
    found = near_copies.near_copies(odd).collect()
    assert len(found) == 7 and sum(r.component_id is None for r in found) == 2
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_groups_without_a_common_leader(spark):
    """Members that changed too much for their leader still find each other, and no others."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, rows = words(120), []
    for _ in range(60):
        far = list(base)
        for at in rng.sample(range(120), rng.randrange(2, 12)):
            far[at] = words(1)[0]
        rows.append(far)
        for _ in range(rng.randrange(0, 3)):  # copies of that copy
            near = list(far)
            near[rng.randrange(120)] = words(1)[0]
            rows.append(near)
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    want = by_hand(rows)
    assert len(set(want.values())) > 10
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


def test_simhashes_meet_without_bands(spark):
    """Where no band proposes anything, op7's grid join alone links the similar sets with a half at most one bit apart."""
    rng = random.Random(17)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(4):
        base = words(300)
        for _ in range(12):
            copy = list(base)
            for at in rng.sample(range(300), rng.randrange(1, 7)):
                copy[at] = words(1)[0]
            rows.append((len(rows), " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    hashes = {i: [xxhash.xxh64_intdigest(x, 42) for x in s] for i, s in sets.items()}
    sims = {i: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for i, hs in hashes.items()}
    assert len(set(sims.values())) == len(rows)
    meet = lambda a, b: min(((a ^ b) & 0xFFFFFFFF).bit_count(), ((a ^ b) >> 32).bit_count()) <= 1
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and meet(sims[i], sims[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                low, high = sorted((top(i), top(j)))
                root[high] = low
    want = {frozenset(j for j in root if top(j) == top(i)) for i in root}

    df = spark.createDataFrame(rows, "_id bigint, _t string")
    docs, _ = staged(near_copies.prints(df, 5).withColumn("bands", F.array().cast("array<bigint>")), "test")
    groups, _ = staged(docs.groupBy("fp").agg(F.min("_id").alias("rep"), F.count("*").alias("n"), F.min("size").alias("size"), F.min("sim").alias("sim")), "test")
    found = components(near_copies.links(docs, groups, near_copies.Texts(df, groups, 5), 0.8))
    parts = {}
    for r in found.join(groups, F.col("vertex") == F.col("fp")).collect():
        parts.setdefault(r.component, set()).add(r.rep)
    assert {frozenset(x) for x in parts.values()} == {x for x in want if len(x) > 1} and any(len(x) > 2 for x in want)
