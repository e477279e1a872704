"""The pipeline against plain Python from its second stage on, and its stages on hard tables."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillspark.llm import entropy_mix  # noqa: E402
from quillspark.session import staged  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(spark, good):
    """Rows that the pipeline makes of what its first stage kept (test_methods holds that stage against numpy)."""
    first = {}
    for r in sorted(good.collect()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    docs = {r.doc_id: r for r in first.values()}
    sets, root = {i: shingles(r.text or "") for i, r in docs.items()}, {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    docs = {i: r for i, r in docs.items() if top(i) == i}

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    total, count = defaultdict(int), defaultdict(int)
    for i, r in docs.items():
        total[r.source] += size[i]
        count[r.source] += 1
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # fill up sources whose share is above twice their size, one by one
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            open_.remove(s)
    target |= share
    ids = spark.createDataFrame([(i, size[i]) for i in docs], "i bigint, n bigint")
    hashes = {r.i: r.h for r in ids.select("i", F.xxhash64("i", "n").alias("h")).collect()}
    copies, blocks = {}, defaultdict(list)
    for i, r in docs.items():
        blocks[r.source, hashes[i] % math.ceil(count[r.source] / entropy_mix.BLOCK)].append(i)
    for (s, _), some in blocks.items():
        rate, carried = round(target[s] / total[s], 9) if total[s] else 1.0, 0.0
        for i in sorted(some, key=lambda i: (-size[i], hashes[i], i)):
            if not size[i]:
                copies[i] = math.floor(rate + 0.5)
                continue
            due = rate * size[i] + carried
            copies[i] = min(max(math.floor(due / size[i] + 0.5), math.floor(rate)), math.ceil(rate))
            carried = due - copies[i] * size[i]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    out = []
    for i, r in docs.items():
        found = library.encode(r.text or "", add_special_tokens=False).ids
        row = (i, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(found, skip_special_tokens=False).encode()).hexdigest())
        out += [row] * copies[i]
    return sorted(out)


def test_run_by_brute_force(spark):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    good, _ = staged(corpus_pipeline.quality(spark, start, SF), "test")
    assert 0 < good.count() < start.count() and good.columns == start.columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == by_hand(spark, good)


def test_hard_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    odd = odd.withColumn("_copies", F.lit("clash")).withColumn("size", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = staged(stage(spark, odd, SF), "test")[0]
        assert odd.columns == [*docs.columns, "_copies", "size"]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
