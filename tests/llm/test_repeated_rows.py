"""Shared passages of documents whose rows are there more than once."""

import random

from quillspark.llm import gear_chunks


def test_substring_dedup_repeated_rows(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = words(100)
    one, two, other = (f"{words(80)} {shared} {words(60)}" for _ in range(3))
    find = lambda rows: sorted(map(tuple, gear_chunks.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).drop("copies").collect()))
    once = find([(1, one), (2, two)])
    assert {r[0] for r in once} == {1, 2} and all(r[2] > len(shared) * 0.8 for r in once)
    assert find([(1, one), (2, two), (1, one), (2, two), (2, two)]) == once
    # Two texts of one id: each has its own spans.
    both = find([(1, one), (2, two), (2, other)])
    assert [r[0] for r in both] == [1, 2, 2] and all(r[2] > len(shared) * 0.8 for r in both)
