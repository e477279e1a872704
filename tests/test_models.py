"""Batched embedding and calls to models that are slow or fail."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.operators import models


class Counting:
    """A fake embedder that writes down its loads and batches."""

    def __init__(self):
        self.note("load")

    @staticmethod
    def note(text):
        with open(os.path.join(os.environ["QUILLSPARK_TEST_NOTES"], f"{uuid.uuid4().hex}"), "w") as f:
            f.write(text)

    def tokens(self, text):
        return [ord(c) % 50 for c in text]

    def encode(self, lists):
        self.note(f"batch {len(lists)} {max(map(len, lists))}")
        return [([float(len(x)), 1.0], {t: float(x.count(t)) if t else 0.0 for t in x}) for x in lists]


@pytest.fixture
def notes(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    env, before = spark.sparkContext.environment, dict(spark.sparkContext.environment)
    env["QUILLSPARK_TEST_NOTES"] = str(folder)
    env["PYTHONPATH"] = os.pathsep.join(filter(None, [os.getcwd(), env.get("PYTHONPATH", "")]))
    yield lambda: [p.read_text() for p in folder.iterdir()]
    env.clear()
    env.update(before)


def test_embedding_in_batches(spark, notes):
    rows = [(k, "abcd2" * (k % 37) if k % 50 else None) for k in range(600)] + [(600, "x" * 5000)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(1)
    found = {r.k: r for r in models.embedded(df, "t", Counting, most=100, tokens=400, texts=16).collect()}
    assert len(found) == 601 and found[600].dense[0] == 100 and found[50].dense is None and found[50].sparse is None
    assert found[3].dense == [15.0, 1.0] and found[3].sparse == {ord("a") % 50: 3.0, ord("b") % 50: 3.0, ord("c") % 50: 3.0} and found[37].sparse == {}
    seen = notes()
    sizes = [tuple(map(int, s.split()[1:])) for s in seen if s.startswith("batch")]
    assert seen.count("load") == 1 and sum(n for n, _ in sizes) == 589
    assert all(n <= 16 and (n * m <= 400 or n == 1) for n, m in sizes) and len(sizes) < 200
    assert models.embedded(df.where("false"), "t", Counting).count() == 0 and notes().count("load") == 1


def test_batches():
    assert list(models.batches_of([5, 1, 9, 1, 5], 10, 3)) == [[1, 3], [0, 4], [2]]
    assert list(models.batches_of([100], 10, 3)) == [[0]] and list(models.batches_of([], 10, 3)) == []


def slow(request):
    time.sleep(0.2)
    return request.upper()


def flaky(request):
    """Fails the first two times, or always, as the request says."""
    Counting.note(f"call {request}")
    folder = os.environ["QUILLSPARK_TEST_NOTES"]
    calls = sum(open(os.path.join(folder, p)).read() == f"call {request}" for p in os.listdir(folder))
    if request == "never" or (request == "late" and calls < 3):
        raise ConnectionError("no answer")
    return f"said {request}"


def test_calls_run_at_once(spark):
    df = spark.createDataFrame([(k, f"r{k}" if k else None) for k in range(33)], "k int, r string").repartition(1)
    models.answered(df.limit(1), "r", slow).collect()
    begun = time.time()
    found = models.answered(df, "r", slow, at_once=16).collect()
    assert time.time() - begun < 32 * 0.2 and {r.k: r.answer for r in found} == {k: f"R{k}" if k else None for k in range(33)}


def test_failures_and_the_cache(spark, notes, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "late"), (3, "never"), (4, None), (5, "")], "k int, r string").withColumn("answer_", F.lit(1)).repartition(2)
    path = str(tmp_path / "cache")
    ask = lambda label="m": {r.k: (r.answer, r.error) for r in models.cached(df, "r", flaky, path, label, parallel=2, tries=3, wait=0.01).collect()}
    first = ask()
    assert first == {0: ("said a", None), 1: ("said a", None), 2: ("said late", None), 3: (None, "ConnectionError: no answer"), 4: (None, None), 5: ("said ", None)}
    calls = notes()
    assert (calls.count("call a"), calls.count("call late"), calls.count("call never")) == (1, 3, 3)
    assert ask() == first and notes().count("call a") == 1 and notes().count("call never") == 6
    assert ask("another model")[0] == ("said a", None) and notes().count("call a") == 2
