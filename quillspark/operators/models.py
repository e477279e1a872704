"""Calls to models from tasks: embedding in batches by tokens, and calls to services with concurrency, retries and a cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import dropped, exists, new_path, staged

#: Tokens of a chunk and of a query that an embedder reads, of a batch, and texts of a batch.
TEXT_TOKENS, QUERY_TOKENS, BATCH_TOKENS, BATCH_TEXTS = 2048, 512, 16_384, 64
#: Calls of a task that run at once, tries of each, and seconds before the second try, doubled each time.
AT_ONCE, TRIES, WAIT = 8, 3, 0.5
#: Texts that a task holds to sort them by length, and calls whose results it holds.
WINDOW, HELD = 4096, 256


@lru_cache(maxsize=2)
def loaded(load: Callable[[], object]) -> object:
    """What load gives, once a worker however many tasks and batches it serves."""
    return load()


def batches_of(lengths: list[int], tokens: int, texts: int) -> Iterator[list[int]]:
    """Places of texts in batches of texts of like length: no batch pads to over tokens, unless one text does."""
    batch: list[int] = []
    for at in sorted(range(len(lengths)), key=lengths.__getitem__):
        # Ascending: the new text is the longest, to which all are padded.
        if batch and (len(batch) == texts or (len(batch) + 1) * lengths[at] > tokens):
            yield batch
            batch = []
        batch.append(at)
    if batch:
        yield batch


def embedded(rows: DataFrame, text: str, load: Callable[[], object], most: int = TEXT_TOKENS, tokens: int = BATCH_TOKENS, texts: int = BATCH_TEXTS) -> DataFrame:
    """rows with dense array<float> and sparse map<int,float> of column text, both from one pass of a model.

    load, a function of a module, gives a model once a worker: ``model.tokens(text)`` a list of token ids and
    ``model.encode(lists)`` a pair (vector, {id: weight}) for each list of at most most ids. Texts are read in windows,
    sorted by length and sent in batches of at most tokens padded ids and texts texts. Weights of zero are dropped; a
    null text has neither vector. Order of rows within a partition is kept.
    """
    at = rows.columns.index(text)
    names = [*rows.columns, "dense", "sparse"]
    kinds = (pa.list_(pa.float32()), pa.map_(pa.int32(), pa.float32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for part in (batch.slice(i, WINDOW) for i in range(0, batch.num_rows, WINDOW)):
                model = model or loaded(load)
                values = part.column(at).to_pylist()
                some = [n for n, v in enumerate(values) if v is not None]
                ids = [model.tokens(values[n])[:most] for n in some]
                dense: list = [None] * len(values)
                sparse: list = [None] * len(values)
                for places in batches_of(list(map(len, ids)), tokens, texts):
                    for k, (vector, weights) in zip(places, model.encode([ids[k] for k in places]), strict=True):
                        dense[some[k]] = [float(x) for x in vector]
                        sparse[some[k]] = [(int(t), float(w)) for t, w in weights.items() if w]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(dense, kinds[0]), pa.array(sparse, kinds[1])], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, dense array<float>, sparse map<int,float>")


def _tried(call: Callable[[object], str], request: object, tries: int, wait: float) -> tuple[str | None, str | None]:
    error = ""
    for n in range(tries):
        if n:
            time.sleep(wait * 2 ** (n - 1))
        try:
            return call(request), None
        except Exception as e:  # noqa: BLE001  whatever a service does, one row fails alone
            error = f"{type(e).__name__}: {e}"
    return None, error


def answered(requests: DataFrame, request: str, call: Callable[[object], str], at_once: int = AT_ONCE, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """requests with answer and error of call on column request: at_once calls of a task at a time, each tried tries times.

    A call that fails at last, or a null request, has a null answer; the first has its error. No row fails another.
    """
    at = requests.columns.index(request)
    names = [*requests.columns, "answer", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for part in (batch.slice(i, HELD) for i in range(0, batch.num_rows, HELD)):
                    one = lambda r: (None, None) if r is None else _tried(call, r, tries, wait)
                    found = list(pool.map(one, part.column(at).to_pylist()))
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f[k] for f in found], pa.string()) for k in range(2))], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInArrow(run, f"{fields}, answer string, error string")


def cached(rows: DataFrame, request: str, call: Callable[[object], str], path: str, label: str, parallel: int | None = None, **how: float) -> DataFrame:
    """rows with answer and error of call on column request, each distinct request asked once and remembered at path.

    The cache is a table of (digest, answer): digests of label, which names the model and its settings, and the request.
    Answers that come are appended whatever fails beside them; failures are not remembered and are asked again by the
    next run. parallel bounds the tasks that call at once.
    """
    spark = rows.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{label}\0").cast("binary"), F.col(request).cast("binary")), 256)
    keyed, _ = staged(rows.withColumn("_digest", digest), "requests")
    schema = "digest string, answer string"
    known = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    known = known.groupBy("digest").agg(F.min("answer").alias("answer"))  # two runs may have asked alike
    asked = keyed.where(F.col("_digest").isNotNull()).select("_digest", F.col(request).alias("_r")).dropDuplicates(["_digest"])
    asked = asked.join(known, F.col("_digest") == F.col("digest"), "left_anti")
    asked = asked.repartition(parallel, "_digest") if parallel else asked.repartition("_digest")
    new, at = staged(answered(asked, "_r", call, **how), "answers")
    new.where("error is null").select(F.col("_digest").alias("digest"), "answer").write.mode("append").parquet(path)
    held = new.select(F.col("_digest").alias("digest"), "answer", "error").unionByName(known.withColumn("error", F.lit(None).cast("string")).join(new.select(F.col("_digest").alias("digest")), "digest", "left_anti"))
    found, _ = staged(keyed.join(held, F.col("_digest") == F.col("digest"), "left").drop("_digest", "digest"), "answered")
    dropped(spark, at)
    return found
