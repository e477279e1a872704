"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of every whole text are taken once. The cosine features approximate a Gaussian kernel; each
partition sums its part of the normal equations, groups of partitions add up, and the driver solves a
system whose size is fixed. Raw scores on labelled rows kept out of the fit, in bins, give the isotonic map.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import staged

#: Cosine features, kernel width in standard deviations, ridge, bins of raw scores, groups that add up partial sums.
FEATURES, WIDTH, RIDGE, BINS, GROUPS, SEED = 192, 3.0, 1e-3, 400, 24, 7
STATS = 18


def statistics(text: bytes | None) -> np.ndarray:
    """STATS numbers about a whole UTF-8 text, in any language; those of an empty text for null."""
    text = text or b""
    words, n = text.split(), max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, high = counts[65:91].sum(), counts[97:123].sum(), counts[128:].sum()
    w = max(1, len(words))
    lines = text.split(b"\n")
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    symbols = counts[[35, 36, 37, 38, 42]].sum()
    ends = counts[[46, 33, 63]].sum()
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), n / w,
        upper / n, upper / max(1, upper + lower), high / n, counts[48:58].sum() / n,
        symbols / w, counts[124] / w, counts[33] / w, ends / w, counts[44] / w,
        (n - upper - lower - high - counts[32] - counts[10]) / n,
        len(set(words)) / w, repeats / w,
        len(lines) / w, len(set(lines)) / len(lines),
        len(zlib.compress(text, 1)) / n,
    ], np.float64)


def document_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t).astype(np.float32) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(found) + 1) * STATS, STATS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["_id", "_x"])

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"_id {kind}, _x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, STATS)


class Model:
    """Scores of 0 to 1; without labelled rows of both kinds every score is the share of good rows, or 0.5."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.waves = rng.normal(size=(STATS, FEATURES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.waves + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def _sums(rows: DataFrame, model: Model) -> np.ndarray:
    """The summed normal equations [A, b] of rows (_x, _y): partial sums, then GROUPS sums, then one."""
    d = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d + 1)), 0
        for batch in batches:
            phi, y = model.cosines(matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
            total += np.hstack([phi.T @ phi, (phi.T @ y)[:, None]])
            seen += len(y)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(total.tobytes()) % GROUPS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            for s in batch.column(1).to_pylist():
                total += np.frombuffer(s).reshape(d, d + 1)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    parts = rows.select("_x", "_y").mapInArrow(part, "g int, s binary")
    whole = parts.repartition(GROUPS, "g").mapInArrow(add, "g int, s binary").collect()
    return sum((np.frombuffer(r.s).reshape(d, d + 1) for r in whole), np.zeros((d, d + 1)))


def isotonic(at: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: ascending centres and values of the pools."""
    pools: list[list[float]] = []
    for x, w, y in zip(at, weight, mean, strict=True):
        pools.append([w, x, y])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            (w1, x1, y1), (w2, x2, y2) = pools[-2:]
            pools[-2:] = [[w1 + w2, (w1 * x1 + w2 * x2) / (w1 + w2), (w1 * y1 + w2 * y2) / (w1 + w2)]]
    return np.array([p[1] for p in pools]), np.array([p[2] for p in pools])


def fit(labelled: DataFrame, calibrate: Column) -> Model:
    """labelled: _x, _y (0 or 1), and what calibrate reads; rows for which it holds calibrate, the others fit.

    The moments, the normal equations and the binned scores are of sizes that do not depend on the input.
    """
    learn = labelled.where(~calibrate)
    moments = learn.select(*[F.get("_x", F.lit(k)).cast("double").alias(f"x{k}") for k in range(STATS)]).agg(
        F.count("*").alias("n"), *[f(f"x{k}").alias(f"{f.__name__}{k}") for k in range(STATS) for f in (F.avg, F.stddev_pop)]
    )
    row = moments.first()
    if not row["n"]:
        return Model(np.zeros(STATS), np.ones(STATS))
    mean = np.array([row[f"avg{k}"] for k in range(STATS)])
    scale = np.array([row[f"stddev_pop{k}"] for k in range(STATS)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    sums = _sums(learn, model)
    a, b = sums[:, :-1], sums[:, -1]
    model.weights = np.linalg.solve(a + RIDGE * row["n"] * np.diag([*[1.0 / FEATURES] * FEATURES, 0.0]) + 1e-9 * np.eye(len(a)), b)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor((model.raw(matrix(batch.column(0))) + 1) / 3 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])

    found = labelled.where(calibrate).select("_x", "_y").mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("m"))
    rows = sorted(found.collect())
    if rows:
        model.at, model.value = isotonic(*(np.array(v, float) for v in ([(r.bin + 0.5) / BINS * 3 - 1 for r in rows], [r.n for r in rows], [r.m for r in rows])))
    return model


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score (0 to 1), predicted (1 from threshold on) for every row of df.

    Labels are learnt only from rows whose crc32 of the id as text, modulo folds, is not 0; of those,
    remainder 1 calibrates. Null ids, labels without a document and null labels teach nothing. Ids, labels
    and any other column are never inputs of a score, whatever their names. Null texts score as empty ones. Repeated
    rows score alike; a repeated label teaches as often as it is there. Very long texts are taken whole, by one task.
    Without labels every score is 0.5; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    stats, _ = staged(document_statistics(df, id_col, text_col), "statistics")
    fold = F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(folds))
    marks = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    labelled, _ = staged(stats.join(marks, "_id").where(fold != 0).select("_id", "_x", "_y"), "labelled")
    model = fit(labelled, fold == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))))], names=["_id", "score"])

    scored = stats.mapInArrow(run, f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_col), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
