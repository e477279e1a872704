"""SimHash near-dedup by a segment-popcount embedding.

Each 32-bit half of a fingerprint is cut into 16 segments of two bits, and once more, moved by one bit
round the ring, into 16 others; the popcounts of all 32 segments, two bits each, are one 64-bit number.
Flipping a bit moves one popcount of either cut by one, so half the Manhattan distance of two vectors is
at most the Hamming distance of the halves. With at most 3 differing bits, one half has at most one: its
vectors are equal, or one is a step of one bit below the other. The range join runs on that grid: every
fingerprint lies in its cell of each half and probes its cell and those one step down. Both cuts together
leave hardly two halves in one cell, so cells of unlike fingerprints are as rare as equal halves are.
What meets is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import components
from quillspark.llm.skew import join_counted
from quillspark.session import staged

SEED, MAX_BITS, BLOCK = 42, 3, 1 << 16
#: Low bit of each two-bit segment of both cuts of a half.
LOW_BITS = 0x5555555555555555


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of UTF-8 text: a bit is set if over half of the shingles' XXH64 have it; no word: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(flat[i:j], SEED) for i, j in spans], np.uint64)
        counts += _votes(hashes)
    return _majority(counts, n)


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes, one vote each; none: zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += _votes(hashes[at : at + BLOCK])
    return _majority(counts, len(hashes))


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[counts * 2 > n].sum())


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(_id, fp) a row of df, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"_id {kind}, fp bigint")


def _cell(bits: Column) -> Column:
    """The popcounts of the segments of both cuts of a half (a long below 2**32)."""
    moved = F.shiftright(bits, 1) + F.shiftleft(bits.bitwiseAND(F.lit(1)), 31)
    cuts = F.shiftleft(moved, 32).bitwiseOR(bits)
    upper = F.shiftrightunsigned(cuts, 1)
    low, high = (x.bitwiseAND(F.lit(LOW_BITS)) for x in (cuts.bitwiseXOR(upper), cuts.bitwiseAND(upper)))
    return low.bitwiseOR(F.shiftleft(high, 1))


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a <> b, of the distinct fingerprints in column fp that differ in at most MAX_BITS bits."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return met(prints).where(near).select("a", "b")


def met(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints whose cells meet in a half; b's half is a's, or that with one bit cleared."""
    halves = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    split = prints.select("fp", F.posexplode(halves).alias("half", "bits"))
    down = [F.when(F.shiftright("bits", i).bitwiseAND(F.lit(1)) > 0, F.col("bits") - F.lit(1 << i)) for i in range(32)]
    probes = split.select(F.col("fp").alias("a"), "half", "bits", F.explode(F.array_compact(F.array("bits", *down))).alias("probe"))
    probes = probes.select("a", "half", _cell(F.col("probe")).alias("at"), (F.col("probe") != F.col("bits")).alias("below"))
    homes = split.select(F.col("fp").alias("b"), "half", _cell(F.col("bits")).alias("at"))
    # Sizes are estimated as if explode made one row of each, 34 times too small here: neither side may be broadcast.
    return probes.join(homes.hint("merge"), ["half", "at"]).where(F.col("below") | (F.col("a") < F.col("b")))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id a row of df.

    Null and wordless texts have fingerprint zero, which links like any other. Rows that share a
    fingerprint are one vertex however many they are; component_id is the smallest id that links
    reach. Null ids are given a component but never name one unless it has no other. An empty table
    gives no rows; other columns are ignored. A very long text is hashed in blocks of shingles by one task.
    """
    docs, _ = staged(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    groups, _ = staged(docs.groupBy("fp").agg(F.min("_id").alias("rep"), F.count("*").alias("n")), "groups")
    linked, _ = staged(components(links(groups.select("fp"))), "components")
    smallest = linked.join(groups, linked["vertex"] == groups["fp"]).groupBy("component").agg(F.min("rep").alias("smallest"))
    named = linked.join(smallest, "component").select(F.col("vertex").alias("fp"), "smallest")
    whole = groups.join(named, "fp", "left").select("fp", "n", F.coalesce("smallest", "rep").alias("component_id"))
    found = join_counted(docs, whole, "fp", "n", docs.count())
    return found.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
