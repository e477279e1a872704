"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for two bases modulo the prime 2**31 - 1, the sums of code * base**position up to
every position. A span's hash is a difference of two entries, freed of its position; so any two spans
compare in constant time, and the longest common extension of two positions is a binary search.

A fingerprint is the hash of the whole text, its length, and two bottom-k sketches of span hashes: of
spans of LONG code points and of SHORT ones (a text with fewer is one span). Two fingerprints give the shares of spans
of either kind that their texts have in common, and their likeness is one weighted mean of both at every length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ranges import id_borders, id_range
from quillspark.session import partitions

P = (1 << 31) - 1
BASES = (1_000_003, 776_531_401)
BLOCK = 1 << 16
#: Span lengths and sketch size; what share of the likeness LONG spans have, as short ones recur in unlike texts.
LONG, SHORT, KEEP, LONG_SHARE = 16, 4, 64, 0.75
SPREAD = np.uint64(0x9E3779B97F4A7C15)

_p, _31 = np.uint64(P), np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P, for x below 2**63."""
    x = (x & _p) + (x >> _31)
    x = (x & _p) + (x >> _31)
    return np.where(x >= _p, x - _p, x)


def _powers(base: int) -> np.ndarray:
    out, step = np.ones(BLOCK, np.uint64), 1
    while step < BLOCK:
        out[step : 2 * step] = _mod(out[:step] * np.uint64(pow(base, step, P)))
        step *= 2
    return out


POWERS = [_powers(b) for b in BASES]
INVERSES = [pow(b, P - 2, P) for b in BASES]
INVERSE_POWERS = _powers(INVERSES[0])


class Prefixes:
    """Prefix sums of a text's code points; memory is eight bytes a code point."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(codes)
        self.sums = [np.zeros(self.n + 1, np.uint32) for _ in BASES]
        for base, powers, sums in zip(BASES, POWERS, self.sums, strict=True):
            carry = np.uint64(0)
            for at in range(0, self.n, BLOCK):
                part = codes[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
                terms = _mod(part * powers[: len(part)])
                if at:
                    terms = _mod(terms * np.uint64(pow(base, at, P)))
                run = _mod(np.cumsum(terms) + carry)
                sums[at + 1 : at + 1 + len(part)] = run
                carry = run[-1]

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """Hash of the code points i to j, the same wherever they stand."""
        return tuple((int(s[j]) - int(s[i])) * pow(inv, i, P) % P for s, inv in zip(self.sums, INVERSES, strict=True))

    def same(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether length code points from i on equal those of other from j on."""
        return all(
            (int(a[i + length]) - int(a[i])) * pow(base, j, P) % P == (int(b[j + length]) - int(b[j])) * pow(base, i, P) % P
            for a, b, base in zip(self.sums, other.sums, BASES, strict=True)
        )

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of i here and j in other."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i, other, j, mid) else (low, mid - 1)
        return low

    def sketch(self, width: int) -> np.ndarray:
        """The KEEP smallest distinct spread hashes of spans of width (of the text, where it is shorter)."""
        if not self.n:
            return np.zeros(0, np.uint32)
        width, sums, best = min(width, self.n), self.sums[0], np.zeros(0, np.uint32)
        for at in range(0, self.n - width + 1, BLOCK):
            to = min(at + BLOCK, self.n - width + 1)
            diff = sums[at + width : to + width].astype(np.uint64) + _p - sums[at:to].astype(np.uint64)
            spans = _mod(_mod(diff) * INVERSE_POWERS[: to - at])
            if at:
                spans = _mod(spans * np.uint64(pow(INVERSES[0], at, P)))
            mixed = (spans * SPREAD >> np.uint64(32)).astype(np.uint32)
            few = np.unique(np.partition(mixed, 4 * KEEP)[: 4 * KEEP]) if len(mixed) > 8 * KEEP else np.unique(mixed)
            best = np.union1d(best, few if len(few) >= KEEP else np.unique(mixed))[:KEEP]
        return best

    def fingerprint(self) -> str:
        """``hash-length-long sketch-short sketch`` in hex."""
        a, b = self.span(0, self.n)
        long, short = (self.sketch(width).astype(">u4").tobytes().hex() for width in (LONG, SHORT))
        return f"{a << 31 | b:016x}-{self.n:x}-{long}-{short}"


def likeness(a: str, b: str) -> float:
    """The weighted mean of the shares of LONG and of SHORT spans in common (Dice) by two fingerprints, 0 to 1.

    Equal texts have 1, an empty text and another 0. The rule is the same for all lengths.
    """
    if a == b:
        return 1.0
    (_, _, *left), (_, _, *right) = a.split("-"), b.split("-")
    long, short = (_shared(x, y) for x, y in zip(left, right, strict=True))
    return LONG_SHARE * long + (1 - LONG_SHARE) * short


def _shared(a: str, b: str) -> float:
    """Dice's coefficient of two sets by their sketches."""
    left, right = ({h[i : i + 8] for i in range(0, len(h), 8)} for h in (a, b))
    if not left or not right:
        return 0.0
    smallest = sorted(left | right)[:KEEP]
    both = sum(h in left and h in right for h in smallest) / len(smallest)
    return 2 * both / (1 + both)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of following."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of df: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and common_prefix, the longest common extension of the two texts from their beginnings.

    The next document follows by ascending id, after the last the first; rows that share an id follow
    by text; null ids come first; null texts are empty. One exchange deals rows to identifier ranges.
    A range's first rows are also sent to the range before it, so that no order of all rows is needed.
    A table of one row is its own next; an empty table gives no rows. Repeated rows stay rows, each the next of the one
    before. A very long text costs a task eight bytes a code point. Other columns are ignored. Ids are numbers.
    """
    spark, ranges = df.sparkSession, partitions(df.sparkSession)
    low, cuts = id_borders(df, id_col, ranges)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.withColumn("_b", id_range(F.col("_id"), cuts))
    first = F.col("_id").isNull() if not df.where(F.col(id_col).isNull()).isEmpty() else F.col("_id").eqNullSafe(F.lit(low))
    before = F.when(first, F.lit(len(cuts))).when(F.col("_id").isin(cuts), F.col("_b") - 1)
    places = F.array_compact(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("c")), F.when(before.isNotNull(), F.struct(before.alias("b"), F.lit(1).alias("c")))))
    dealt = rows.withColumn("_at", F.explode(places)).select("_id", "_t", "_at.b", "_at.c")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("b").cast("int")).sortWithinPartitions("b", "c", F.col("_id").asc_nulls_first(), "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
        for batch in batches:
            out = []
            for key, text, b, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = None
                if pending and pending[0] == b:
                    _, key0, text0, whole0, print0 = pending
                    here = Prefixes(text)
                    print1 = here.fingerprint()
                    new = edited(text0, text)
                    other = Prefixes(new)
                    print2 = other.fingerprint()
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((key0, whole0.n, digest, print0, print2, likeness(print0, print2), likeness(print0, print1), whole0.extension(0, other, 0)))
                    pending = None if copy else (b, key, text, here, print1)
                elif not copy:
                    here = Prefixes(text)
                    pending = (b, key, text, here, here.fingerprint())
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types(batch), strict=True)], names=names)

    def types(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    found = dealt.mapInArrow(
        run, f"_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"
    )
    return found.withColumnRenamed("_id", id_col)
