"""Spelling variant grouping by letter-parity bitmask bands.

A word's mask has a bit a letter, set where the letter occurs an odd number of times. One inserted or deleted letter
flips one bit, one replaced letter two at most, so of three bands of the mask one is equal. An edit also leaves the
first or the last half of the shorter word alone, which splits large bands: words meet where a band and a half are equal
and lengths differ by one at most; no more than two bits of the masks differ, and what is left is verified by edit
distance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import dropped, staged

#: Letters with a bit of their own, in three bands of 63; rarer ones share these bits.
BANDS, BITS = 3, 63
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 18
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(df: DataFrame, letter: str, least: int, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the maximal runs of letter (a pattern of one) in whole texts, A-Z lower-cased, of at least least code points.

    With every, a run whose crc32 of ``<id>:<run>`` it divides loses one code point first. A null text has no words,
    a null id is written as nothing; repeated rows count each. An empty table gives no rows; other columns are
    ignored. Words are counted in each task before they are shuffled, so a frequent one is no hot key; a task holds
    one text and HELD words at most.
    """
    run_of, small = re.compile(f"{letter}{{{least},}}"), str.maketrans(UPPER, UPPER.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begin = "" if i is None else i
                for word, n in Counter(run_of.findall(text.as_py() or "")).items():
                    word = word.lower() if word.isascii() else word.translate(small)
                    h = crc32(f"{begin}:{word}".encode()) if every else 1
                    if every and h % every == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= least:
                        total[word] = total.get(word, 0) + n
                if len(total) >= HELD:
                    yield counted()
        yield counted()

    rows = df.select(F.col(id_col).cast("string").alias("_i"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _masks(words: DataFrame) -> DataFrame:
    """words with b0, b1, b2, the bands of their masks, and pre, suf, their ends.

    Letters are dealt to bands in order of how many words have them, so that bands tell words apart equally well; at
    most 3 * 63 letters come to the driver.
    """
    letters = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring(F.col("word"), i, F.lit(1)))
    used = words.select(F.explode(F.array_distinct(letters)).alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").limit(BANDS * BITS)
    alphabet = "".join(r.c for r in used.collect())
    found = F.transform(letters, lambda c: F.position(c, F.lit(alphabet)))
    # A letter beyond the alphabet shares the bit that its code point gives.
    place = F.zip_with(letters, found, lambda c, p: F.when(p > 0, p - 1).otherwise(F.pmod(F.ascii(c), F.lit(BANDS * BITS))))
    rows = words.withColumn("_p", place)
    masks = {f"b{k}": F.aggregate("_p", F.lit(0).cast("bigint"), _flip(k)) for k in range(BANDS)}
    return rows.withColumns(masks).drop("_p")


def _flip(band: int) -> Callable[[Column, Column], Column]:
    """Flip a place's bit in the mask of its band."""
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), (p / BANDS).cast("int"))
    return lambda m, p: F.when(p % BANDS == band, m.bitwiseXOR(bit(p))).otherwise(m)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b), a < b, of words (word, n) that one edit parts; each once.

    An insertion, deletion or replacement of one code point is an edit. words must not repeat a word. The shorter of
    two words has size code points: a word meets others of its own size, and those one longer or shorter, by a hash
    of that size, a band and half of the shorter word at either end.
    """
    rows, _ = staged(_masks(words).select("word", "n", "b0", "b1", "b2", F.char_length("word").alias("size")), "spelling-masks")
    end = lambda side, word, size: side(word, F.floor(size / 2).cast("int"))
    ends = (F.left, F.right)
    keys = lambda size: [F.struct(F.lit(k).alias("k"), F.xxhash64(size, F.lit(k), f"b{k // 2}", end(ends[k % 2], F.col("word"), size)).alias("key")) for k in range(2 * BANDS)]
    shorter = rows.select("*", F.inline(F.array(*keys(F.col("size")))))
    either = rows.select("*", F.inline(F.array(*keys(F.col("size")), *keys(F.col("size") - 1))))
    side = lambda met, x: met.select("key", *[F.col(c).alias(f"{c}_{x}") for c in [*rows.columns, "k"]])
    joined = side(shorter, "a").join(side(either, "b").hint("merge"), "key")  # sizes are estimated as if a word made one row
    flips = sum((F.bit_count(F.col(f"b{k}_a").bitwiseXOR(F.col(f"b{k}_b"))) for k in range(BANDS)), F.lit(0))
    same = lambda k: (F.col(f"b{k // 2}_a") == F.col(f"b{k // 2}_b")) & (end(ends[k % 2], F.col("word_a"), F.col("size_a")) == end(ends[k % 2], F.col("word_b"), F.col("size_a")))
    first = F.coalesce(*[F.when(same(k), F.lit(k)) for k in range(2 * BANDS)])
    longer = F.col("size_b") - F.col("size_a")
    fits = (flips <= 2) & ((longer == 1) | (longer == 0) & (F.col("word_a") < F.col("word_b"))) & (first == F.col("k_a")) & (F.col("k_a") == F.col("k_b"))
    found = joined.where(fits & (F.levenshtein("word_a", "word_b", 1) == 1))
    turned = F.col("word_a") < F.col("word_b")
    return found.select(*[F.when(turned, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(name) for c, x, y, name in (("word", "a", "b", "a"), ("word", "b", "a", "b"), ("n", "a", "b", "n_a"), ("n", "b", "a", "n_b"))])


def group_variants(counts: DataFrame, least: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words (word, n) of at least least code points and least_count uses.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least ratio times
    its own, ratio being over 1; root is the end of the chain of forms, the word itself if it has none. Null and
    shorter words are left out, repeated words added up; an empty table gives no rows. Chains grow by ratio a step,
    so they are short, and rounds of doubling follow them.
    """
    size = F.char_length("word")
    words, _ = staged(counts.where(size >= least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "spelling-words")
    pairs, _ = staged(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("o"), F.col("near").alias("w"))).alias("_best"))
    big = -F.col("_best.o") >= F.col("n") * ratio
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(big, F.col("_best.w")).alias("form"), F.when(big, -F.col("_best.o")).alias("form_n"))
    found, _ = staged(found, "spelling-forms")
    roots = _ends(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(steps: DataFrame) -> DataFrame:
    """(word, root): where the steps of each word end; each round doubles how far they reach."""
    reach, path = staged(steps, "spelling-roots")
    while True:
        on = reach.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further, before = reach.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), path
        further, path = staged(further, "spelling-roots")
        if further.where("moved").isEmpty():
            return further.drop("moved")
        reach = further.drop("moved")
        dropped(reach.sparkSession, before)
