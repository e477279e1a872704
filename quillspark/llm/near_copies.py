"""Near copies by the Jaccard similarity of their sets of word shingles.

SimHashes of the sets meet by op7's grid join of segment popcounts: those with a half equal or one bit
apart are proposed, and the exact similarity of the two sets decides instead of three bits, which few
pairs at 0.8 keep. For these, BANDS bands of ROWS MinHash values each propose pairs too. A pair at
similarity s meets in a band with 1 - (1 - s ** ROWS) ** BANDS: all but one in 190,000 at 0.8. In each
band's bucket all are first compared with one leader, the one that meets most
others over all bands, so that a large group of copies costs about a comparison a member. What that
leaves in different components meets by prefix filter: with the shingles of each set in one order, rare
ones first, two similar sets have their first shingle in common so early that the rest of both suffices
for their similarity. No similar pair is passed over there, and members of a large group that changed
too much for any link meet nobody.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import simhash
from quillspark.operators.components import components
from quillspark.llm.skew import HEAVY_KEYS, join_counted
from quillspark.session import staged

SEED, ROWS, BANDS, BLOCK = 42, 6, 40, 128
SHINGLE, LEAST = 5, 0.8
#: Counters of shingles that order them by frequency, about; any order is right, this one makes few pairs.
SLOTS = 1 << 20
#: Fingerprints that are broadcast at most, 16 bytes each.
FEW = 1 << 20
_RANDOM = np.random.default_rng(SEED)
FLIPS, TIMES, WEIGHTS = (_RANDOM.integers(0, 1 << 64, ROWS * BANDS, np.uint64, endpoint=False) | np.uint64(1) for _ in range(3))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the distinct word shingles of UTF-8 text, ascending; a text of fewer words is one; no word: none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(flat[i:j], SEED) for i, j in spans], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band's MinHash values; none for an empty set."""
    if not len(found):
        return np.empty(0, np.uint64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        mixed = found[at : at + BLOCK, None] ^ FLIPS
        mixed *= TIMES
        np.minimum(least, mixed.min(axis=0), out=least)
    return (least * WEIGHTS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _each(rows: DataFrame, shingle: int, ddl: str, of: Callable[[np.ndarray], list]) -> DataFrame:
    """(_id, fp, ...) a row of rows (_id, _t); fp is a hash of the set of shingles, the rest what of makes of it."""
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t, shingle) for t in part.column(1).cast(pa.binary()).to_pylist()]
                whole = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                made = of(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole), *made], names=["_id", "fp", *names])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, fp bigint, {ddl}")


def _longs(found: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))


def prints(rows: DataFrame, shingle: int) -> DataFrame:
    """(_id, fp, size, sim, bands) a row of rows (_id, _t); sim is the SimHash of the set."""

    def made(sets: list[np.ndarray]) -> list[pa.Array]:
        sims = np.array([simhash.of_hashes(s) for s in sets], np.uint64).view(np.int64)
        return [pa.array([len(s) for s in sets], pa.int32()), pa.array(sims), _longs(map(bands, sets))]

    return _each(rows, shingle, "size int, sim bigint, bands array<bigint>", made)


class Texts:
    """Texts by the fingerprints of their sets: few sets are needed, so they are made again from the texts."""

    def __init__(self, rows: DataFrame, groups: DataFrame, shingle: int) -> None:
        self.rows, self.groups, self.shingle = rows, groups, shingle

    def sets(self, needed: DataFrame) -> DataFrame:
        """(fp, shingles) and the other columns of needed, one row a needed fp.

        Up to FEW needed ones are broadcast to where the texts are; more are joined by a shuffle.
        """
        small = F.broadcast if needed.count() <= FEW else lambda df: df
        ids = self.groups.join(small(needed.select("fp")), "fp").select(F.col("rep").alias("_rep")).distinct()
        rows = self.rows.join(small(ids), F.col("_id").eqNullSafe(F.col("_rep")), "left_semi")
        made = _each(rows, self.shingle, "shingles array<bigint>", lambda sets: [_longs(sets)]).drop("_id")
        return staged(made.join(small(needed), "fp").dropDuplicates(["fp"]), "sets")[0]


def _similar(texts: Texts, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of fingerprints whose sets have at least that similarity."""
    pairs, _ = staged(pairs, "pairs")
    total = pairs.count()
    uses, _ = staged(pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("uses")), "uses")
    sets = texts.sets(uses)
    # A fingerprint in many pairs stands first, where a heavy key is broadcast.
    heavy = F.broadcast(uses.where(F.col("uses") * HEAVY_KEYS > total).select(F.col("fp").alias("_h")))
    turn = F.col("_h").isNotNull()
    turned = pairs.join(heavy, F.col("b") == F.col("_h"), "left").select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("fp"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    first = join_counted(turned, sets.withColumnRenamed("shingles", "x"), "fp", "uses", total).withColumnRenamed("fp", "a")
    both = first.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common / (F.size("x") + F.size("y") - common) >= F.lit(least)).select("a", "b")


def alike(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints, a < b, of sets whose SimHashes meet; of equal SimHashes the first set stands for all and meets them."""
    known = groups.where("size > 0").select("fp", "sim")
    sims, _ = staged(known.groupBy("sim").agg(F.min("fp").alias("first")), "sims")
    one, two = (sims.select(F.col("sim").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    met = simhash.met(sims.select(F.col("sim").alias("fp"))).select("a", "b").join(one, "a").join(two, "b").select("first_a", "first_b")
    same = known.join(sims, "sim").where("fp <> first").select("first", "fp")
    pairs = met.unionByName(same.toDF("first_a", "first_b"))
    return pairs.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")).distinct()


def links(docs: DataFrame, groups: DataFrame, texts: Texts, least: float) -> DataFrame:
    """Pairs of fingerprints of similar sets whose components are those of all similar pairs that meet by SimHash or in a bucket."""
    near, _ = staged(alike(groups), "alike")
    # Each is first compared with one of those it meets; the others only if that leaves them in different components.
    tried = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
    placed, total = docs.select("fp", "size", F.explode("bands").alias("band")), docs.count() * BANDS
    buckets = placed.groupBy("band").agg(F.min("fp").alias("low"), F.max("fp").alias("top"), F.count("*").alias("n")).where("low <> top")
    buckets, _ = staged(buckets.select("band", "n", F.col("n").alias("crowd")), "buckets")
    met, _ = staged(join_counted(placed, buckets, "band", "n", total).distinct(), "met")
    # Who meets most others, band by band, is nearest to the middle of its group and leads: most are like it, and few
    # leaders serve all buckets of a group.
    crowds = met.groupBy("fp").agg(F.sum("crowd").alias("score"))
    ranked, _ = staged(met.drop("crowd").join(crowds, "fp"), "ranked")
    leads, _ = staged(ranked.groupBy("band").agg(F.max(F.struct("score", "fp", "size")).alias("lead"), F.count("*").alias("n")), "leads")
    members, _ = staged(join_counted(ranked.drop("score"), leads, "band", "n", ranked.count()), "members")
    led = members.where((F.col("fp") != F.col("lead.fp")) & (F.least("size", "lead.size") >= F.lit(least) * F.greatest("size", "lead.size") - F.lit(1e-6)))
    found, _ = staged(_similar(texts, led.select(F.col("lead.fp").alias("a"), F.col("fp").alias("b")).unionByName(tried).distinct(), least), "led")
    parts, _ = staged(components(found), "parts")
    # Leaders have met all others of their bucket; left are the rest of each bucket that lies in several components.
    rest = members.where(F.col("fp") != F.col("lead.fp")).join(parts.withColumnRenamed("vertex", "fp"), "fp", "left").select("band", "fp", F.coalesce("component", "fp").alias("part"))
    several = rest.groupBy("band").agg(F.min("part").alias("m"), F.max("part").alias("n")).where("m <> n").select("band")
    rest, _ = staged(rest.join(several, "band", "left_semi").select("fp", "part").distinct(), "rest")
    of = lambda c: parts.select(F.col("vertex").alias(c), F.col("component").alias(f"part_{c}"))
    apart = near.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")
    more = _similar(texts, _met(texts.sets(rest), least).unionByName(apart).distinct(), least)
    return found.unionByName(more)


def _met(rest: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of sets (fp, part, shingles) of different parts that may have that similarity: all that have it."""
    slot = F.pmod(F.xxhash64("s"), F.lit(SLOTS)).cast("int")
    held = np.zeros(SLOTS, np.int64)
    # At most SLOTS rows.
    for row in rest.select(F.explode("shingles").alias("s")).groupBy(slot.alias("at")).count().toLocalIterator():
        held[row["at"]] = min(row["count"], 1 << 30)
    counts = rest.sparkSession.sparkContext.broadcast(held.astype(np.int32))
    kind = "token bigint, fp bigint, part bigint, size int, after int"
    listed = rest.select("fp", "part", F.transform("shingles", lambda s: F.struct(s.alias("s"), F.pmod(F.xxhash64(s), F.lit(SLOTS)).cast("int").alias("at"))).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            inner = lists.values
            tokens, at = inner.field("s").to_numpy(), inner.field("at").to_numpy()
            rows, found, left = [], [], []
            for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                order = np.lexsort((tokens[i:j], counts.value[at[i:j]]))[: (j - i) - ceil(least * (j - i) - 1e-6) + 1]
                rows.append(np.full(len(order), k))
                found.append(tokens[i:j][order])
                left.append((j - i) - np.arange(len(order), dtype=np.int32))
            if rows:
                own = np.concatenate(rows)
                size = np.diff(bounds).astype(np.int32)
                columns = [pa.array(np.concatenate(found)), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(size[own]), pa.array(np.concatenate(left).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "fp", "part", "size", "after"])

    early, _ = staged(listed.mapInArrow(run, kind), "early")
    one, two = (early.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("fp", "part", "size", "after"))) for k in "ab")
    # That many in common make two sets similar; a first common shingle must leave so many in both, itself included.
    needed = F.lit(least / (1 + least)) * (F.col("size_a") + F.col("size_b")) - F.lit(1e-6)
    meets = (F.col("fp_a") < F.col("fp_b")) & (F.col("part_a") != F.col("part_b")) & (F.least("after_a", "after_b") >= needed)
    return one.join(two, (one["token"] == two["token"]) & meets).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """id_col, component_id a row of df: texts whose sets of shingles have Jaccard similarity least or more are linked.

    Words are as in simhash. Rows with equal sets are one vertex however many they are, as are null and
    wordless texts; component_id is the smallest id that links reach. Null ids are given a component
    but never name one unless it has no other. An empty table gives no rows; other columns are ignored. A very long
    text's shingles are in one task's memory. df is read once for all sets, and again for those in proposed pairs.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    docs, _ = staged(prints(rows, shingle), "shingles")
    groups, _ = staged(docs.groupBy("fp").agg(F.min("_id").alias("rep"), F.count("*").alias("n"), F.min("size").alias("size"), F.min("sim").alias("sim")), "groups")
    linked, _ = staged(components(links(docs, groups, Texts(rows, groups, shingle), least)), "components")
    smallest = linked.join(groups, linked["vertex"] == groups["fp"]).groupBy("component").agg(F.min("rep").alias("smallest"))
    named = linked.join(smallest, "component").select(F.col("vertex").alias("fp"), "smallest")
    whole = groups.join(named, "fp", "left").select("fp", "n", F.coalesce("smallest", "rep").alias("component_id"))
    found = join_counted(docs.select("_id", "fp"), whole, "fp", "n", docs.count())
    return found.select(F.col("_id").alias(id_col), "component_id")
