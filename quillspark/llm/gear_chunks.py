"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text and is read where a word ends; a word whose hash is the
least of its RADIUS neighbours on both sides ends a chunk. A cut depends on a few words around it alone, so
an insertion moves the cuts only beside itself, and ties cut too, so that runs of one word are cut alike
everywhere. Chunks with equal digests in different documents repeat; those that stand side by side join to
spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillspark.session import dropped, partitions, staged

#: The hash's memory in bytes (a power of two), words on both sides that a cut is compared with, bytes from which a
#: word is cut inside too, and the mean distance of the places where it may be.
WINDOW, RADIUS, LONG_WORD, APART = 8, 2, 48, 16
#: Least words in a span that is reported, or bytes of a script without spaces. Of a shared passage the words up to
#: its first cut and from its last on are lost, 12 in the mean: passages of over 50 words keep more than this.
WORDS, BYTES = 34, 400
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)
BLOCK = 1 << 20
#: White space.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A digest is hot when a task would get over a quarter of its fair share from it alone; seen at least so often in
#: the chunks of a sample of about so many documents.
QUARTER, SEEN, SAMPLE_DOCS = 4, 16, 20_000


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of its last WINDOW bytes' table values, the older shifted further."""
    h, step = GEAR[data], 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def _word_ends(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of words, and of parts of long ones; the gear hash at each; and how many words begin up to there."""
    data, ends, hashes, words, seen = np.frombuffer(text, np.uint8), [], [], [], 0
    inside, since = True, 0  # whether the byte before is blank, and how long the word at hand is already
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        low = max(0, at - WINDOW)
        h = gear(data[low : at + BLOCK])[at - low :]
        blank = BLANK[part]
        following = np.append(blank[1:], at + BLOCK >= len(data) or BLANK[data[at + BLOCK]])
        leading = np.append(inside, blank[:-1])
        begins = ~blank & leading
        stop = ~blank & following
        place = np.arange(len(part))
        begun = np.maximum.accumulate(np.where(begins, place, -since))
        length = np.where(blank, 0, place - begun + 1)
        if length.max(initial=0) > LONG_WORD:
            stop |= (length > LONG_WORD) & (h < np.uint32((1 << 32) // APART))
        found = np.flatnonzero(stop)
        ends.append(found + (at + 1))
        hashes.append(h[found])
        counted = np.cumsum(begins) + seen
        words.append(counted[found])
        seen, inside, since = int(counted[-1]), bool(blank[-1]), int(length[-1])
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(ends), np.concatenate(hashes), np.concatenate(words)


def cuts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of a text, the last its length, and the words that begin up to each; none for an empty text."""
    ends, h, words = _word_ends(text)
    least = np.ones(len(h), bool)
    for k in range(1, RADIUS + 1):
        least[k:] &= h[k:] <= h[:-k]
        least[:-k] &= h[:-k] <= h[k:]
    stops, counted = ends[least], words[least]
    if len(text) and (not len(stops) or stops[-1] < len(text)):
        last = words[-1] if len(words) else 0
        stops, counted = np.append(stops, len(text)), np.append(counted, last)
    return stops.astype(np.int64), counted.astype(np.int64)


def chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, u, hash of the whole text, start, n (bytes), words and digest (d1, d2) of every chunk of every text.

    u is 0, and for a row without an id a number of its own.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["_id", "u", "whole", "start", "n", "words", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, wholes, ends, found = [], [], [], []
                for k, text in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                    if text:
                        stops, words = cuts(text)
                        starts = np.concatenate([[0], stops[:-1]])
                        found += [digest(text[i:j]) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
                        rows.append(np.full(len(stops), k))
                        wholes.append(np.full(len(stops), xxhash.xxh3_64_intdigest(text), np.uint64))
                        ends.append(np.stack([starts, stops - starts, np.diff(words, prepend=0)]))
                if not rows:
                    continue
                places, two = np.concatenate(ends, axis=1), np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                own = pa.array(np.concatenate(rows))
                columns = [part.column(0).take(own), part.column(1).take(own), pa.array(np.concatenate(wholes).view(np.int64)), pa.array(places[0]), *(pa.array(p.astype(np.int32)) for p in places[1:])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=names)

    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).cast("long")
    rows = df.select(F.col(id_col).alias("_id"), alone.alias("u"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, f"_id {kind}, u bigint, whole bigint, start bigint, n int, words int, d1 bigint, d2 bigint")


def _answers(own: WindowSpec) -> dict[str, Column]:
    """Of a digest: its first place (rows without an id last), the last document that has it, and its occurrences."""
    return {"f": F.min(F.struct("u", "_id", "start")).over(own), "top": F.max(F.struct("u", "_id")).over(own), "copies": F.count("*").over(own)}


def _hot(df: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(d1, d2, pieces): digests too frequent for one task, by a sample, and over how many tasks to deal each.

    That choice changes no result. There are fewer than QUARTER times the partitions, so they can be broadcast.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, df.count()))
    some = df.where(F.rand(1) < share) if share < 1 else df
    counts, path = staged(chunks(some, id_col, text_col).groupBy("d1", "d2").count(), "digests")
    fair = (counts.agg(F.sum("count")).first()[0] or 0) / (QUARTER * partitions(df.sparkSession))
    rows = counts.where((F.col("count") >= SEEN) & (F.col("count") > fair)).collect()
    dropped(df.sparkSession, path)
    pieces = [(r.d1, r.d2, int(r["count"] / fair) + 1) for r in rows]
    return df.sparkSession.createDataFrame(pieces, "d1 bigint, d2 bigint, pieces int") if pieces else None


def _repeated(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks that another document has too, with f, top and copies of their digests.

    Chunks are dealt by digest once; a hot digest goes to several tasks, whose answers, one row a task, are
    put together and broadcast. Every row meets at most one of them.
    """
    every, hot = chunks(df, id_col, text_col), _hot(df, id_col, text_col)
    several = (F.col("f.u") != F.col("top.u")) | ~F.col("f._id").eqNullSafe(F.col("top._id"))
    if hot is None:
        own = Window.partitionBy("d1", "d2")
        return every.withColumns(_answers(own)).where(several)
    piece = F.coalesce(F.pmod(F.xxhash64("whole", "_id", "u"), F.col("pieces")).cast("int"), F.lit(-1))
    every = every.join(F.broadcast(hot), ["d1", "d2"], "left").withColumn("piece", piece).drop("pieces")
    own = Window.partitionBy("d1", "d2", "piece")
    found = every.withColumns(_answers(own)).where(several | (F.col("piece") >= 0))
    found, _ = staged(found, "chunks")
    parts = found.where("piece >= 0").groupBy("d1", "d2", "piece").agg(*(F.first(k).alias(k) for k in ("f", "top", "copies")))
    whole = parts.groupBy("d1", "d2").agg(F.min("f").alias("f2"), F.max("top").alias("top2"), F.sum("copies").alias("copies2"))
    found = found.join(F.broadcast(whole), ["d1", "d2"], "left")
    return found.withColumns({k: F.coalesce(f"{k}2", k) for k in ("f", "top", "copies")}).where(several)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, octets: int = BYTES) -> DataFrame:
    """The spans of texts whose chunks all occur in another document too, in runs of at least words words or octets bytes.

    id_col, start_byte, n_bytes, n_words, n_chunks, first_id (the smallest id that has one of its chunks), copies
    (most occurrences of one of its chunks), kept: a run falls into spans whose chunks all have their first
    occurrence here, which stay, and spans that have none. Removing the spans that are not kept leaves each
    chunk of the runs once. Chunks that repeat inside one document only are not reported.

    Null and empty texts have no rows, nor has an empty table. Rows that share an id count as one document, each of
    its different texts with its own spans, a repeated row once. Rows without an id are documents of their own, whose
    spans never are the first unless all are; equal ones give a span each. A very long text is read in blocks and its
    spans are joined in one task. Other columns are ignored, whatever their names.
    """
    found = _repeated(df, id_col, text_col)
    here = F.struct("u", "_id", "start")
    pieces = found.select("_id", "u", "whole", "start", "n", "words", F.col("f._id").alias("first_id"), here.eqNullSafe(F.col("f")).alias("own"), "copies")
    # Runs go along one text; a row that is there twice has each piece twice.
    order = Window.partitionBy("_id", "u", "whole").orderBy("start")
    pieces = pieces.withColumn("twin", F.coalesce(F.lag("start").over(order) == F.col("start"), F.lit(False))).where(~F.col("twin")).drop("twin")
    apart = F.coalesce(F.lag(F.col("start") + F.col("n")).over(order) != F.col("start"), F.lit(True))
    turns = apart | (F.lag("own").over(order) != F.col("own"))
    joined = pieces.withColumns({"apart": apart.cast("int"), "turns": turns.cast("int")})
    joined = joined.withColumns({"run": F.sum("apart").over(order), "part": F.sum("turns").over(order)})
    run = Window.partitionBy("_id", "u", "whole", "run")
    joined = joined.withColumns({"run_words": F.sum("words").over(run), "run_bytes": F.sum("n").over(run)})
    joined = joined.where((F.col("run_words") >= words) | (F.col("run_bytes") >= octets))
    return joined.groupBy("_id", "u", "whole", "part").agg(
        F.min("start").alias("start_byte"), F.sum("n").alias("n_bytes"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"),
        F.min("first_id").alias("first_id"), F.max("copies").alias("copies"), F.first("own").alias("kept"),
    ).select(F.col("_id").alias(id_col), "start_byte", "n_bytes", "n_words", "n_chunks", "first_id", "copies", "kept")
