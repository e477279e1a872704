"""Token ids as canonical, length-limited Huffman code, in files of independent blocks.

Code lengths come from global counts by package merge. A file holds the code, then blocks; a block holds
whole documents in ascending id order, each beginning on a byte, with the bit offset of every CHECK-th id.
Decoding looks the longest code's bits up in a table, for all stretches between checkpoints of a block at once.

File: ``QHUF1``, u32 length and zlib of the code lengths (a byte an id), then blocks of
u32 documents, u32 checkpoints, u64 payload bytes; i64 ids, u8 null marks, u64 id counts, u64 byte
offsets; u64 checkpoints as bits in the payload; the payload. All little-endian; code bits from the top.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.files import attempt_name, opened
from quillspark.llm.ranges import id_borders, id_range
from quillspark.session import dropped, new_path, partitions, staged

#: Bits of the longest code, more where that many ids need them, and ids from one checkpoint to the next.
MAGIC, LIMIT, CHECK = b"QHUF1", 16, 256
#: Ids that are coded, written and decoded together.
GROUP = 1 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code for ids with these counts; 0 where a count is 0.

    At most limit bits, or the fewest that give so many ids a code each.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, (len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    is_leaf, merged = [], np.zeros(0)
    for _ in range(limit):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        is_leaf.append(order < len(weights))
    take = 2 * len(used) - 2
    for leaf in reversed(is_leaf):
        n = int(leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


class Code:
    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.uint64)
        self.limit = limit = max(LIMIT, int(lengths.max(initial=0)))
        if limit > 25:
            raise ValueError("a code of over 25 bits, for over 16 million ids, does not fit the decoder's window")
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        self.codes = np.zeros(len(lengths), np.uint64)
        table = np.zeros(1 << limit, np.uint32)
        code = before = 0
        for i in order.tolist():
            n = int(lengths[i])
            code <<= n - before
            self.codes[i], before = code, n
            table[code << limit - n : code + 1 << limit - n] = i << 5 | n
            code += 1
        self.table = table

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Payload of documents with counts ids each, byte offset of each and of the end, checkpoints in bits."""
        bits = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
        firsts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        size = (ends[firsts[1:]] - ends[firsts[:-1]] + 7) // 8
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = ends[:-1] + np.repeat(offsets[:-1] * 8 - ends[firsts[:-1]], counts)
        word, inside = at >> 5, (at & 31).astype(np.uint64)
        value = self.codes[ids] << (np.uint64(64) - inside - bits)
        out = np.zeros(int(offsets[-1] // 4) + 3, np.uint64)
        if len(ids):
            runs = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[runs]] += np.add.reduceat(value >> np.uint64(32), runs)
            out[word[runs] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), runs)
        return out.astype(">u4").tobytes()[: offsets[-1]], offsets, at[checkpoints(counts)]

    def decode(self, payload: bytes, checks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All ids of documents with counts ids each, every stretch between checkpoints in step."""
        data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
        # From each byte on, 32 bits: room for 7 bits before a code and 25 of it.
        window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        spare, mask = 32 - self.limit, np.uint32((1 << self.limit) - 1)
        start = checkpoints(counts)
        total = int(counts.sum())
        length = np.minimum(CHECK, np.repeat(np.cumsum(counts), -(-counts // CHECK)) - start)
        order = np.argsort(-length, kind="stable")
        length, at, to = length[order], checks[order].astype(np.int64), start[order]
        out = np.zeros(total, np.uint32)
        active = np.searchsorted(-length, -np.arange(CHECK), side="left")
        for step in range(int(length[0]) if len(length) else 0):
            n = int(active[step])
            here = at[:n]
            hit = self.table[window[here >> 3] >> (spare - (here & 7)).astype(np.uint32) & mask]
            out[to[:n] + step] = hit >> np.uint32(5)
            here += hit & np.uint32(31)
        return out


def checkpoints(counts: np.ndarray) -> np.ndarray:
    """Positions, among all ids of documents with counts ids each, of each document's every CHECK-th id."""
    firsts, each = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), -(-counts // CHECK)
    within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return np.repeat(firsts, each) + within * CHECK


def write_block(to, code: Code, ids: np.ndarray, keys: list, counts: np.ndarray) -> None:  # noqa: ANN001
    payload, offsets, checks = code.encode(ids, counts)
    to.write(struct.pack("<IIQ", len(keys), len(checks), len(payload)))
    to.write(np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([k is None for k in keys], np.uint8).tobytes())
    to.write(counts.astype("<u8").tobytes() + offsets[:-1].astype("<u8").tobytes() + checks.astype("<u8").tobytes())
    to.write(payload)


def read_blocks(f) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:  # noqa: ANN001
    """Keys, id counts and ids of each block of a file."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of this format")
    lengths = np.frombuffer(zlib.decompress(f.read(struct.unpack("<I", f.read(4))[0])), np.uint8)
    code = Code(lengths)
    while head := f.read(16):
        docs, checks, size = struct.unpack("<IIQ", head)
        numbers, missing = np.frombuffer(f.read(8 * docs), "<i8").tolist(), f.read(docs)
        counts = np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
        f.read(8 * docs)
        at = np.frombuffer(f.read(8 * checks), "<u8")
        yield [None if m else k for k, m in zip(numbers, missing, strict=True)], counts, code.decode(f.read(size), at, counts)


def token_counts(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """Global counts of ids below vocabulary in column ids (bytes): partition sums added up in Spark."""
    narrow = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), narrow), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    # At most one row an id of the vocabulary.
    for row in ids.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.id] = row.n
    return out


def write(df: DataFrame, encoder: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]], vocabulary: int, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text (null: empty), append id end, write files in ascending id order; gives their table.

    encoder makes, once a task, a function from texts to all their ids and the count of each. The table has a
    row a file: path, at (order), docs, ids and start (ids of all documents before it). Null ids come first,
    rows that share an id follow by their ids' bytes. Ids of documents are whole numbers. Other columns are ignored; a
    very long text is one document of its block, whose ids one task holds. An empty table gives no files.
    """
    spark, ranges = df.sparkSession, partitions(df.sparkSession)
    narrow = "<u2" if vocabulary <= 1 << 16 else "<u4"
    kind = df.schema[id_col].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found, counts = encode([t or "" for t in part.column(1).to_pylist()])
                stops = np.cumsum(counts + 1)
                flat = np.full(len(found) + len(counts), end, narrow)
                flat[np.delete(np.arange(len(flat)), stops - 1)] = found
                places = np.concatenate([[0], stops]).astype(np.int64) * flat.itemsize
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), values.cast(pa.binary())], names=["_id", "ids"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(tokenize, f"_id {kind}, ids binary")
    ids, ids_path = staged(rows, "token-ids", "zstd")
    lengths = code_lengths(token_counts(ids, vocabulary))
    header = MAGIC + struct.pack("<I", len(packed := zlib.compress(lengths.tobytes(), 9))) + packed

    _, cuts = id_borders(df, id_col, ranges)
    folder = new_path(spark, "huffman")
    placed = ids.withColumn("_b", id_range(F.col("_id"), cuts)).repartitionById(len(cuts) + 1, F.col("_b").cast("int")).sortWithinPartitions("_b", F.col("_id").asc_nulls_first(), "ids")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        here, to, path, docs, total = None, None, "", 0, 0

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def manifest() -> pa.RecordBatch:
            to.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([here], pa.int32()), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["path", "at", "docs", "ids"])

        def flush(group: list) -> None:
            wide = [np.frombuffer(v, narrow) for _, v in group]
            write_block(to, code, np.concatenate(wide), [k for k, _ in group], np.array([len(w) for w in wide], np.int64))

        group, n = [], 0
        for key, value, b in rows():
            if b != here:
                if to:
                    if group:
                        flush(group)
                    yield manifest()
                path, here, docs, total, group, n = f"{folder}/{attempt_name(f'part-{b:06d}', '.qhuf')}", b, 0, 0, [], 0
                to = system.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None)
                to.write(header)
            group.append((key, value))
            size = len(value) // np.dtype(narrow).itemsize
            docs, total, n = docs + 1, total + size, n + size
            if n >= GROUP:
                flush(group)
                group, n = [], 0
        if to:
            if group:
                flush(group)
            yield manifest()

    table, _ = staged(placed.mapInArrow(save, "path string, at int, docs bigint, ids bigint"), "huffman-files")
    dropped(spark, ids_path)
    # One row a range, so no more than there are partitions.
    start, found = 0, []
    for row in table.orderBy("at").collect():
        found.append((row.path, row["at"], row.docs, row.ids, start))
        start += row.ids
    return spark.createDataFrame(found, "path string, at int, docs bigint, ids bigint, start bigint")


def read(files: DataFrame, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """id_col, start, n_tokens and ids_crc32 of each document, and its ids where asked for, from the files."""
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = opened(path)
                with system.open_input_stream(at, buffer_size=1 << 20) as f:
                    for keys, counts, found in read_blocks(f):
                        raw, ends = found.astype("<u4").tobytes(), np.cumsum(counts)
                        begin = ends - counts
                        parts = [raw[4 * i : 4 * j] for i, j in zip(begin.tolist(), ends.tolist(), strict=True)]
                        columns = [pa.array(keys, pa.int64()), pa.array(begin + start), pa.array(counts), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.binary())] if ids else [])], names=["_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])
                        start += int(ends[-1])

    rows = files.select("path", "start").repartition(n)
    return rows.mapInArrow(run, "_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids).withColumnRenamed("_id", id_col)
