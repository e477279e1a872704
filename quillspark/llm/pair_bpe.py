"""BPE encoding and decoding with a pair occurrence index.

Words are cut and looked up; the new words of a batch are merged together. An index maps each pair of
neighbouring symbols to all its positions in the batch; a heap holds the ranks that have positions. The
lowest rank is applied at all its positions in order, and the lists of the pairs around them follow.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm.alphabet import ENDING, LETTER, NUMBER, SIGN, UNSAFE, UNSAFE_LOWER, byte_alphabet
from quillspark.llm.word_table import BLOCK, WordTable, bare_words, codes_of, per_text

#: Words merged together through one index.
TOGETHER = 20_000


class PairBpe:
    """A BPE vocabulary with word ends, lower case and dropped white space, from a tokenizers file."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"].get("end_of_word_suffix") or ""
        self.ids = vocab
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        # Ranks of pairs by both ids in one number, and of each rank the pair and what it makes.
        self.pairs: dict[int, int] = {}
        self.by_rank: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.by_rank.append((vocab[a], vocab[b], vocab[a + b]))
            self.pairs[vocab[a] << 32 | vocab[b]] = rank
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.alphabet = byte_alphabet()
        self.inside = np.array([vocab[c] for c in self.alphabet], np.int64)
        self.final = np.array([vocab[c + self.end] for c in self.alphabet], np.int64)
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.cut = re.compile(f"{ENDING}|{LETTER}+|{NUMBER}|{SIGN}+")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = WordTable(self._runs, [np.uint32, np.uint8])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the library does without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        """The words of a text in order; added tokens, matched first, stand as themselves."""
        if self.marks and self.marks.search(text):
            return [w for part in self.marks.split(text) if part for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not UNSAFE.search(text):
            return self.cut.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in pieces]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, merged together through one pair occurrence index."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        starts = np.concatenate([[0], stops[:-1]])
        first = self.inside[flat]
        first[stops - 1] = self.final[flat[stops - 1]]
        following = np.arange(1, len(flat) + 1)
        following[stops - 1] = -1
        leading = np.arange(-1, len(flat) - 1)
        leading[starts] = -1
        where = self._index(first, following)
        sym, after, before, pairs, made_of = first.tolist(), following.tolist(), leading.tolist(), self.pairs, self.by_rank
        heap = sorted(where)
        while heap:
            rank = heappop(heap)
            if rank not in where:
                continue
            a, b, made = made_of[rank]
            places = sorted(where.pop(rank))
            for k, i in enumerate(places):
                j = after[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue
                sym[i], sym[j] = made, -1
                after[i] = n = after[j]
                lower = False
                if n >= 0:
                    before[n] = i
                    new = pairs.get(made << 32 | sym[n])
                    if new is not None:
                        if new in where:
                            where[new].append(i)
                        else:
                            where[new] = [i]
                            heappush(heap, new)
                        lower = new < rank
                p = before[i]
                if p >= 0:
                    new = pairs.get(sym[p] << 32 | made)
                    if new is not None:
                        if new in where:
                            where[new].append(p)
                        else:
                            where[new] = [p]
                            heappush(heap, new)
                        lower |= new < rank
                if lower:  # a pair of a lower rank goes first; the other positions wait
                    where.setdefault(rank, []).extend(places[k + 1 :])
                    heappush(heap, rank)
                    break
        last = np.array(sym)
        alive = last >= 0
        ids, ends = last[alive].tolist(), np.cumsum(np.add.reduceat(alive, starts)).tolist()
        return [ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def _index(self, sym: np.ndarray, after: np.ndarray) -> dict[int, list[int]]:
        """Ranks of the pairs that stand side by side, with all their positions in ascending order."""
        keys = sym[:-1] << 32 | sym[1:]
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        places = np.flatnonzero((after[:-1] >= 0) & (self.pair_keys[at] == keys))
        ranks = self.pair_ranks[at[places]]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order].tolist()
        begin = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else np.zeros(0, np.int64)
        return {r: places[i:j] for r, i, j in zip(ranks[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(places)], strict=False)}

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; added tokens are their own."""
        plain = [w for w in words if w not in self.special]
        found = {}
        for at in range(0, len(plain), TOGETHER):
            found |= dict(zip(plain[at : at + TOGETHER], self.merge(plain[at : at + TOGETHER]), strict=True))
        return [found[w] if w in found else [self.special[w]] for w in words]

    def _runs(self, words: list[str]) -> list[list]:
        """For the table: ids of words, and the text they decode to with the space that joins it to the next."""
        ids = self.ids_of(words)
        return [ids, [f"{self.decode(i)} ".encode() for i in ids]]

    def _one(self, text: str) -> tuple[bytes, bytes]:
        words = self.words(text)
        known = sorted(set(words))
        ids = dict(zip(known, self.ids_of(known), strict=True))
        every = [i for w in words for i in ids[w]]
        return np.array(every, "<u4").tobytes(), self.decode(every).encode()

    def _block(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        text, codes, firsts = codes_of([t.lower() for t in texts])
        begin, end = bare_words(codes, firsts)
        slot = self.table.find(text, codes, begin, end)
        if slot is None:
            return list(map(self._one, texts))
        out = []
        for k in range(2):
            flat, count = self.table.values(slot, k)
            raw, stop = flat.tobytes(), np.cumsum(per_text(count, begin, firsts)) * flat.itemsize
            out.append([raw[i:j] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)])
        return [(ids, spelt[:-1]) for ids, spelt in zip(*out, strict=True)]

    def round_trips(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Little-endian 32-bit ids and decoded text in UTF-8 of each text."""
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(texts)
        group: list[int] = []
        length = 0

        def flush() -> None:
            nonlocal group, length
            for k, found in zip(group, self._block([texts[k] for k in group]) if group else [], strict=True):
                out[k] = found
            group, length = [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            # Lower case can double a text's length.
            if 2 * len(text) > BLOCK or UNSAFE_LOWER.search(text) or (self.marks and self.marks.search(text)):
                out[k] = self._one(text)
                continue
            if length + 2 * len(text) > BLOCK:
                flush()
            group.append(k)
            length += 2 * len(text)
        flush()
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.round_trips([text])[0][0], "<u4").tolist()


@cache
def pair_bpe(path: str) -> PairBpe:
    """One vocabulary a Python worker, so that its words outlive a task."""
    return PairBpe(path)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 for every row.

    Null texts are empty: no ids, and the digests of nothing; repeated rows and null ids come out as they went in,
    an empty table gives no rows, other columns are ignored. No row depends on another, so there is no exchange.
    A very long text goes word by word, with memory for its distinct words and its ids. path is the tokenizer's
    file on every executor.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pair_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = bpe.round_trips([t or "" for t in part.column(1).to_pylist()])
                out = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(spelt).hexdigest()) for ids, spelt in found]
                n, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
