"""Words of many texts at once: cut by classes of characters, known by prefix hashes, kept in a table.

A word is known by two prefix hashes of 64 bits. The table maps the first to a slot and holds the second
as proof; with each word it keeps runs of values (ids, bytes) in pools. It lasts as long as the Python worker.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

#: Slots of a table (a power of two), filled to half before it starts anew; code points cut at once.
SLOTS, BLOCK = 1 << 20, 1 << 18
LETTER, NUMBER, SIGN, BLANK, OTHER_BLANK, NOTHING = range(6)
LAST = 0x300  # stands for all signs beyond the simple letters
#: What may follow an apostrophe as one word with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """Class of every code point below LAST, by Unicode category; LAST itself is a sign."""
    out = np.full(LAST + 1, SIGN, np.uint8)
    for c in range(LAST):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else SIGN
    out[[9, 10, 11, 12, 13, 0x85, 0xA0]] = OTHER_BLANK
    out[32] = BLANK
    return out


CLASSES = _classes()
_random = np.random.default_rng(11)
#: Random values of code points, and an odd base, for each of two hashes modulo 2**64.
VALUES = [_random.integers(0, 1 << 64, 0x2060, dtype=np.uint64) for _ in range(2)]
BASES = [int(b) | 1 for b in _random.integers(0, 1 << 63, 2)]


@cache
def _powers(base: int) -> np.ndarray:
    out, step = np.ones(BLOCK + 1, np.uint64), 1
    while step <= BLOCK:
        out[step : 2 * step] = out[: len(out[step : 2 * step])] * np.uint64(pow(base, step, 1 << 64))
        step *= 2
    return out


def _neighbours(codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = CLASSES[np.minimum(codes, LAST)]
    before = np.concatenate([[NOTHING], kind[:-1]]).astype(np.uint8)
    before[firsts] = NOTHING
    after = np.concatenate([kind[1:], [NOTHING]]).astype(np.uint8)
    after[firsts[1:] - 1] = NOTHING
    return kind, before, after


def _endings(codes: np.ndarray, firsts: np.ndarray, begins: np.ndarray, heads: np.ndarray) -> None:
    """Mark, in begins, words of an apostrophe at heads and an ending: nothing begins inside, something after."""
    heads = np.flatnonzero(heads)
    if not len(heads):
        return
    limit = np.append(firsts, len(codes))[np.searchsorted(firsts, heads, side="right")]
    beyond = np.concatenate([codes, np.zeros(3, codes.dtype)])
    free = np.ones(len(heads), bool)
    for ending in ENDINGS:
        size = len(ending)
        fits = free & (heads + size < limit)
        for k, c in enumerate(ending, 1):
            fits &= beyond[heads + k] == ord(c)
        free &= ~fits
        at = heads[fits]
        begins[at] = True
        for k in range(1, size + 1):
            begins[at + k] = False
        rest = at + size + 1
        begins[rest[rest < limit[fits]]] = True


def glued_words(codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of words that a blank before them belongs to, white space included.

    A blank before letters, numbers or signs belongs to them; of a longer run of white space only its last
    blank does. A run's last character, before anything else, always begins a word of its own or the next.
    """
    kind, before, after = _neighbours(codes, firsts)
    word = (before != kind) & (before != BLANK)
    gap = (before < BLANK) | (before == NOTHING) | (after < BLANK)
    begins = np.where(kind >= BLANK, gap, word)
    _endings(codes, firsts, begins, (codes == 39) & (before != SIGN) & (before != BLANK))
    begin = np.flatnonzero(begins)
    return begin, np.append(begin[1:], len(codes))


def bare_words(codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of runs of letters, single numbers and runs of signs; white space is left out."""
    kind, before, _ = _neighbours(codes, firsts)
    begins = (before != kind) | (kind == NUMBER)
    _endings(codes, firsts, begins, (codes == 39) & (before != SIGN))
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], len(codes))
    words = kind[begin] < BLANK
    return begin[words], end[words]


class WordTable:
    """Runs of values of words, one run a pool: ``learn`` gives a list of runs for each pool, by word."""

    def __init__(self, learn: Callable[[list[str]], list[list]], kinds: list[type]) -> None:
        self.learn, self.kinds = learn, kinds
        self.clear()

    def clear(self) -> None:
        self.used = 0
        self.keys, self.proofs = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at = [np.zeros(SLOTS, np.int64) for _ in self.kinds]
        self.count = [np.zeros(SLOTS, np.int32) for _ in self.kinds]
        self.pools = [np.zeros(SLOTS, k) for k in self.kinds]
        self.pooled = [0 for _ in self.kinds]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the empty one where it belongs."""
        slot = (keys >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % SLOTS
            held = self.keys[slot[open_]]
            open_ = open_[(held != keys[open_]) & (held != 0)]
        return slot

    def _add(self, words: list[str], keys: np.ndarray, proofs: np.ndarray) -> None:
        """Put distinct words that are not in the table into it."""
        places = []
        for k, runs in enumerate(self.learn(words)):
            count = np.fromiter(map(len, runs), np.int64, len(runs))
            if self.kinds[k] is np.uint8:
                flat = np.frombuffer(b"".join(runs), np.uint8)
            else:
                flat = np.fromiter((v for run in runs for v in run), self.kinds[k], int(count.sum()))
            begin, end = self.pooled[k], self.pooled[k] + len(flat)
            while end > len(self.pools[k]):
                self.pools[k] = np.concatenate([self.pools[k], np.zeros_like(self.pools[k])])
            self.pools[k][begin:end] = flat
            self.pooled[k] = end
            places.append((begin + np.cumsum(count) - count, count))
        left = np.arange(len(words))
        while len(left):  # of words that want one slot, one gets it
            slot, first = np.unique(self._slots(keys[left]), return_index=True)
            won = left[first]
            self.keys[slot], self.proofs[slot] = keys[won], proofs[won]
            for k, (at, count) in enumerate(places):
                self.at[k][slot], self.count[k][slot] = at[won], count[won]
            left = np.delete(left, first)
        self.used += len(words)

    def find(self, text: str, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray | None:
        """The slots of words, learnt where they are new; None if two words share a hash, which is not to be expected."""
        hashes = []
        for values, base in zip(VALUES, BASES, strict=True):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[codes] * _powers(base)[: len(codes)])])
            hashes.append((sums[end] - sums[begin]) * _powers(pow(base, -1, 1 << 64))[begin])
        keys, proofs = np.maximum(hashes[0], np.uint64(1)), hashes[1]
        slot = self._slots(keys)
        new = np.flatnonzero(self.keys[slot] == 0)
        if len(new):
            if self.used + len(new) > SLOTS // 2:
                self.clear()
                new = np.arange(len(keys))
            _, some = np.unique(keys[new], return_index=True)
            some = new[some]
            self._add([text[i:j] for i, j in zip(begin[some].tolist(), end[some].tolist(), strict=True)], keys[some], proofs[some])
            slot = self._slots(keys)
        return slot if (self.proofs[slot] == proofs).all() else None

    def values(self, slot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The runs of pool k of words at these slots, one after the other, and the length of each."""
        count = self.count[k][slot].astype(np.int64)
        before = np.cumsum(count) - count
        return self.pools[k][np.repeat(self.at[k][slot] - before, count) + np.arange(int(count.sum()))], count


def codes_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """Non-empty texts as one, its code points, and where each text begins."""
    text = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes


def per_text(count: np.ndarray, begin: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the words' counts in each text, by where words and texts begin."""
    ends = np.concatenate([[0], np.cumsum(count)])
    borders = np.append(np.searchsorted(begin, firsts), len(begin))
    return ends[borders[1:]] - ends[borders[:-1]]
