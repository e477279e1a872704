"""Byte-level BPE through the tokenizers library, a distinct word at a time.

The library's rule cuts a text into words whose ids do not depend on their neighbours; only words that are
not in the table go to the library's model. Texts beyond the simple character range, very long ones, or
with an added token go to the library whole.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from quillspark.llm.alphabet import UNSAFE, byte_alphabet
from quillspark.llm.word_table import BLOCK, WordTable, codes_of, glued_words, per_text


class WordEncoder:
    """Texts to ids, as the library's encode(add_special_tokens=False) gives them."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.letters = byte_alphabet()
        self.plain = {b: self.letters[b] for b in range(128)}
        self.table = WordTable(self._ids, [np.uint32])

    @property
    def size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def _ids(self, words: list[str]) -> list[list]:
        spelt = [w.translate(self.plain) if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in words]
        return [[[t.id for t in self.library.model.tokenize(s)] for s in spelt]]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty texts of at most BLOCK code points together, and their counts."""
        text, codes, firsts = codes_of(texts)
        begin, end = glued_words(codes, firsts)
        slot = self.table.find(text, codes, begin, end)
        if slot is None:
            found = list(map(self._whole, texts))
            return np.concatenate(found), np.array([len(f) for f in found])
        ids, count = self.table.values(slot, 0)
        return ids, per_text(count, begin, firsts)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each has."""
        counts, parts = np.zeros(len(texts), np.int64), []
        group, length = [], 0

        def flush() -> None:
            nonlocal group, length
            if group:
                ids, n = self._block([texts[k] for k in group])
                counts[group] = n
                parts.append((group, ids))
            group, length = [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            if len(text) > BLOCK or UNSAFE.search(text) or self.marks.search(text):
                ids = self._whole(text)
                counts[k] = len(ids)
                parts.append(([k], ids))
                continue
            if length + len(text) > BLOCK:
                flush()
            group.append(k)
            length += len(text)
        flush()
        out, begin = np.zeros(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        for some, ids in parts:
            n = counts[some]
            out[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, so that its words outlive a task."""
    return WordEncoder(path)
