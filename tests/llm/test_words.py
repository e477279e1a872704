"""The word table and both encoders against the tokenizers library, on random texts."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from quillspark.llm import word_table  # noqa: E402
from quillspark.llm.pair_bpe import pair_bpe  # noqa: E402
from quillspark.llm.word_cache import word_encoder  # noqa: E402

CHARACTERS = "ab é1²!,.' \n\t \x85_stvrelmdSİß“ȺȾK"
TEXTS = st.lists(st.one_of(st.text(CHARACTERS, max_size=14), st.text(max_size=10), st.sampled_from(["<|endoftext|>x", "a<|startoftext|>"])), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_encoders(texts):
    encoder = word_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, counts = encoder(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    bpe = pair_bpe(public_tokenizers.path("word_bpe_49k.json"))
    for text, (ids, spelt) in zip(texts, bpe.round_trips(texts), strict=True):
        want = bpe.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and spelt.decode() == bpe.library.decode(want, skip_special_tokens=False)


def test_table_starts_anew(monkeypatch):
    monkeypatch.setattr(word_table, "SLOTS", 1 << 8)
    table = word_table.WordTable(lambda words: [[w.encode() for w in words]], [np.uint8])
    for n in range(40):
        text, codes, firsts = word_table.codes_of([" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n, n + 60))])
        begin, end = word_table.bare_words(codes, firsts)
        flat, count = table.values(table.find(text, codes, begin, end), 0)
        assert flat.tobytes().decode() == text.replace(" ", "") and count.tolist() == [2] * 60 and table.used <= 1 << 7


def test_words_cut_at_once_take_little_memory():
    """What a worker holds to cut a block: codes, classes, and prefix sums and powers for two hashes."""
    text = " ".join(f"word{i % 5000}" for i in range(60_000))[: word_table.BLOCK]
    table = word_table.WordTable(lambda words: [[[len(w)] for w in words]], [np.uint32])
    tracemalloc.start()
    word, codes, firsts = word_table.codes_of([text])
    begin, end = word_table.bare_words(codes, firsts)
    slot = table.find(word, codes, begin, end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert slot is not None and peak < 48 << 20
