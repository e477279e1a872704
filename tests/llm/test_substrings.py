"""Cuts by hand, and shared spans of documents against a brute-force version on texts with repeated and null ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import gear_chunks

SCHEMA = "doc_id bigint, text string"


def test_gear():
    data = np.random.default_rng(4).integers(0, 256, 5000, dtype=np.uint8)
    table, at = gear_chunks.GEAR.tolist(), 777
    by_hand = sum(table[data[at - k]] << k for k in range(gear_chunks.WINDOW)) & 0xFFFFFFFF
    assert int(gear_chunks.gear(data)[at]) == by_hand


def by_hand(text):
    """Ends of chunks and words begun up to each, word by word."""
    ends, words, begun = [], [], 0
    for k, byte in enumerate(text):
        blank = byte in b" \t\n\v\f\r"
        if not blank and (k == 0 or text[k - 1] in b" \t\n\v\f\r"):
            begun, start = begun + 1, k
        h = sum(int(gear_chunks.GEAR[text[k - j]]) << j for j in range(min(gear_chunks.WINDOW, k + 1))) & 0xFFFFFFFF
        stop = not blank and (k + 1 == len(text) or text[k + 1] in b" \t\n\v\f\r")
        inner = not blank and k - start + 1 > gear_chunks.LONG_WORD and h < (1 << 32) // gear_chunks.APART
        if stop or inner:
            ends.append((k + 1, h))
            words.append(begun)
    r = gear_chunks.RADIUS
    least = [k for k in range(len(ends)) if all(ends[k][1] <= e[1] for e in ends[max(0, k - r) : k + r + 1])]
    out = [(ends[k][0], words[k]) for k in least]
    return out if not text or (out and out[-1][0] == len(text)) else [*out, (len(text), words[-1] if words else 0)]


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_cuts(block, monkeypatch):
    monkeypatch.setattr(gear_chunks, "BLOCK", block)
    rng = random.Random(1)
    texts = [b"", b" ", b"\n a", b"a", b"x" * 500, b"same " * 60, " 漢字".encode() * 90, b"  two\t\tgaps " * 20]
    texts += [" ".join("".join(rng.choices("abcde", k=rng.choice([1, 2, 5, 9, 120]))) for _ in range(80)).encode() for _ in range(6)]
    for text in texts:
        stops, words = gear_chunks.cuts(text)
        assert list(zip(stops.tolist(), words.tolist(), strict=True)) == by_hand(text)


def spans(rows, least):
    """What substring_dedup says of rows (id, text), from every chunk of every text; rows without an id stand alone."""
    docs = []
    for k, (i, text) in enumerate(rows):
        key = (0, i) if i is not None else (k + 1, None)
        if text and (key, text) not in docs:
            docs.append((key, text))
    places = {}
    cut = []
    for key, text in docs:
        raw = text.encode()
        stops, words = gear_chunks.cuts(raw)
        starts = [0, *stops[:-1].tolist()]
        some = [(i, j, w, raw[i:j]) for i, j, w in zip(starts, stops.tolist(), np.diff(words, prepend=0).tolist(), strict=True)]
        cut.append((key, some))
    held = {}
    for k, (i, text) in enumerate(rows):  # repeated rows count as copies
        key = (0, i) if i is not None else (k + 1, None)
        for other, some in cut:
            if other == key and text and "".join(c.decode("utf-8", "surrogateescape") for *_, c in some) == text:
                for start, _, _, c in some:
                    held.setdefault(c, []).append((key, start))
    places = {c: (min(p, key=lambda x: (x[0][0], x[0][1] or 0, x[1])), len(p)) for c, p in held.items() if len({k for k, _ in p}) > 1}
    out = []
    for key, some in cut:
        run = []
        for piece in [*some, None]:
            if piece is not None and piece[3] in places:
                run.append(piece)
                continue
            if run and sum(r[2] for r in run) >= least:
                part = []
                own = [places[r[3]][0] == (key, r[0]) for r in run]
                for r, o in zip(run, own, strict=True):
                    if part and part[-1][0] == o:
                        part[-1][1].append(r)
                    else:
                        part.append((o, [r]))
                for o, rs in part:
                    firsts = [places[r[3]][0][0][1] for r in rs]
                    ids = [f for f in firsts if f is not None]
                    out.append((key[1], rs[0][0], rs[-1][1] - rs[0][0], sum(r[2] for r in rs), len(rs), min(ids) if ids else None, max(places[r[3]][1] for r in rs), o))
            run = []
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    shared = [words(rng.randrange(20, 120)) for _ in range(6)] + ["same " * 80]
    text = lambda: " ".join(x for _ in range(4) for x in (words(rng.randrange(1, 40)), rng.choice(shared)))
    texts = [text() for _ in range(25)]
    rows = [(rng.choice([None, *range(20)]), rng.choice(texts)) for _ in range(60)]
    return [*rows, *rows[:5], (3, None), (4, ""), (None, texts[0]), (None, texts[0])]


@pytest.mark.parametrize("hot", [False, True])
def test_spans_by_brute_force(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(gear_chunks, "SEEN", 2)
        monkeypatch.setattr(gear_chunks, "QUARTER", 10**6)
    for seed in range(2):
        rows = made(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        if hot:
            assert gear_chunks._hot(df, "doc_id", "text").count() > 20
        found = sorted(map(tuple, gear_chunks.substring_dedup(df, octets=10**9).collect()), key=str)
        assert found == spans(rows, gear_chunks.WORDS)


def test_judge_cases(spark):
    """Repeated and null ids keep whole spans."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    t, u = words(200), words(200)
    find = lambda rows: {(r.doc_id, r.n_bytes, r.kept) for r in gear_chunks.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert find([(1, t), (1, t), (2, t)]) == {(1, len(t), True), (2, len(t), False)}
    assert find([(1, t), (1, u), (2, t), (4, u)]) == {(1, len(t), True), (1, len(u), True), (2, len(t), False), (4, len(u), False)}
    assert find([(None, t), (None, t)]) == {(None, len(t), True), (None, len(t), False)}
    assert find([(None, t), (7, t)]) == {(None, len(t), False), (7, len(t), True)}


def test_passages_of_over_fifty_words(spark):
    """Of passages of 51 words in random texts, nearly all are found; of 20 words none."""
    rng = random.Random(9)
    words = lambda n, k: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, k))) for _ in range(n))
    rows = []
    for k in range(600):
        passage = words(51 if k < 500 else 20, 4 if k % 2 else 12)
        rows += [(2 * k, f"{words(60, 12)} {passage} {words(50, 12)}"), (2 * k + 1, f"{words(70, 12)} {passage} {words(40, 12)}")]
    found = {r.doc_id for r in gear_chunks.substring_dedup(spark.createDataFrame(rows, SCHEMA)).select("doc_id").distinct().collect()}
    assert len([i for i in found if i < 1000]) >= 985 and max(found) < 1000


def test_extra_columns(spark):
    rows = made(5)
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df
    for name in ("u", "d1", "f", "start", "pieces", "copies"):
        odd = odd.withColumn(name, F.lit("clash"))
    run = lambda x: sorted(map(tuple, gear_chunks.substring_dedup(x).collect()), key=str)
    assert run(odd) == run(df)
