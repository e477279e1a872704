"""Language identification by compression.

Each language has a raw-content zstandard dictionary of text in it, in lower case. A text, in lower case too,
is compressed in blocks with every dictionary; the language with the smallest total wins. A narrow margin is
flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: The bounded sample a dictionary is made of: whole texts of a language, by a hash of id and text, at most so many of
#: them and so many bytes together; a text over BUDGET bytes teaches nothing.
SAMPLE_TEXTS, BUDGET, PARTS = 2000, 240_000, 32
#: Level, and bytes that are compressed at once.
LEVEL, BLOCK = 6, 1 << 13
#: Saved bytes to odds, and the score below which a prediction is rejected as too narrow.
SHARPNESS, LEAST_SCORE = 0.35, 0.6


def fit(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary per language of whole texts, at most SAMPLE_TEXTS and BUDGET bytes, of rows for which learn holds.

    Null texts and languages teach nothing; texts of least hash come first, and equal ones teach once. Sizes are ranked
    before texts are read, so that only the sample's texts leave their tasks, for the driver. An empty table gives no
    dictionaries; other columns are ignored.
    """
    size = F.octet_length(text_col)
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (size <= BUDGET)).select(
        F.col(lang_col).alias("l"), F.xxhash64(id_col, text_col).alias("h"), size.alias("size"), F.col(text_col).alias("t")
    )
    # The first of each part of a language, then of the language: its second task reads no more than PARTS samples.
    ranked = rows.select("l", "h", "size", F.pmod("h", F.lit(PARTS)).alias("part"))
    for keys in (["l", "part"], ["l"]):
        ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "size"))).where(f"n <= {SAMPLE_TEXTS}")
    last: dict[str, int] = {}
    held: dict[str, int] = {}
    for lang, h, n in sorted({(r.l, r.h, r.size) for r in ranked.collect()}):
        held[lang] = held.get(lang, 0) + n
        if held[lang] <= BUDGET:
            last[lang] = h
    if not last:
        return {}
    least = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    out: dict[str, list[str]] = {}
    for row in sorted(rows.where(F.col("h") <= F.element_at(least, F.col("l"))).select("l", "h", "t").distinct().collect()):
        out.setdefault(row.l, []).append(row.t)
    return {k: "\n".join(v).lower().encode() for k, v in sorted(out.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self.packers = list(map(self._packer, dictionaries.values()))

    @staticmethod
    def _packer(content: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8", "surrogatepass")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.packers]

    def predict(self, text: str | None) -> tuple[str, float, bool, list[int]]:
        """Language, score, rejected, bytes by language. No letter, or no language learnt: ``und`` with score 0."""
        if text is None or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, True, []
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], self.langs[k]))
        score = 1 / sum(exp(-SHARPNESS * min(s - sizes[best], 2000)) for s in sizes)
        return self.langs[best], score, score < LEAST_SCORE, sizes


def predict(df: DataFrame, dictionaries: dict[str, bytes], carry: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of carry, with lang_pred, score and rejected, for every row and whole text of df.

    Only the text is an input of a prediction. The dictionaries, bounded by fit(), travel with the tasks. Null texts
    and texts without a letter are ``und``; repeated rows come out alike, an empty table gives no rows, and a very
    long text is compressed whole, block by block. carry may hold any columns of df but names of the three.
    """
    names = [*carry, "lang_pred", "score", "rejected"]
    kept = df.select(*[c.alias(k) for k, c in carry.items()], F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
