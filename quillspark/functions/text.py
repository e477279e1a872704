"""Text functions as Column expressions; Python only where the JVM has no counterpart (NFKC)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.lazy import lazy_udf

SPACE = r"(?U)[\s\x1c-\x1f]"
IDEOGRAPH = "一-鿿"
JOINABLE = IDEOGRAPH + r"\p{Nd}.%，。、；：！？（）《》“”‘’,"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, rf"{SPACE}+\z|\A{SPACE}+", "")


def despaced(text: Column) -> Column:
    """Spaces between letters that were set one by one are dropped: where at least 8 ideographs are there
    and a fifth of them stand before a space and another one."""
    letters = F.regexp_count(text, F.lit(f"[{IDEOGRAPH}]"))
    spaced = F.regexp_count(text, F.lit(f"[{IDEOGRAPH}][ \\t　]+(?=[{IDEOGRAPH}])"))
    joined = F.regexp_replace(text, f"(?<=[{JOINABLE}])[ \\t　]+(?=[{JOINABLE}])", "")
    return F.when((letters >= 8) & (spaced * 5 >= letters), joined).otherwise(text)


def cleaned(text: Column) -> Column:
    """Without inline tags, link targets, bold marks and spaced-out letters; blanks single, ends trimmed."""
    steps = [
        (r"(?i)</?(?:sup|sub|span|b|i|u|em|strong|br)\b[^>]*>", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\*\*(.+?)\*\*", "$1"),
        (r"\*\*", ""),
    ]
    plain = reduce(lambda c, s: F.regexp_replace(c, *s), steps, F.coalesce(text, F.lit("")))
    return strip(F.regexp_replace(despaced(plain), "[ \\t　]+", " "))


def squashed(text: Column) -> Column:
    """Without white space, full-width brackets as ASCII ones."""
    return F.translate(F.regexp_replace(text, SPACE, ""), "（）", "()")


@lazy_udf("string")
def normal(text: pd.Series) -> pd.Series:
    """NFKC without white space; null as empty."""
    return text.map(lambda t: "".join(unicodedata.normalize("NFKC", t or "").split()))


def is_subsequence(short: Column, text: Column) -> Column:
    """Whether the characters of short occur in text in this order."""
    letters = F.filter(F.split(short, ""), lambda c: c != "")
    after = lambda c, p: F.coalesce(F.nullif(F.call_function("locate", c, text, p + 1), F.lit(0)), F.lit(-1))
    return F.aggregate(letters, F.lit(0), lambda p, c: F.when(p < 0, p).otherwise(after(c, p))) >= 0


def sentences(text: Column, ends: str = rules.CHUNK_SENTENCE_ENDS) -> Column:
    """Pieces of text, each up to and with one of the ends; none is empty."""
    return F.filter(F.split(text, f"(?<=[{ends}])"), lambda s: s != "")


def first_sentence_end(text: Column, ends: str = rules.GUARD_SENTENCE_ENDS) -> Column:
    """Position from 0 of the earliest sentence end, -1 without one."""
    return F.regexp_instr(text, F.lit(f"[{ends}]")) - 1


def fit_bytes(text: Column, most: int) -> Column:
    """The longest beginning of text that takes at most so many bytes in UTF-8."""
    raw = text.cast("binary")
    tries = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries))


def content_type(folder: Column, name: Column, by_name: Sequence = rules.FILE_TYPES, by_folder: Sequence = rules.FOLDER_TYPES, other: str = rules.OTHER_TYPE) -> Column:
    """The type of the first word of by_name in the file name, else of by_folder in the folder."""
    found = [F.when(col.contains(word), F.lit(kind)) for col, words in ((name, by_name), (folder, by_folder)) for word, kind in words]
    return F.coalesce(*found, F.lit(other))


def title(stem: Column) -> Column:
    """A file's stem without a leading date."""
    return strip(F.regexp_replace(stem, rf"(?U)^\d{{4}}-\d{{2}}-\d{{2}}{SPACE[4:]}*", ""))


def section(path: Column) -> Column:
    return F.array_join(path, " > ")


def joined_nonempty(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def embed_text(title_: Column, kind: Column, path: Column, body: Column) -> Column:
    """What an embedder reads: title, type and section on a line, then the body."""
    return F.concat_ws("\n", F.nullif(joined_nonempty(" · ", title_, kind, path), F.lit("")), body)


def public_url(base: Column, name: Column) -> Column:
    """base/name with the name percent-encoded, slashes kept."""
    coded = F.replace(F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))
    return F.concat_ws("/", base, F.replace(coded, F.lit("*"), F.lit("%2A")))


def server_event(event: Column, payload: Column) -> Column:
    return F.format_string("event: %s\ndata: %s\n\n", event, F.to_json(payload))


def hit_list(col: Column, pairs: dict[str, str]) -> Column:
    """Texts of the names in an array column, in its order; unknown names are left out."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.filter(F.transform(col, lambda n: F.try_element_at(table, n)), lambda t: t.isNotNull())


def filled(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled by columns, null as empty; an unknown name is an error."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])
