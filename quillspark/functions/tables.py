"""HTML tables as rectangular grids: spans painted out, header found, rows as text.

``Table`` is what one table knows about itself; ``parse`` is a pandas UDF over a column of HTML.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.lazy import lazy_udf

NUMBER, UNIT = re.compile(rules.NUMBER_CELL + r"\Z"), re.compile(rules.UNIT_CELL + r"\Z")
ROW, INNER = re.compile(r"<tr\b.*?</tr>", re.S | re.I), re.compile(r"\s*<table\b[^>]*>(.*)</table>\s*\Z", re.S | re.I)
BREAKS, CELLS = {"br", "p", "div"}, {"td", "th"}


def is_number(text: str) -> bool:
    return NUMBER.match(text.replace(" ", "")) is not None


@dataclass
class Cell:
    down: int
    across: int
    heading: bool
    pieces: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class Reader(HTMLParser):
    """Rows of the outermost table as (cells, whether inside thead); text of inner tables goes to the outer cell."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[list[Cell], bool]] = []
        self.inside, self.head, self.cell = 0, False, None
        self.feed(html)
        self.close()

    @staticmethod
    def span(value: str | None) -> int:
        try:
            return max(int(value or 1), 1)
        except ValueError:
            return 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.inside += 1
        elif self.inside > 1:
            if tag in BREAKS | CELLS | {"tr"} and self.cell:
                self.cell.pieces.append(" ")
        elif tag in BREAKS and self.cell:
            self.cell.pieces.append(" ")
        elif tag == "thead":
            self.head = True
        elif tag == "tr" or (tag in CELLS and not self.rows):
            self.rows.append(([], self.head))
        if tag in CELLS and self.inside <= 1:
            known = dict(attrs)
            self.cell = Cell(self.span(known.get("rowspan")), self.span(known.get("colspan")), tag == "th")
            self.rows[-1][0].append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.inside -= 1
            self.cell = self.cell if self.inside else None
        elif self.inside <= 1 and tag in CELLS:
            self.cell = None
        elif self.inside <= 1 and tag == "thead":
            self.head = False

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.cell.pieces.append(data)


class Table:
    """grid: texts, merged cells repeated; origin: the number of the cell each comes from, 0 for none."""

    def __init__(self, html: str) -> None:
        rows = [r for r in Reader(html or "").rows if r[0]]
        canvas: dict[tuple[int, int], tuple[str, int]] = {}
        number = 0
        for y, (cells, _) in enumerate(rows):
            x = 0
            for cell in cells:
                while (y, x) in canvas:
                    x += 1
                number += 1
                text = cell.text
                for dy in range(min(cell.down, len(rows) - y)):
                    canvas.update({(y + dy, x + dx): (text, number) for dx in range(cell.across)})
                x += cell.across
        self.n_cols = 1 + max((x for _, x in canvas), default=-1)
        at = [[canvas.get((y, x), ("", 0)) for x in range(self.n_cols)] for y in range(len(rows))]
        self.grid, self.origin = ([[c[k] for c in row] for row in at] for k in (0, 1))
        self.header_rows = self._header(rows)
        if any(is_number(v) or len(v) > rules.HEADER_CELL_MOST for row in self.grid[: self.header_rows] for v in row):
            self.header_rows = 0
        self.kv = not self.header_rows and self._pairs_throughout()

    def _header(self, rows: list[tuple[list[Cell], bool]]) -> int:
        most = len(rows) - 1
        if most < 1:
            return 0
        marked = sum(head for _, head in rows)
        headed = next((k for k, (cells, _) in enumerate(rows) if not all(c.heading for c in cells)), len(rows))
        return min(marked or headed or max(c.down for c in rows[0][0]), most)

    def _pairs_throughout(self) -> bool:
        if self.n_cols % 2 or not self.grid:
            return False
        for y in range(len(self.grid)):
            values = self.values(y)
            filled = max((x for x, v in enumerate(values) if v), default=-1)
            keys = [v for x, v in enumerate(values) if x % 2 == 0 and (x == 0 or x <= filled)]
            if any(not k or len(k) > rules.LABEL_CELL_MOST or is_number(k) for k in keys):
                return False
        return True

    def values(self, y: int) -> list[str]:
        """A row's texts, a cell that spans columns only once."""
        row, own = self.grid[y], self.origin[y]
        return [v if not x or not own[x] or own[x] != own[x - 1] else "" for x, v in enumerate(row)]

    @property
    def data_rows(self) -> range:
        return range(self.header_rows, len(self.grid))

    @cached_property
    def columns(self) -> list[str]:
        """Header texts of each column from above, without repeats; a unit in the first place names no column."""
        names = ["·".join(dict.fromkeys(v for v in column if v)) for column in zip(*self.grid[: self.header_rows], strict=True)] or [""] * self.n_cols
        return [rules.FIRST_COLUMN, *names[1:]] if names and UNIT.match(names[0]) else names

    @property
    def unit(self) -> str:
        first = self.grid[0][0] if self.header_rows else ""
        return first if UNIT.match(first) else ""

    def spanning(self, y: int) -> bool:
        return self.n_cols > 1 and sum(map(bool, self.values(y))) == 1 and sum(map(bool, self.grid[y])) > 1

    @cached_property
    def columns_of(self) -> dict[int, list[str]]:
        """The column names that hold for each data row; a second header among them renames what follows."""
        names, out = self.columns, {}
        for y in self.data_rows:
            values = self.values(y)
            filled = [v for v in values if v]
            second = (
                self.header_rows and not self.kv and len(filled) > 1 and values[0] in ("", names[0])
                and not any(is_number(v) or v in ("-", "—") or len(v) > rules.HEADER_CELL_MOST for v in filled)
            )
            if second:
                names = [v or n for v, n in zip(values, names, strict=True)]
            else:
                out[y] = names
        return out

    def line(self, y: int) -> str | None:
        """``column=value；…`` of a data row; None for an empty row or a second header."""
        values = self.values(y)
        if not any(values) or y not in self.columns_of:
            return None
        if self.spanning(y):
            return next(v for v in values if v)
        if self.kv:
            parts = ["=".join(filter(None, values[x : x + 2])) for x in range(0, self.n_cols, 2)]
        else:
            parts = [v if n in ("", v) else f"{n}={v}" for n, v in zip(self.columns_of[y], values, strict=True) if v]
        return "；".join(filter(None, parts))

    def lines(self, rows: Iterable[int] | None = None) -> list[str]:
        return [t for t in map(self.line, self.data_rows if rows is None else rows) if t is not None]

    def markdown(self, rows: Iterable[int] | None = None) -> str:
        if not self.grid:
            return ""
        show = lambda vs: f"| {' | '.join(v.replace('|', chr(92) + '|').replace(chr(10), ' ') for v in vs)} |"
        head = self.columns if self.header_rows else [""] * self.n_cols
        return "\n".join([show(head), "|" + "---|" * self.n_cols, *(show(self.values(y)) for y in (self.data_rows if rows is None else rows))])

    def parts(self, most: int) -> list[list[int]]:
        """Data rows in groups whose lines take at most so many characters; a longer row stands alone."""
        out: list[list[int]] = []
        used = 0
        for y in self.data_rows:
            size = sum(len(t) + 1 for t in self.lines([y]))
            if not out or used + size > most:
                out.append([])
                used = 0
            out[-1].append(y)
            used += size
        return out

    def facts(self) -> Iterator[tuple[str, str, str]]:
        """(item, column, value) of every filled cell; column is empty in a table of pairs."""
        if self.kv:
            for y in range(len(self.grid)):
                values = self.values(y)
                yield from ((k, "", v) for k, v in zip(values[::2], values[1::2], strict=True) if k and v)
            return
        for y, names in self.columns_of.items():
            values = self.values(y)
            if values[0] and not self.spanning(y):
                yield from ((values[0], n, v) for n, v in zip(names[1:], values[1:], strict=True) if v)


def merged(first: str, second: str) -> str:
    """first with the rows of its continuation second, whose repeated header goes."""
    top, below = Table(first), Table(second)
    repeats = top.header_rows if below.grid[: top.header_rows] == top.grid[: top.header_rows] else 0
    inner = [m[1] if (m := INNER.match(t)) else t for t in (first, second)]
    return f"<table>{inner[0]}{''.join(ROW.findall(inner[1])[repeats:])}</table>"


TABLE_TYPE = "struct<grid:array<array<string>>,origin:array<array<int>>,header_rows:int,n_cols:int,kv:boolean,columns:array<string>,unit:string,lines:array<string>,markdown:string>"


@lazy_udf(TABLE_TYPE)
def parse(html: pd.Series) -> pd.DataFrame:
    found = [Table(h) for h in html]
    return pd.DataFrame(
        [(t.grid, t.origin, t.header_rows, t.n_cols, t.kv, t.columns, t.unit, t.lines(), t.markdown()) for t in found],
        columns=["grid", "origin", "header_rows", "n_cols", "kv", "columns", "unit", "lines", "markdown"],
    )
