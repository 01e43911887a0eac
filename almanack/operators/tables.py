"""Rows of dated events out of HTML tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain, groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from almanack.functions.dates import parse_years_text
from almanack.functions.when import cell_date_text


class _Tables(HTMLParser):
    """Tables as lists of rows of [parts, rowspan, colspan, header, bold]; a nested table's cells are its own, footnotes are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done, self.open, self.notes = [], [], 0

    def updatepos(self, i, j):
        return j  # nobody asks for lines and columns of the source

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("sup", "style", "script"):
            self.notes += 1
        elif tag == "table":
            self.open.append([])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            span = lambda k: max(1, min(1000, int(attrs[k]))) if str(attrs.get(k, "")).isdigit() else 1
            self.open[-1][-1].append([[], span("rowspan"), span("colspan"), tag == "th", False])
        elif tag in ("b", "strong") and self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1][4] = True

    def handle_endtag(self, tag):
        if tag in ("sup", "style", "script"):
            self.notes = max(0, self.notes - 1)
        elif tag == "table" and self.open:
            self.done.append(self.open.pop())

    def handle_data(self, data):
        if not self.notes and self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1][0].append(data)


class _Lines:
    """Rows of a table, in order, as lines of (text, header, bold); a cell that spans rows or columns fills each place."""

    def __init__(self):
        self.held: dict[int, tuple[tuple, int]] = {}

    def line(self, row: list) -> list[tuple[str, bool, bool]]:
        held, line = self.held, []

        def carry():
            while len(line) in held:
                cell, left = held[len(line)]
                if left > 1:
                    held[len(line)] = (cell, left - 1)
                else:
                    del held[len(line)]
                line.append(cell)

        carry()
        for parts, down, across, header, bold in row:
            cell = (" ".join(unescape("".join(parts)).split()), header, bold)
            for _ in range(across):
                if down > 1:
                    held[len(line)] = (cell, down)
                    carry()
                else:
                    line.append(cell)
            carry()
        return line


def marked_grids(html: str) -> list[list[list[tuple[str, bool, bool]]]]:
    """Every table as a grid of _Lines."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [[lines.line(row) for row in table] for table in parser.done + parser.open[::-1] for lines in [_Lines()]]


class _Streamed(_Tables):
    """_Tables that hands over the rows of a table as soon as they are whole: (opened, row, None) with the table's number by opening; one that closes
    gives (opened, None, its number by closing), which is that of marked_grids."""

    def __init__(self):
        super().__init__()
        self.ready, self.numbers, self.n, self.closed = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if tag == "table":
            self.numbers.append(self.n)
            self.n += 1
        elif tag == "tr" and self.open and len(self.open[-1]) > 1:
            self.ready.append((self.numbers[-1], self.open[-1].pop(-2), None))

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            opened = self.numbers.pop()
            self.ready += [(opened, row, None) for row in self.open.pop()]
            self.ready.append((opened, None, self.closed))
            self.closed += 1
        else:
            super().handle_endtag(tag)

    def close(self):
        super().close()
        while self.open:
            self.handle_endtag("table")


def _pieces(parts: Iterable[str | None], least: int = 1 << 16) -> Iterator[str]:
    """The text of parts put together, in pieces that end before a tag; of parts no more than a piece is held at once."""
    held, size, need = [], 0, least
    for part in parts:
        held.append(part or "")
        size += len(held[-1])
        if size < need:
            continue
        text, at = "".join(held), 0
        while (to := text.find("<", at + least)) > 0:
            yield text[at:to]
            at = to
        held, size = [text[at:]], len(text) - at
        need = max(least, 2 * size)  # a long text without a tag isn't put together again for each part
    yield "".join(held)


def streamed_lines(parts: Iterable[str | None]) -> Iterator[tuple]:
    """(table, row, line) of the lines of the tables of a page that comes in parts, without ever holding a whole table; tables are numbered as they
    open. One that closes gives (table, None, its number among those of marked_grids)."""
    parser, lines = _Streamed(), {}
    for piece in chain(_pieces(parts), [None]):
        if piece is None:
            parser.close()
        else:
            parser.feed(piece)
        for opened, row, place in parser.ready:
            if row is None:
                lines.pop(opened, None)
                yield opened, None, place
            else:
                state = lines.setdefault(opened, [_Lines(), 0])
                yield opened, state[1], state[0].line(row)
                state[1] += 1
        parser.ready.clear()


def marked_lines(html: str) -> Iterator[tuple]:
    """(table, row, line) of the lines of marked_grids, of each table in order; the page is read once for the numbers of its tables and once for lines."""
    place = {t: n for t, i, n in streamed_lines([html]) if i is None}
    return ((place[t], i, line) for t, i, line in streamed_lines([html]) if i is not None)


def grids(html: str) -> list[list[list[str]]]:
    """The texts of marked_grids."""
    return [[[cell[0] for cell in row] for row in grid] for grid in marked_grids(html)]


def table_events(html: str, limit: int = 500) -> list[tuple[int, int, str]]:
    """(start, end, text) of table rows: the column that reads as dates most, and the wordiest other."""
    events = []
    for grid in grids(html):
        width = max(map(len, grid), default=0)
        column = lambda j: [r[j] for r in grid if len(r) > j]
        dated = [sum(bool(parse_years_text(c)) and len(c) < 40 for c in column(j)) for j in range(width)]
        if width < 2 or max(dated) * 2 < len(grid):
            continue
        when = dated.index(max(dated))
        words = [-1 if j == when else sum(len(c.split()) for c in column(j)) for j in range(width)]
        what = words.index(max(words))
        for r in grid:
            if len(r) > max(when, what) and (span := cell_date_text(r[when])) and r[what]:
                events.append((*span, r[what]))
    return events[:limit]


def mine_tables(pages: DataFrame) -> DataFrame:
    """(page_id, start, end, text) of the events in the tables of pages (page_id, html)."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *e) for p, h in zip(pdf["page_id"], pdf["html"]) for e in table_events(h, 1 << 30)]
            yield pd.DataFrame(rows, columns=["page_id", "start", "end", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInPandas(run, f"page_id {kind}, start long, end long, text string")


def table_rows(pages: DataFrame) -> DataFrame:
    """(page, table, row, cells, head, n, place) of the tables with a header row of pages (page, html): cells are structs (text, bold).

    A page may come in parts, rows with a column `part` that says their order; the rows of a page have to be in one partition, and are sorted there. The
    header is the first row of two cells or more that are all header cells but one at most. Rows are handed on as they are read, so a task holds a
    part of a page and a few thousand rows. Rows after the header have no head, n and place; a table with such rows has one more, without row and
    cells: the header's texts, how many rows come after it, and the table's place among all that close on the page.
    """
    parted = "part" in pages.columns
    cells = pa.struct([("text", pa.string()), ("bold", pa.bool_())])

    def run(batches):
        kinds = []

        def pairs():
            for batch in batches:
                kinds[:] = [batch.schema.field("page").type]
                yield from ((p.as_py(), h.as_py()) for p, h in zip(batch.column("page"), batch.column("html")))

        def read():
            for page, html in groupby(pairs(), itemgetter(0)) if parted else ((p, [(p, h)]) for p, h in pairs()):
                heads, last = {}, {}
                for t, i, r in streamed_lines(h for _, h in html):
                    if i is None:
                        if t in last:
                            yield page, t, None, None, (heads[t][1], last[t] - heads[t][0], r)
                        heads.pop(t, None)
                        last.pop(t, None)
                    elif t in heads:
                        last[t] = i
                        yield page, t, i - heads[t][0] - 1, r, (None, None, None)
                    elif len(r) > 1 and sum(c[1] for c in r) >= len(r) - 1:
                        heads[t] = i, [c[0] for c in r]

        rows = read()
        while block := list(islice(rows, 5_000)):
            page, table, row, line, told = zip(*block)
            head, n, place = zip(*told)
            ends = list(accumulate((len(r or ()) for r in line), initial=0))
            said = [c for r in line for c in r or ()]
            flat = pa.StructArray.from_arrays([pa.array([c[0] for c in said], pa.string()), pa.array([c[2] for c in said], pa.bool_())], fields=list(cells))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([r is None for r in line]))
            ints = [pa.array(c, pa.int32()) for c in (table, row, n, place)]
            yield pa.RecordBatch.from_arrays([pa.array(page, kinds[0]), *ints[:2], lists, pa.array(head, pa.list_(pa.string())), *ints[2:]], ["page", "table", "row", "cells", "head", "n", "place"])

    kind = dict(pages.dtypes)["page"]
    if parted:
        pages = pages.sortWithinPartitions("page", "part", "html")
    return pages.select("page", "html").mapInArrow(run, f"page {kind}, table int, row int, cells array<struct<text: string, bold: boolean>>, head array<string>, n int, place int")
