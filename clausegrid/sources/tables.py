"""Tables in HTML pages and DOCX files: cells on a grid, headers told from rows, and links to the clauses that speak of them.

A page's markup is read inside tasks, cell by cell; all that comes after, from naming columns to linking, is
joins and aggregations over the cells.
"""

from __future__ import annotations

import html.parser
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.sources.files import WORD

CELL = "table_no int, row_no int, col_no int, text string, is_header boolean, is_copy boolean"
#: A span over more columns or rows than this is read as so many, as browsers do for columns.
MOST_SPAN = 1000


class Grid:
    """Places cells one after the other: each takes the next free place of its row, and those below and beside it that it spans."""

    def __init__(self) -> None:
        self.taken: dict[int, set[int]] = {}
        self.cells: list[tuple[int, int, str, bool, bool]] = []
        self.row = -1

    def next_row(self) -> None:
        self.row += 1
        self.col = 0

    def put(self, text: str, header: bool, cols: int, rows: int) -> None:
        held = self.taken.setdefault(self.row, set())
        while self.col in held:
            self.col += 1
        for r in range(self.row, self.row + min(max(rows, 1), MOST_SPAN)):
            for c in range(self.col, self.col + min(max(cols, 1), MOST_SPAN)):
                if c not in self.taken.setdefault(r, set()):
                    self.taken[r].add(c)
                    self.cells.append((r, c, text, header, (r, c) != (self.row, self.col)))
        self.col += max(cols, 1)

    def done(self) -> list[tuple[int, int, str, bool, bool]]:
        """The cells of rows that are there: spans end with the table."""
        return sorted(c for c in self.cells if c[0] <= self.row)


class _Tables(html.parser.HTMLParser):
    """The grids of all tables of a page, in order of their beginning; a table inside a cell is one of its own, and no text of the cell."""

    def __init__(self) -> None:
        super().__init__()
        self.grids: list[Grid] = []
        self.open: list[dict] = []  # tables that have begun, outermost first

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.grids.append(Grid())
            self.open.append({"grid": self.grids[-1], "cell": None})
        elif not self.open:
            return
        elif tag == "tr":
            self._close_cell()
            self.open[-1]["grid"].next_row()
        elif tag in ("td", "th"):
            self._close_cell()
            if self.open[-1]["grid"].row < 0:
                self.open[-1]["grid"].next_row()
            named = dict(attrs)
            self.open[-1]["cell"] = (tag == "th", *[int(v) if (v := named.get(n) or "1").strip().isdigit() else 1 for n in ("colspan", "rowspan")], [])
        elif tag in ("br", "p", "div", "li") and self.open[-1]["cell"]:
            self.open[-1]["cell"][3].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close_cell()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][3].append(data)

    def _close_cell(self) -> None:
        if cell := self.open[-1]["cell"]:
            self.open[-1]["grid"].put(" ".join("".join(cell[3]).split()), *cell[:3])
            self.open[-1]["cell"] = None


def html_grids(text: str) -> list[Grid]:
    page = _Tables()
    page.feed(text)
    page.close()
    while page.open:
        page.handle_endtag("table")
    return page.grids


def docx_grids(data: bytes) -> list[Grid]:
    """The grids of the tables of a DOCX file: gridSpan goes over columns, vMerge down; header rows are those marked tblHeader."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    grids = []
    for table in body.iter(f"{WORD}tbl"):
        grid, above = Grid(), {}
        for row in table.findall(f"{WORD}tr"):
            grid.next_row()
            header = row.find(f"{WORD}trPr/{WORD}tblHeader") is not None
            at = 0
            for cell in row.findall(f"{WORD}tc"):
                span, merge = cell.find(f"{WORD}tcPr/{WORD}gridSpan"), cell.find(f"{WORD}tcPr/{WORD}vMerge")
                cols = int(span.get(f"{WORD}val", "1")) if span is not None else 1
                text = " ".join("".join(t.text or "" for t in cell.iter(f"{WORD}t")).split())
                goes_on = merge is not None and merge.get(f"{WORD}val", "continue") != "restart" and at in above
                text = above[at] if goes_on else text
                grid.put(text, header, cols, 1)
                if goes_on:
                    grid.cells[-cols] = (*grid.cells[-cols][:4], True)
                above[at] = text
                at += cols
        grids.append(grid)
    return grids


def table_cells(rows: DataFrame, keys: list[str], content: str, read: Callable[[str | bytes], list[Grid]] = html_grids) -> DataFrame:
    """The keys, table_no, row_no, col_no, text, is_header, is_copy of all cells; a cell that spans places is in each of them, all but the first as copies.

    `read` gives the grids of one content, html_grids for pages, docx_grids for files. What cannot be read has no
    tables, and neither has null.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    taken = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(content).alias("_content")).filter("_content IS NOT NULL")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    grids = read(row[-1])
                except Exception:
                    grids = []
                out += [(*row[:-1], t, *c) for t, grid in enumerate(grids) for c in grid.done()]
            yield pd.DataFrame(out, columns=[*names, *[c.split()[0] for c in CELL.split(", ")]]).astype({n: batch[n].dtype for n in names} if out else {})

    kinds = ", ".join(f"{n} {taken.schema[n].dataType.simpleString()}" for n in names)
    return taken.mapInPandas(cells, f"{kinds}, {CELL}").withColumnsRenamed(dict(zip(names, keys, strict=True)))


def with_headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of rows (not of headers), each with `header`, its column's name.

    The leading rows of nothing but header cells are headers; where there are none, the first row is. Several header rows are
    joined by blanks, each text once. A column without a name is called Column and its number from 1; of columns of one
    name all but the first get theirs with _2, _3 and so on.
    """
    table = [*keys, "table_no"]
    rows = cells.groupBy(*table, "row_no").agg(F.bool_and("is_header").alias("_all"))
    body = rows.groupBy(*table).agg(F.min(F.when(~F.col("_all"), F.col("row_no"))).alias("_first"), F.min("row_no").alias("_top"), F.max("row_no").alias("_last"))
    begin = F.when(F.col("_first") > F.col("_top"), F.col("_first")).when(F.col("_first").isNull(), F.col("_last") + 1).otherwise(F.col("_top") + 1)
    body = body.select(*table, begin.alias("_begin"))
    placed = cells.join(body, table)
    names = placed.filter("row_no < _begin").groupBy(*table, "col_no").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"])).alias("_texts"))
    columns = placed.select(*table, "col_no").distinct().join(names, [*table, "col_no"], "left")
    said = F.array_join(F.filter(F.coalesce("_texts", F.array().cast("array<string>")), lambda t: t != ""), " ")
    columns = columns.withColumn("_name", F.when(said == "", F.concat(F.lit("Column"), F.col("col_no") + 1)).otherwise(said))
    nth = F.row_number().over(Window.partitionBy(*table, "_name").orderBy("col_no"))
    columns = columns.withColumn("header", F.when(nth > 1, F.concat("_name", F.lit("_"), nth)).otherwise(F.col("_name"))).select(*table, "col_no", "header")
    return placed.filter("row_no >= _begin").drop("_begin").join(columns, [*table, "col_no"])


def tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A row per table: keys, table_no, headers, rows (array of maps), row_count, column_count, formatted_text, json_data.

    formatted_text has a line per row, `Header: value; Header: value`; json_data is the rows as JSON. Cells that copy a
    spanning one say what it says. A table without rows below its headers has none, and is left out.
    """
    table, named = [*keys, "table_no"], with_headers(cells, keys)
    rows = named.groupBy(*table, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "header", "text"))).alias("_cells"))
    entry = F.transform("_cells", lambda c: F.struct(c["header"].alias("key"), c["text"].alias("value")))
    line = F.array_join(F.transform("_cells", lambda c: F.concat(c["header"], F.lit(": "), c["text"])), "; ")
    rows = rows.select(*table, F.struct("row_no", F.map_from_entries(entry).alias("cells"), line.alias("line")).alias("_row"))
    made = rows.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("_row.row_no", "_row.line"))).alias("_lines"), F.collect_list("_row").alias("_rows"))
    sorted_rows = F.transform(F.array_sort("_rows", lambda a, b: a["row_no"] - b["row_no"]), lambda r: r["cells"])
    headers = named.select(*table, "col_no", "header").distinct().groupBy(*table).agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "header"))), lambda h: h["header"]).alias("headers"))
    out = made.join(headers, table).withColumn("rows", sorted_rows)
    return out.select(*table, "headers", "rows", F.size("rows").alias("row_count"), F.size("headers").alias("column_count"), F.array_join("_lines.line", "\n").alias("formatted_text"), F.to_json("rows").alias("json_data"))


def linked(found: DataFrame, clauses: DataFrame, keys: list[str], pos: str = "pos", text: str = "content", least: float = 0.5, min_chars: int = 3) -> DataFrame:
    """(keys, table_no, pos, n_matched, share): the clauses that speak of a table, by the share of its headers that their text holds, whatever the case.

    Headers of fewer than `min_chars` characters, and those that only count columns, tell nothing and are not asked
    for. Tables meet the clauses of their own document alone.
    """
    asked = found.select(*keys, "table_no", F.explode("headers").alias("_h")).filter((F.length("_h") >= min_chars) & ~F.col("_h").rlike("^Column[0-9]+$")).distinct()
    total = asked.groupBy(*keys, "table_no").agg(F.count(F.lit(1)).alias("_n"))
    hits = asked.join(clauses.select(*keys, pos, F.lower(text).alias("_t")), keys).filter(F.contains("_t", F.lower("_h")))
    hits = hits.groupBy(*keys, "table_no", pos).agg(F.count(F.lit(1)).alias("n_matched")).join(total, [*keys, "table_no"])
    share: Column = F.col("n_matched") / F.col("_n")
    return hits.withColumn("share", share).filter(F.col("share") >= least).drop("_n")
