"""HTML tables as grids: every cell in its row and column, spans laid out, and checks of a table that is read by its headers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datelore.functions.text import broken_rules

#: The largest spans that HTML knows; a span of 0 rows reaches to the end of its row group.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
_GROUPS = ("thead", "tbody", "tfoot")
_UNSEEN = ("script", "style", "template")


class _Tables(HTMLParser):
    """The tables of a page in the order in which they begin, as row groups of rows of cells [texts, is header, rows, columns]. End tags may be left out.

    The text of an inner table is part of the outer cell's too, as it is where a browser reads a cell out.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list] = []
        self.open: list[dict] = []  # of each open table its groups, and whether a row and a cell of it are open
        self.unseen = 0

    def handle_starttag(self, tag, attrs):
        if tag in _UNSEEN:
            self.unseen += 1
        elif tag == "table":
            groups: list = [[]]
            self.tables.append(groups)
            self.open.append({"groups": groups, "row": None, "cell": None})
        elif not self.open:
            return
        elif tag in _GROUPS:
            self._end_row()
            if self.open[-1]["groups"][-1]:
                self.open[-1]["groups"].append([])
        elif tag == "tr":
            self._end_row()
            self._begin_row()
        elif tag in ("td", "th"):
            now = self.open[-1]
            if now["row"] is None:
                self._begin_row()
            told = dict(attrs)
            now["cell"] = [[], tag == "th", _span(told.get("rowspan"), 0, MOST_ROWS), _span(told.get("colspan"), 1, MOST_COLUMNS)]
            now["row"].append(now["cell"])
        else:
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in _UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif not self.open:
            return
        elif tag == "table":
            self.open.pop()
        elif tag == "tr":
            self._end_row()
        elif tag in ("td", "th"):
            self.open[-1]["cell"] = None
        elif tag in _GROUPS:
            self._end_row()
            if self.open[-1]["groups"][-1]:
                self.open[-1]["groups"].append([])
        else:
            self.handle_data(" ")

    def handle_data(self, data):
        if not self.unseen:
            for table in self.open:
                if table["cell"] is not None:
                    table["cell"][0].append(data)

    def _begin_row(self):
        self.open[-1]["row"] = []
        self.open[-1]["groups"][-1].append(self.open[-1]["row"])

    def _end_row(self):
        self.open[-1]["row"] = self.open[-1]["cell"] = None


def _span(told: str | None, least: int, most: int) -> int:
    """A span as HTML reads it: 1 where it is no number or too small."""
    digits = (told or "").strip()
    n = int(digits[:9]) if digits.isascii() and digits.isdigit() else 1
    return 1 if n < least else min(n, most)


def laid_out(groups: list[list[list]]) -> list[tuple[int, int, str, bool, bool]]:
    """(row, column, text, is_header, is_first) of a table: a cell stands at each place that it spans, and is first at one of them.

    A cell goes to the next free column of its row; spans end with their row group. Where cells overlap, as only broken spans make them, each keeps its places.
    """
    out, at = [], 0
    for rows in groups:
        taken: dict[int, set[int]] = {}
        for k, row in enumerate(rows):
            column, mine = 0, taken.pop(k, set())
            for texts, is_header, down, across in row:
                while column in mine:
                    column += 1
                down = len(rows) - k if down == 0 else min(down, len(rows) - k)
                text = " ".join("".join(texts).split())
                for r in range(down):
                    for c in range(across):
                        out.append((at + k + r, column + c, text, is_header, r == c == 0))
                        if r:
                            taken.setdefault(k + r, set()).add(column + c)
                column += across
        at += len(rows)
    return out


def html_grids(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, column, text, is_header, is_first): the cells of all tables of each page, numbered from 0. A null page, or one without tables, has none.

    Inner tables are tables of their own. Pages are read one at a time where they lie.
    """
    names = [key, "table", "row", "column", "text", "is_header", "is_first"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for k in range(batch.num_rows):
                reader = _Tables()
                reader.feed(batch.column(1)[k].as_py() or "")
                reader.close()
                cells = [(t, *c) for t, groups in enumerate(reader.tables) for c in laid_out(groups)]
                if cells:
                    same = pa.array([batch.column(0)[k].as_py()] * len(cells), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([same, *[pa.array(c, t) for c, t in zip(zip(*cells, strict=True), kinds, strict=True)]], names)

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(read, f"`{key}` {kind}, table int, row int, column int, text string, is_header boolean, is_first boolean")


def read_records(cells: DataFrame, keys: list[str], required: dict[str, str], identifier: str, pattern: str = ".+") -> tuple[DataFrame, DataFrame]:
    """(records, issues) of tables (keys, row, column, text): records are (keys, row, each of required by its name: header), one for each row but the first.

    issues has the rules that a table breaks: missing_header (a required one), repeated_header, ragged_rows (another number of columns than the headers),
    missing_value (of a required column), wrong_identifier (its value does not match the pattern), repeated_identifier, no_rows. Only tables without issues give records.
    A table is cells in one group of bounded width; rows and identifiers are counted in shuffles.
    """
    headers = cells.where("row = 0").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("_by_column"), F.collect_list("text").alias("_names"))
    body = cells.where("row > 0").groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("_cells"))
    place = lambda header: F.get(F.filter(F.map_keys("_by_column"), lambda c: F.col("_by_column")[c] == header), F.lit(0))
    both = headers.join(body, keys, "left")
    value = lambda header: F.nullif(F.try_element_at("_cells", place(header)), F.lit(""))
    told = both.select(*keys, "row", "_names", F.size("_by_column").alias("_width"), F.size("_cells").alias("_own"), *[value(h).alias(name) for name, h in required.items()])
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys, identifier))
    marked = told.withColumn("_times", F.when(F.col(identifier).isNotNull(), count).otherwise(1))
    some = lambda c: ~F.coalesce(F.bool_or(F.col("row").isNotNull() & c), F.lit(False))
    names = F.first("_names")
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    rules = {
        "missing_header": F.size(F.array_except(F.array(*map(F.lit, required.values())), names)) == 0, "repeated_header": F.size(F.array_distinct(names)) == F.size(names),
        "ragged_rows": some(F.col("_own") != F.col("_width")), "missing_value": some(missing), "wrong_identifier": some(~F.col(identifier).rlike(f"^(?:{pattern})$")),
        "repeated_identifier": some(F.col("_times") > 1), "no_rows": F.count("row") > 0,
    }
    issues = marked.groupBy(*keys).agg(broken_rules(rules).alias("issues"))
    records = told.join(issues.where(F.size("issues") == 0), keys, "left_semi").where("row is not null").select(*keys, "row", *required)
    return records, issues
