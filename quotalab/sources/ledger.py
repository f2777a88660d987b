"""The order ledger from CSV, from an HTML table, and its sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .snapshots import write_text

COLUMNS = ["unidade", "data_solic", "produto", "categoria", "qtd_solic", "qtd_env", "qtd_rec", "status", "pedido_extra", "mes_ref"]
#: What the CSV reader takes for a missing value.
MISSING = ("", "NA", "N/A", "NaN", "null", "NULL", "None")


class _Tables(HTMLParser):
    """The cells of every table; a table inside another counts as one of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = []
            self.open[-1][-1].append("")

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.open[-1][-1][-1] = "".join(self.cell).strip()
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()


def html_rows(text: str) -> list[list[str]]:
    """The rows after the header of the one table that a file must have."""
    parser = _Tables()
    parser.feed(text)
    if len(parser.tables) != 1:
        raise ValueError(f"one table expected, found {len(parser.tables)}")
    return [row for row in parser.tables[0] if row][1:]


#: Cells whose text is not yet what they say.
_SPELT = re.compile(r"&|<td>\s|\s</td>")


class HtmlRows:
    """The rows after the header of the one table of a text that comes in pieces, each with so many cells.

    A row that is nothing but <tr>, cells of text and </tr> is split at its tags wherever the parser stands between two
    rows of the table; everything else goes through the parser.
    """

    def __init__(self, width: int) -> None:
        self.width, self.parser, self.text, self.header = width, _Tables(), "", False

    def feed(self, text: str, last: bool = False) -> list:
        """The rows that are complete by now."""
        text, at, found, parser = self.text + text, 0, [], self.parser
        while at < len(text):
            if self._between():
                start, (plain, at) = at, self._plain(text, at)
                if plain:
                    self._drain(found, whole=True)
                    if _SPELT.search(text, start, at):
                        plain = [[unescape(c).strip() for c in row] for row in plain]
                    parser.open[-1].append(plain.pop())  # cells may still follow it
                    found += plain if self.header else plain[1:]
                    self.header |= bool(plain)
                end = text.find("<tr>", at + 1)
            else:
                end = text.rfind("<tr>", at + 1) if parser.rawdata else text.find("<tr>", at + 1)
            if end < 0 and not last and len(text) - at < 1 << 20:
                break  # the rest of a row comes with the next piece
            end = len(text) if end < 0 else end
            parser.feed(text[at:end])
            at = end
        self.text = text[at:]
        self._drain(found, whole=last)
        if last and len(parser.tables) != 1 or len(parser.tables) > 1:
            raise ValueError(f"one table expected, found {len(parser.tables)}")
        return found

    def _plain(self, text: str, at: int) -> tuple[list[list[str]], int]:
        """The plain rows that follow each other from a place on, and the place after them."""
        plain = []
        while text.startswith("<tr><td>", at) and (end := text.find("</td></tr>", at)) > 0:
            row = text[at + 8 : end]
            cells = row.split("</td><td>")
            if len(cells) != self.width or row.count("<") != 2 * self.width - 2:
                break
            plain.append(cells)
            at = end + 10
            while text[at : at + 1].isspace():
                at += 1
        return plain, at

    def _between(self) -> bool:
        parser = self.parser
        return not parser.rawdata and parser.cdata_elem is None and len(parser.tables) == len(parser.open) == 1 and parser.cell is None

    def _drain(self, found: list, whole: bool) -> None:
        """Take the rows from the parser, but for the last one if cells may still follow."""
        if not self.parser.tables:
            return
        rows = self.parser.tables[0]
        done = rows[:] if whole else rows[:-1]
        del rows[: len(done)]
        for row in filter(None, done):
            if self.header:
                if len(row) != self.width:
                    raise ValueError(f"{self.width} columns expected, found {len(row)}")
                found.append(row)
            self.header = True


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings; a file is parsed by one task, files side by side."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                rows = html_rows(text)
                wrong = [r for r in rows if len(r) != len(COLUMNS)]
                if wrong:
                    raise ValueError(f"{len(COLUMNS)} columns expected, found {len(wrong[0])}")
                yield pd.DataFrame([[None if c in MISSING else c for c in r] for r in rows], columns=COLUMNS, dtype=object)

    return spark.read.text(path, wholetext=True).mapInPandas(parse, ", ".join(f"{c} string" for c in COLUMNS))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by position."""
    found = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if len(found.columns) != len(COLUMNS):
        raise ValueError(f"{len(COLUMNS)} columns expected, found {len(found.columns)}")
    return found.toDF(*COLUMNS).replace(list(MISSING[1:]), None)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A .csv file by its header; any other file as an HTML table."""
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_html(spark, path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in the folder path, written by all tasks: of a sorted table the parts follow each other."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    """A small record of the driver."""
    write_text(spark, path, json.dumps(record, ensure_ascii=False, indent=2))
