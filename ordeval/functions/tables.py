"""Table functions (survey D05, S14, S11): one document in, many cells out, used laterally over a table of documents."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text isn't content.
SILENT = ("script", "style", "sup")


class _Grid:
    """An open table: where its next cell goes, and the cells that rows above reach down to."""

    def __init__(self, number: int, depth: int) -> None:
        self.number, self.depth, self.row, self.column = number, depth, -1, 0
        self.taken: dict[int, int] = {}  # column: rows still covered from above
        self.cell: list | None = None

    def next_row(self) -> None:
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1} if self.row >= 0 else {}
        self.row, self.column = self.row + 1, 0

    def place(self, rows: int, columns: int) -> tuple[int, int]:
        if self.row < 0:
            self.next_row()
        while self.column in self.taken:
            self.column += 1
        at = self.column
        for c in range(at, at + columns):
            self.taken[c] = rows
        self.column += columns
        return self.row, at


class _Cells(HTMLParser):
    """Cells of all tables of a page, with a stack of open tables; end tags that HTML lets out are implied."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Grid] = []
        self.tables, self.silent = 0, 0
        self.found: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "table":
            self.open.append(_Grid(self.tables, len(self.open)))
            self.tables += 1
        elif self.open and tag in ("tr", "td", "th"):
            self.close_cell()
            grid = self.open[-1]
            if tag == "tr":
                grid.next_row()
                return
            given = dict(attrs)
            span = lambda name, most: max(1, min(most, int(m[0]))) if (m := re.match(r"\s*\d+", given.get(name) or "")) else 1
            rows, columns = span("rowspan", 65534), span("colspan", 1000)
            row, column = grid.place(rows, columns)
            grid.cell = [row, column, rows, columns, tag == "th", []]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.open and tag in ("td", "th", "tr"):
            self.close_cell()
        elif self.open and tag == "table":
            self.close_cell()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and not self.silent and self.open[-1].cell:
            self.open[-1].cell[5].append(data)

    def close_cell(self) -> None:
        grid = self.open[-1]
        if grid.cell:
            *facts, text = grid.cell
            self.found.append((grid.number, grid.depth, *facts, " ".join(" ".join(text).split())))
            grid.cell = None

    def finish(self) -> list[tuple]:
        self.close()
        while self.open:
            self.close_cell()
            self.open.pop()
        return sorted(self.found)


@F.udtf(returnType="table int, depth int, row int, cell int, row_span int, cell_span int, header boolean, text string")
class HtmlTableCells:
    """The cells of a page's tables, in order: the number of the table, how deep it is nested, the cell's place in the
    grid with spans counted, and its text without that of tables inside it. Null and empty pages have none."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html:
            parser = _Cells()
            parser.feed(html)
            yield from parser.finish()


def html_table_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` and those of :class:`HtmlTableCells`, one row for each cell."""
    return pages.lateralJoin(HtmlTableCells(F.col(html).outer()))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic hints."""
    return "".join(t.text or "" for path in (f"{_MAIN}t", f"{_MAIN}r/{_MAIN}t") for t in element.findall(path))


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook_sheets(content: bytes, wanted: str | None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, values by column) of a workbook's sheets, each part streamed; only ``wanted`` if it is given."""
    with zipfile.ZipFile(BytesIO(content)) as book:
        names = set(book.namelist())
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                for _, e in ElementTree.iterparse(part):
                    if e.tag == f"{_MAIN}si":
                        shared.append(_text(e))
                        e.clear()
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            name, target = sheet.get("name"), targets[sheet.get(f"{_REL}id")]
            if wanted is not None and name != wanted:
                continue
            number = 0
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                for _, e in ElementTree.iterparse(part):
                    if e.tag != f"{_MAIN}row":
                        continue
                    number = int(e.get("r") or number + 1)
                    values: list[str | None] = []
                    for c in e.findall(f"{_MAIN}c"):
                        at = _column(c.get("r") or "") if c.get("r") else len(values)
                        values += [None] * (at + 1 - len(values))
                        kind, v = c.get("t"), c.find(f"{_MAIN}v")
                        if kind == "inlineStr":
                            values[at] = _text(c.find(f"{_MAIN}is")) if c.find(f"{_MAIN}is") is not None else None
                        elif v is not None and v.text is not None:
                            values[at] = shared[int(v.text)] if kind == "s" else v.text
                    yield name, number, values
                    e.clear()


@F.udtf(returnType="sheet string, row int, values array<string>, problem string")
class WorkbookRows:
    """The rows of a workbook's sheets below their header, as text, in the order of the columns asked for (``|`` between
    names; all columns of the header if empty). A workbook that can't be read has one row that says so."""

    def eval(self, content: bytes, sheet: str, columns: str) -> Iterator[tuple]:
        if content is None:
            return
        wanted, header = [c for c in (columns or "").split("|") if c], {}
        try:
            for name, number, values in workbook_sheets(bytes(content), sheet):
                if name not in header:
                    header[name] = [(v or "").strip() for v in values]
                    missing = [c for c in wanted if c not in header[name]]
                    if missing or len(set(header[name])) != len(header[name]):
                        yield name, number, None, f"missing columns {missing}" if missing else "repeated column names"
                        return
                    continue
                values += [None] * (len(header[name]) - len(values))
                at = [header[name].index(c) for c in wanted] if wanted else range(len(header[name]))
                yield name, number, [values[i] for i in at], None
        except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
            yield None, None, None, f"{type(e).__name__}: {e}"[:200]


def read_workbooks(files: DataFrame, sheet: str, columns: list[str], content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of one sheet of many workbooks: ``files`` is a scan of format ``binaryFile``, or any table with the
    bytes in ``content``; a file is read by one task, whatever file system Spark reads it from. Only the columns asked for
    are made; all are text."""
    keys = [c for c in files.columns if c != content]
    read = files.lateralJoin(WorkbookRows(F.col(content).outer(), F.lit(sheet), F.lit("|".join(columns))))
    named = [F.get("values", F.lit(i)).alias(c) for i, c in enumerate(columns)]
    return read.where("problem IS NULL").select(*keys, "row", *named), read.where("problem IS NOT NULL").select(*keys, "sheet", "row", "problem")


def workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """A workbook of small sheets with inline strings: numbers are numbers, None leaves a cell out."""
    from xml.sax.saxutils import escape, quoteattr

    def letters(i: int) -> str:
        return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    def cell(at: str, v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out, main = BytesIO(), _MAIN[1:-1]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        put = lambda name, text: book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8"?>{text}')
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        put("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')  # fmt: skip
        rel = lambda i, kind, target: f'<Relationship Id="r{i}" Type="{_REL[1:-1]}/{kind}" Target="{target}"/>'
        pack = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
        put("_rels/.rels", pack.format(rel(0, "officeDocument", "xl/workbook.xml")))
        put("xl/_rels/workbook.xml.rels", pack.format("".join(rel(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(len(sheets)))))
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{_REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        for i, rows in enumerate(sheets.values()):
            lines = "".join(f'<row r="{y}">{"".join(cell(f"{letters(x)}{y}", v) for x, v in enumerate(row))}</row>' for y, row in enumerate(rows, 1))
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()
