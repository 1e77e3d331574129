"""Workbooks (XLSX): rows of a sheet as text, by header; a workbook is read by one task, a large one as a stream."""

from __future__ import annotations

import functools
import io
import posixpath
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.operators.checks import ContractError, find_name
from gustline.sources import files

#: Names of the format (fixed values).
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Rows of a sheet, as the format bounds them (fixed value).
MOST_ROWS = 1_048_576
BATCH_ROWS = 4096
#: Bytes of XML up to which a sheet is parsed at once, which takes half as long as row by row and, with a tag for each 25 bytes, some 60 MB.
WHOLE_BYTES = 8_000_000
ROW, CELL, VALUE, INLINE, TEXT, RUN = (f"{{{MAIN}}}{tag}" for tag in ("row", "c", "v", "is", "t", "r"))


def _text(node: ET.Element) -> str:
    """A string's runs without the readings that stand over them."""
    if len(node) == 1 and node[0].tag == TEXT:
        return node[0].text or ""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == TEXT else part.findall(TEXT) if part.tag == RUN else []))


def _part(book: zipfile.ZipFile, sheet: str | None) -> str:
    """Where a workbook keeps a sheet: the named one, or the first."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = {s.get("name"): targets[s.get(f"{{{LINK}}}id")] for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")}
    if not sheets or sheet not in (None, *sheets):
        raise ContractError(f"no sheet {sheet} among {sorted(sheets)}")
    target = sheets[sheet] if sheet else next(iter(sheets.values()))
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


@functools.lru_cache(16_384)
def _column(letters: str) -> int:
    """A -> 0, AB -> 27."""
    place = 0
    for letter in letters:
        place = place * 26 + ord(letter) - 64
    return place - 1


def _row_nodes(source, size: int) -> Iterator[ET.Element]:
    if size <= WHOLE_BYTES:
        yield from ET.parse(source).iter(ROW)
        return
    for _, node in ET.iterparse(source):
        if node.tag == ROW:
            yield node
            node.clear()


def sheet_rows(stream, sheet: str | None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of rows that have a cell; numbers and dates are the text that the file holds, truth values 1 and 0, errors their code."""
    try:
        book = zipfile.ZipFile(stream)
    except zipfile.BadZipFile as bad:
        raise ContractError("not an XLSX workbook") from bad
    with book:
        part, shared = _part(book, sheet), []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as source:
                for _, node in ET.iterparse(source):
                    if node.tag == f"{{{MAIN}}}si":
                        shared.append(_text(node))
                        node.clear()
        with book.open(part) as source:
            number = 0
            for node in _row_nodes(source, book.getinfo(part).file_size):
                number = int(node.get("r") or number + 1)
                cells: list[str | None] = []
                for c in node:
                    if c.tag != CELL:
                        continue
                    kind, reference = c.get("t"), c.get("r")
                    if kind == "inlineStr":
                        inside = c.find(INLINE)
                        value = None if inside is None else _text(inside)
                    else:
                        value = c.findtext(VALUE)
                        if kind == "s" and value is not None:
                            value = shared[int(value)]
                    at = _column(reference.rstrip("0123456789")) if reference else len(cells)
                    if at == len(cells):
                        cells.append(value)
                    else:
                        cells += [None] * (at + 1 - len(cells))
                        cells[at] = value
                if any(x is not None for x in cells):
                    yield number, cells


def read_sheets(spark: SparkSession, path: str, columns: dict[str, list[str]], sheet: str | None = None, pattern: str = "*.xlsx") -> DataFrame:
    """(file, row, a text for each column) of the named sheet, or the first, of all workbooks.

    columns: the headers that each one may go by, whatever their case, marks on letters and outer space; the first row that has a cell holds them, in any order, which may differ between workbooks. Cells
    without a value are null, rows without a cell are left out. A workbook that is damaged, or lacks the sheet or a header, ends the job. A task holds a workbook's distinct strings
    and a few thousand rows, or all rows of a sheet of at most WHOLE_BYTES; the format bounds its rows. Spark packs workbooks into tasks as it packs files.
    """
    if clash := sorted({"file", "row"} & set(columns)):
        raise ContractError(f"names of the reader's own columns: {clash}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inside = files.located(path)
                with store.open_input_file(inside) as stream:
                    places, held = None, []
                    for number, cells in sheet_rows(stream, sheet):
                        if places is None:
                            names = [c or "" for c in cells]
                            places = [names.index(find_name(names, options)) for options in columns.values()]
                            continue
                        held.append((path, number, *(cells[p] if p < len(cells) else None for p in places)))
                        if len(held) == BATCH_ROWS:
                            yield table(held)
                            held = []
                    if places is None:
                        raise ContractError("a sheet without a header")
                    yield table(held)

    def table(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), *[pa.string()] * len(columns)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=["file", "row", *columns])

    return files.listed(spark, path, pattern).select("path").mapInArrow(rows, "file string, row int, " + ", ".join(f"`{c}` string" for c in columns))


def _letters(place: int) -> str:
    out = ""
    while place >= 0:
        out, place = chr(65 + place % 26) + out, place // 26 - 1
    return out


@functools.lru_cache(BATCH_ROWS)
def _inline(text: str) -> str:
    """What stands behind the reference of a cell of text."""
    space = "" if text == " ".join(text.split()) else ' xml:space="preserve"'
    return f' t="inlineStr"><is><t{space}>{escape(text)}</t></is></c>'


def encoded(rows: list[Sequence], sheet: str) -> bytes:
    """A workbook of one sheet; numbers are numbers, all else is text, None no cell."""
    if len(rows) > MOST_ROWS:
        raise ContractError(f"more than {MOST_ROWS} rows")
    quoted, out = escape(sheet, {'"': "&quot;"}), io.BytesIO()
    kinds = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:

        def put(name: str, text: str) -> None:
            book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8"?>{text}', zipfile.ZIP_DEFLATED)  # the same bytes whenever it is written

        defaults = "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in kinds.items())
        office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        put("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types">{defaults}<Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{office}.worksheet+xml"/></Types>')
        put("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINK}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets><sheet name="{quoted}" sheetId="1" r:id="r1"/></sheets></workbook>')

        def cell(x) -> str:
            return f"><v>{x!r}</v></c>" if isinstance(x, (int, float)) and not isinstance(x, bool) else _inline(str(x))

        columns = [f'<c r="{_letters(j)}' for j in range(max(map(len, rows), default=0))]
        lines = (f'<row r="{k}">{"".join([f'{c}{k}"{cell(x)}' for c, x in zip(columns, r) if x is not None])}</row>' for k, r in enumerate(rows, 1))
        put("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def _values(column: pa.ChunkedArray) -> list:
    """A column's values as Python has them; texts, and numbers without nulls, by the faster way."""
    kind = column.type
    fast = pa.types.is_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind))
    return column.to_numpy().tolist() if fast else column.to_pylist()


def write_sheets(df: DataFrame, folder: str, name: str, headers: dict[str, str], order: list[str], sheet: str = "Sheet1") -> DataFrame:
    """Writes a workbook for each value of ``name``, rows in the order, and gives (path, rows). headers: what each column is called. A workbook is one group, of at most as many rows as the format allows."""

    def write(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        columns = [_values(c) for c in group.sort_by([(c, "ascending") for c in order]).select(list(headers)).columns]
        path = f"{folder}/{key[0].as_py()}.xlsx"
        files.publish(path, encoded([list(headers.values()), *zip(*columns)], sheet))
        return pa.table({"path": [path], "rows": pa.array([len(group)], "int64")})

    return df.select(*dict.fromkeys([name, *headers, *order])).groupBy(F.col(name)).applyInArrow(write, "path string, rows long")
