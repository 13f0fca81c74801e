"""Workbooks (.xlsx) as frames of text cells, and frames as workbooks.

A workbook is a zip of XML. One task for each book inflates the first sheet as a stream and cuts it at row ends into blocks
of about BLOCK bytes; a block carries the shared strings that it names. Blocks are dealt to all tasks and parsed there, which is
where the time goes, so one book of a million rows and a folder of many small ones are both read in parallel. Nothing but
headers comes to the driver. Files are read by Spark, so any store will do.

Cells become texts as an export would have them: whole numbers without a point, whole numbers under a format of zeros alone (00000)
padded to its width, so 101 is 00101 again; numbers under a date format as dates; errors and empty cells as null.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fields import QueryError
from .files import MOST_BYTES, MOST_COLUMNS, within_limit

#: Bytes of XML of a block; how much larger than the file a book's parts may be, against bombs.
BLOCK, MOST_GROWTH = 1 << 20, 200
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Numbers of the built-in formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ROW = re.compile(rb"<(?:\w+:)?row[\s>/]")
_END = re.compile(rb"</(?:\w+:)?sheetData>")
_STRING = re.compile(rb"""<(?:\w+:)?c\b[^>]*\bt=["']s["'][^>]*>\s*<(?:\w+:)?v>(\d+)</""")
BLOCKS = "path string, block long, head binary, rows binary, strings map<int,string>, pads map<int,int>, dates array<int>, from_1904 boolean"
CELLS = "path string, row long, cells array<string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    """The text of a string item, without phonetic runs."""
    return "".join(t.text or "" for part in node for t in ([part] if _local(part.tag) == "t" else part if _local(part.tag) == "r" else []) if _local(t.tag) == "t")


def _strings(book: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if _local(node.tag) == "si":
                    out.append(_texts(node))
                    node.clear()
    return out


def _styles(book: zipfile.ZipFile) -> tuple[dict[int, int], list[int]]:
    """Of the cell styles: width by style of formats of zeros alone, and the styles that show dates. A broken table has neither."""
    try:
        root = ElementTree.fromstring(book.read("xl/styles.xml"))
    except (KeyError, ElementTree.ParseError):
        return {}, []
    codes = {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in root.iter() if _local(n.tag) == "numFmt"}
    pads, dates = {}, []
    styles = next((n for n in root if _local(n.tag) == "cellXfs"), [])
    for i, style in enumerate(styles):
        number = int(style.get("numFmtId", 0))
        code = codes.get(number, "").split(";")[0].strip()
        if re.fullmatch("0{2,}", code):
            pads[i] = len(code)
        elif number in DATE_FORMATS or number in codes and re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())):
            dates.append(i)
    return pads, dates


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The path of the first sheet in the book's own order, and whether days count from 1904."""
    if "xl/workbook.xml" not in book.namelist():
        return min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), False
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    from_1904 = any(_local(n.tag) == "workbookPr" and n.get("date1904") in ("1", "true") for n in root.iter())
    first = next(n.get(_REL) for n in root.iter() if _local(n.tag) == "sheet")
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == first:
            target = r.get("Target", "")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}", from_1904
    raise ValueError("no sheet")


def blocks_of(content: bytes, block: int = BLOCK) -> Iterator[dict]:
    """The blocks of a book's first sheet. Only a block of the sheet is in memory at a time, beside the book and its shared strings."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        if sum(i.file_size for i in book.infolist()) > MOST_GROWTH * max(len(content), 1 << 16):
            raise QueryError("the workbook is too large inside")
        sheet, from_1904 = _first_sheet(book)
        strings, (pads, dates) = _strings(book), _styles(book)
        head, held, k, ended = None, b"", 0, False
        with book.open(sheet) as f:
            while not ended:
                more = f.read(block)
                held += more
                if head is None:
                    if not (m := _ROW.search(held)):
                        if not more:
                            return
                        continue
                    head, held = held[: m.start()], held[m.start() :]
                if m := _END.search(held):
                    held, ended = held[: m.start()], True
                elif not more:
                    raise QueryError("the sheet ends half-way")
                cut = len(held) if ended else max((m.start() for m in _ROW.finditer(held)), default=0)
                if cut:
                    rows, held = held[:cut], held[cut:]
                    named = {int(i) for i in _STRING.findall(rows)}
                    yield {"block": k, "head": head, "rows": rows, "strings": {i: strings[i] for i in named if i < len(strings)}, "pads": pads, "dates": dates, "from_1904": from_1904}
                    k += 1


def _column(name: str) -> int:
    at = 0
    for c in name:
        at = at * 26 + ord(c) - 64
    return at


def cell_text(kind: str | None, style: int, value: str | None, strings: dict, pads: dict, dates: set, from_1904: bool) -> str | None:
    """A cell's text from its type, style and stored value."""
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings.get(int(value))
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind not in (None, "n"):
        return value  # texts of formulas, ISO dates
    try:
        number = float(value)
    except ValueError:
        return value
    if style in dates and abs(number) < 2_958_466:
        day = number if from_1904 or number >= 60 else number + 1  # the 29 February 1900 that there wasn't
        at = (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(seconds=round(day * 86400, 3))
        return at.strftime("%H:%M:%S") if 0 <= number < 1 else at.isoformat(" ")
    if number == int(number) if abs(number) < 1e300 else False:
        return str(int(number)).zfill(pads.get(style, 0))
    return repr(number)


def rows_of(block: dict) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of a block; rows without a number count on from their block."""
    root = re.search(rb"<(?:\w+:)?worksheet\b[^>]*>", block["head"])
    prefix = re.match(rb"<(\w+:)?", root[0])[1] or b""
    whole = root[0] + block["rows"] + b"</" + prefix + b"worksheet>"
    strings, pads, dates = dict(block["strings"]), dict(block["pads"]), set(block["dates"])
    for k, r in enumerate(ElementTree.fromstring(whole), (block["block"] << 32) + 1):
        if _local(r.tag) != "row":
            continue
        cells: list[str | None] = []
        for c in r:
            if _local(c.tag) != "c":
                continue
            at = _column(m[0]) if (m := re.match("[A-Z]+", c.get("r", ""))) else len(cells) + 1
            kind = c.get("t")
            if kind == "inlineStr":
                text = next((_texts(x) for x in c if _local(x.tag) == "is"), None)
            else:
                stored = next((x.text for x in c if _local(x.tag) == "v"), None)
                text = cell_text(kind, int(c.get("s", 0)), stored, strings, pads, dates, block["from_1904"])
            if at <= MOST_COLUMNS + 1:  # one more shows that there are too many
                cells += [None] * (at - len(cells))
                cells[at - 1] = text if text != "" else None
        yield int(r.get("r") or k), cells


def blocks(books: DataFrame) -> DataFrame:
    """(path, content) -> BLOCKS: the stream of each book cut up, dealt to all tasks."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for b in blocks_of(bytes(content)):
                    yield pd.DataFrame([{"path": path, **b}])

    spark = books.sparkSession
    return books.select("path", "content").mapInPandas(cut, BLOCKS).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "block")


def cells(books: DataFrame) -> DataFrame:
    """(path, content) -> (path, row, cells): row numbers from 1, as the sheet has them."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.to_dict("records"):
                found = [(b["path"], n, c) for n, c in rows_of(b)]
                yield pd.DataFrame(found, columns=["path", "row", "cells"])

    return blocks(books).mapInPandas(parse, CELLS)


def named(header: list[str | None]) -> list[str]:
    """Names for a header row: blanks get column_2, and so on; repeated names .1, .2."""
    out: list[str] = []
    for i, h in enumerate(header):
        base = name = h or f"column_{i + 1}"
        k = 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


def table_of(found: DataFrame) -> DataFrame:
    """cells() -> the rows below each book's header row as columns of text, the first book's names for all. Books with other headers are an error; blank rows are left out."""
    tops = found.groupBy("path").agg(F.min_by("cells", "row").alias("header"), F.min("row").alias("top"))
    headers = tops.groupBy("header").agg(F.count(F.lit(1)).alias("books")).limit(2).collect()
    if not headers:
        raise QueryError("the sheet is empty")
    if len(headers) > 1:
        raise QueryError("the workbooks have different headers")
    header = named(headers[0]["header"])
    if len(header) > MOST_COLUMNS:
        raise QueryError(f"at most {MOST_COLUMNS} columns")
    body = found.join(F.broadcast(tops.select("path", "top")), "path").filter((F.col("row") > F.col("top")) & F.exists("cells", lambda c: c.isNotNull()))  # a row a book
    return body.select(*[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header)])


def read_workbook(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The first sheets of one workbook or of many (a folder, a pattern) as string columns. A book has at most most_bytes."""
    within_limit(spark, path, most_bytes)
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return table_of(cells(books))


# ---------------------------------------------------------------- frames as workbooks

_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _letters(at: int) -> str:
    out = ""
    while at:
        at, r = divmod(at - 1, 26)
        out = chr(65 + r) + out
    return out


def book_bytes(header: list[str], rows: list[tuple], pads: dict[str, int] | None = None) -> bytes:
    """A workbook of one sheet: texts as shared strings, numbers as numbers; columns in pads under a format of so many zeros."""
    escape = lambda t: re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", t).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    widths = sorted(set((pads or {}).values()))
    style = {c: 1 + widths.index(w) for c, w in (pads or {}).items()}
    strings: dict[str, int] = {}

    def cell(at: str, value, s: int) -> str:
        if value is None:
            return ""
        if isinstance(value, str):
            return f'<c r="{at}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        return f'<c r="{at}" s="{s}"><v>{value!r}</v></c>'

    names = [_letters(i + 1) for i in range(len(header))]
    lines = [f'<row r="{n}">' + "".join(cell(f"{names[i]}{n}", v, style.get(header[i], 0) if n > 1 else 0) for i, v in enumerate(r)) + "</row>" for n, r in enumerate([tuple(header), *rows], 1)]
    formats = "".join(f'<numFmt numFmtId="{170 + i}" formatCode="{"0" * w}"/>' for i, w in enumerate(widths))
    styles = "".join(f'<xf numFmtId="{170 + i}" applyNumberFormat="1"/>' for i in range(len(widths)))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + "".join(f'<Override PartName="/xl/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in (("workbook.xml", "sheet.main"), ("worksheets/sheet1.xml", "worksheet"), ("styles.xml", "styles"), ("sharedStrings.xml", "sharedStrings"))) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}">' + "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/{k}" Target="{t}"/>' for i, k, t in ((1, "worksheet", "worksheets/sheet1.xml"), (2, "styles", "styles.xml"), (3, "sharedStrings", "sharedStrings.xml"))) + "</Relationships>",
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><numFmts count="{len(widths)}">{formats}</numFmts><cellXfs count="{len(widths) + 1}"><xf numFmtId="0"/>{styles}</cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}">' + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in strings) + "</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, xml in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return out.getvalue()


def books_of(df: DataFrame, book: str, order: str, pads: dict[str, int] | None = None) -> DataFrame:
    """df as workbooks (path, content): one for each value of column `book`, which has to keep them small, its rows by `order`."""
    columns = [c for c in df.columns if c != book]

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        body = [tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in rows[columns].itertuples(index=False)]
        return pd.DataFrame([{"path": f"{rows[book].iloc[0]}.xlsx", "content": book_bytes(columns, body, pads)}])

    return df.groupBy(book).applyInPandas(write, "path string, content binary")
