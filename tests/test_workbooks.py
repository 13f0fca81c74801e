"""Workbooks: stored values as texts, large sheets in blocks, folders of books."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from tallyloom.fields import QueryError
from tallyloom.sources import files, workbooks

MAIN = workbooks._MAIN
BOOK = f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Z" sheetId="7" r:id="b"/><sheet name="A" sheetId="1" r:id="a"/></sheets></workbook>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
STYLES = f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="00000;[Red]-00000"/><numFmt numFmtId="165" formatCode="dd\\-mmm\\-yyyy"/><numFmt numFmtId="166" formatCode="&quot;day&quot; 0"/><numFmt numFmtId="167" formatCode="0"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="167"/><xf numFmtId="21"/></cellXfs></styleSheet>'
STRINGS = f'<sst xmlns="{MAIN}"><si><t>Id</t></si><si><r><t>Da</t></r><r><t>te</t></r><rPh sb="0" eb="1"><t>x</t></rPh></si><si><t xml:space="preserve"> a &amp; b </t></si></sst>'


def book(sheet, styles=STYLES, prefix=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, x in {"xl/workbook.xml": BOOK, "xl/_rels/workbook.xml.rels": RELS, "xl/styles.xml": styles, "xl/sharedStrings.xml": STRINGS, "xl/worksheets/sheet1.xml": "<no/>", "xl/worksheets/sheet2.xml": sheet}.items():
            z.writestr(n, x)
    return out.getvalue()


SHEET = f"""<worksheet xmlns="{MAIN}"><cols><col min="1"/></cols><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>Id</t></is></c><c r="E2" t="str"><v>Note</v></c></row>
<row r="3" spans="1:5"><c r="A3" s="1"><v>101</v></c><c r="B3" s="2"><v>46217</v></c><c r="C3" s="5"><v>7</v></c><c r="D3"><v>1.50</v></c><c r="E3" t="s"><v>2</v></c></row><row r="4"/>
<row r="5"><c r="A5" s="1"><v>2.5</v></c><c r="B5" s="3"><v>46217.75</v></c><c r="C5" t="b"><v>1</v></c><c r="D5" t="e"><v>#N/A</v></c><c r="E5" s="4"><v>3</v></c></row>
<row r="9"><c r="A9" s="1"><v>1234567</v></c><c r="B9" s="6"><v>0.5</v></c><c r="E9"><v>1E3</v></c></row></sheetData><rowBreaks count="1"/></worksheet>"""


def read(spark, tmp_path, *contents):
    for i, c in enumerate(contents):
        (tmp_path / f"b{i}.xlsx").write_bytes(c)
    return workbooks.read_workbook(spark, str(tmp_path))


def test_cells_as_an_export_shows_them(spark, tmp_path):
    df = read(spark, tmp_path, book(SHEET))
    assert df.columns == ["Id", "Date", "Id.1", "column_4", "Note"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("00101", "2026-07-14 00:00:00", "7", "1.5", " a & b "), ("2.5", "2026-07-14 18:00:00", "True", None, "3"), ("1234567", "12:00:00", None, None, "1000")], key=str)


def test_other_spellings_of_the_same_sheet(spark, tmp_path):
    prefixed = SHEET.replace("<", "<x:").replace("<x:/", "</x:").replace("xmlns=", "xmlns:x=")
    df = read(spark, tmp_path, book(prefixed), book(SHEET, styles="broken <"))
    rows = df.groupBy("Id").count().collect()
    assert {(r[0], r[1]) for r in rows} == {("00101", 1), ("101", 1), ("2.5", 2), ("1234567", 2)}  # a broken style table loses the padding only


def test_a_large_book_is_parsed_by_many_tasks(spark, tmp_path):
    n = 200_000
    content = workbooks.book_bytes(["code", "name", "amount"], [(i % 10_000, f"n{i % 1000} <&>", i / 4) for i in range(n)], {"code": 5})
    (tmp_path / "big.xlsx").write_bytes(content)
    df = workbooks.read_workbook(spark, str(tmp_path / "big.xlsx"))
    got = df.agg(F.count("*"), F.count_distinct("code"), F.min(F.length("code")), F.max(F.length("code")), F.sum(F.col("amount").cast("double")), F.count_distinct("name")).first()
    assert tuple(got) == (n, 10_000, 5, 5, sum(i / 4 for i in range(n)), 1000)
    found = workbooks.blocks(spark.read.format("binaryFile").load(str(tmp_path / "big.xlsx")))
    sizes = found.select(F.length("rows").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert len(sizes) > 10 and len({r["p"] for r in sizes}) > 1 and max(r["n"] for r in sizes) < 3 * workbooks.BLOCK
    assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()  # no rows come from the driver


def test_what_is_no_workbook(spark, tmp_path):
    with pytest.raises(QueryError):
        read(spark, tmp_path, book(f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>'))
    other = SHEET.replace("Note", "Other")
    with pytest.raises(QueryError):
        read(spark, tmp_path, book(SHEET), book(other))
    with pytest.raises(QueryError):
        workbooks.read_workbook(spark, str(tmp_path / "b0.xlsx"), most_bytes=100)
    wide = f'<worksheet xmlns="{MAIN}"><sheetData><row r="1">' + "".join(f'<c r="{workbooks._letters(i)}1"><v>{i}</v></c>' for i in range(1, 103)) + "</row></sheetData></worksheet>"
    with pytest.raises(QueryError):
        read(spark, tmp_path, book(wide), book(wide))
    with pytest.raises(Exception, match="half-way"):
        list(workbooks.blocks_of(book(SHEET[:700])))


def test_delimited_text_has_a_size_gate(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    assert files.read_cells(spark, str(tmp_path / "a.csv")).collect()[0]["b"] == "2"
    with pytest.raises(QueryError):
        files.within_limit(spark, str(tmp_path / "a.csv"), 3)
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(QueryError):
        files.read_cells(spark, str(tmp_path / "e.csv"))
