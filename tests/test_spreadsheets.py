"""The spreadsheet source on files made by hand, and round trips through its writer."""

import datetime
import decimal
import glob
import os
import zipfile

import pytest

from voxlake.sources import spreadsheets as X

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>'
SHARED = f'<sst {NS}><si><t>name</t></si><si><r><t>rich </t></r><r><t xml:space="preserve">text</t></r><rPh><t>not read</t></rPh></si><si><t>when</t></si><si><t>a_x000D_b_x005F_x0041_</t></si></sst>'


def workbook(path, sheet, *, prefix="", about="", second="<sheetData/>"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}>{about}<sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/first.xml"/><Relationship Id="b" Target="/xl/worksheets/second.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", SHARED)
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/worksheets/first.xml", f"<worksheet {NS}>{prefix}{sheet}</worksheet>")
        z.writestr("xl/worksheets/second.xml", f"<worksheet {NS}>{second}</worksheet>")
    return str(path)


SHEET = """<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>2</v></c><c r="D1" t="inlineStr"><is><t>n</t></is></c><c r="E1" t="s"><v>0</v></c></row>
<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45293</v></c><c r="C2" s="2"><v>2.5</v></c><c r="D2"><v>12</v></c><c r="E2" t="b"><v>1</v></c></row>
<row r="5"><c r="A5" t="s"><v>3</v></c><c r="B5" s="3"><v>45293.75</v></c><c r="D5" t="e"><v>#N/A</v></c><c r="E5" t="str"><v>x</v></c></row>
<row><c><v>1E3</v></c><c s="1"><v>59</v></c><c/><c t="str"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A4"/><mergeCell ref="D6:E7"/></mergeCells>"""


def test_shared_strings_dates_merged_cells_and_blank_rows(spark, tmp_path):
    path = workbook(tmp_path / "a.xlsx", SHEET)
    df = X.read(spark, path)
    assert df.columns == ["name", "when", "_C", "n", "name_E"]
    blank = (None,) * 5
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("rich text", "2024-01-02", "2.5", "12", "true"), blank, blank, ("a\rb_x0041_", "2024-01-02 18:00:00", None, None, "x"), ("1000", "1900-02-28", None, "7", None)]
    typed = X.read(spark, path, "n long, when date, missing string, name_E boolean").collect()
    day = datetime.date
    assert [tuple(r) for r in typed] == [(12, day(2024, 1, 2), None, True), (None,) * 4, (None,) * 4, (None, day(2024, 1, 2), None, None), (7, day(1900, 2, 28), None, None)]
    whole = X.read(spark, path, merged="fill").collect()
    assert [r[0] for r in whole] == ["rich text"] * 3 + ["a\rb_x0041_", "1000"] and tuple(whole[4])[3:] == ("7", "7")
    assert X.read(spark, path, header=False).first()[3] == "n"


def test_the_other_date_system_and_sheets(spark, tmp_path):
    path = workbook(tmp_path / "a.xlsx", SHEET, about='<workbookPr date1904="1"/>', second='<sheetData><row r="1"><c r="A1"><v>5</v></c></row></sheetData>')
    assert X.read(spark, path).first().when == "2028-01-03"
    assert [tuple(r) for r in X.read(spark, path, sheet="Two", header=False).collect()] == [("5",)]
    assert X.read(spark, path, sheet=1).columns == ["5"] and X.read(spark, path, sheet=1).count() == 0
    with pytest.raises(Exception, match="no sheet"):
        X.read(spark, path, sheet="Three").collect()


@pytest.mark.parametrize("said", ['<dimension ref="A1:B11"/>', "", '<dimension ref="A1:B4"/>', '<dimension ref="A1:B500"/>'])
def test_ranges_cover_each_row_once(spark, tmp_path, said):
    lines = "".join(f'<row r="{k + 2}"><c r="A{k + 2}"><v>{k}</v></c></row>' for k in range(10) if k not in (3, 4, 7))
    path = workbook(tmp_path / "a.xlsx", f'<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row>{lines}</sheetData>', prefix=said)
    for step in (1, 3, 100):
        got = [r.name for r in X.read(spark, path, "name int", rows_per_partition=step).collect()]
        assert got == [None if k in (3, 4, 7) else k for k in range(10)]
    if "11" in said:
        assert X.read(spark, path, rows_per_partition=3).rdd.getNumPartitions() == 4


SCHEMA = "i long, j int, d double, b boolean, s string, day date, t timestamp_ntz, m decimal(20,3)"
ROWS = [
    (1, -5, 0.1, True, "plain", datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 23, 59, 59, 999000), decimal.Decimal("12.345")),
    ((1 << 63) - 1, 0, 1e300, False, " <&>\"' \r\n\t\x01 _x0041_ é日本\U0001f600 ", datetime.date(1900, 1, 1), datetime.datetime(1900, 2, 28, 12), decimal.Decimal("12345678901234567.891")),
    (None,) * 8,
    (-(1 << 53) - 1, None, -0.0, None, "", datetime.date(1850, 5, 5), datetime.datetime(1850, 5, 5, 1, 2, 3), decimal.Decimal("-0.001")),
]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, SCHEMA)
    X.write(df.repartition(3), path)
    key = lambda r: str(r[0])
    assert sorted(map(tuple, X.read(spark, path, SCHEMA).collect()), key=key) == sorted(ROWS, key=key)
    X.write(df.where("i = 1"), f"file://{path}", append=True)
    assert X.read(spark, path, SCHEMA).count() == 5
    X.write(df.limit(2).coalesce(1), path, rows_per_file=1)
    assert len(glob.glob(f"{path}/*.xlsx")) == 3 and X.read(spark, path, SCHEMA).count() == 2  # the last file has a header only
    assert not glob.glob(f"{path}/_job*") and os.path.exists(f"{path}/_SUCCESS")
    X.write(df.limit(0), path)
    assert X.read(spark, path, SCHEMA).collect() == []


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    X.write(spark.createDataFrame([("old",)], "s string"), path)
    with pytest.raises(Exception, match="32767|40000"):
        X.write(spark.createDataFrame([("x" * 40_000,)], "s string"), path)
    assert X.read(spark, path).collect()[0].s == "old" and not glob.glob(f"{path}/_job*")


def test_another_reader_can_open_it(spark, tmp_path):
    """By the format's own rules: parts named by relations, cells in order with references."""
    path = str(tmp_path / "out")
    X.write(spark.createDataFrame([(1, "a"), (2, None)], "n long, s string").coalesce(1), path, sheet="R&D")
    (file,) = glob.glob(f"{path}/*.xlsx")
    book = X.Workbook(file)
    assert list(book.sheets) == ["R&D"] and {"[Content_Types].xml", "_rels/.rels"} <= set(book.zip.namelist())
    assert list(book.rows(book.sheet("0"), 1, None)) == [(1, {0: "n", 1: "s"}), (2, {0: 1, 1: "a"}), (3, {0: 2})]


def test_names():
    for k, name in ((0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA"), (16383, "XFD")):
        assert X.column_name(k) == name and X.column_number(f"{name}17") == k


def test_missing(spark, tmp_path):
    with pytest.raises(Exception, match="gone"):
        X.read(spark, str(tmp_path / "gone")).collect()
